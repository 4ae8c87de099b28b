"""What the queries of relational.py must return, as SQL of the second engine; written apart from them."""

SQL = {
    "scan_parquet": 'SELECT * FROM nation',
    "scan_pruned": 'SELECT l_suppkey, l_shipdate FROM lineitem',
    "scan_isin": 'SELECT user_id, event_type, value FROM events WHERE user_id IN (3, 5, 8, 13, 21, 34)',
    "semi_join_ids": 'SELECT doc_id, source, n_chars FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id',
    "table_counts": "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents",
    "broadcast_lookup": "SELECT c_custkey, c_mktsegment, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "latest_k_per_key": 'SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2',
    "etl_project": "SELECT event_id, user_id, upper(event_type) AS event_type, coalesce(value, 0) AS amount FROM events WHERE event_type IN ('purchase', 'signup')",
    "nonempty_text": "SELECT doc_id, source FROM documents WHERE length(coalesce(text, '')) > 0",
    "bool_filter": 'SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0',
    "greatest_cols": 'SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 100, l_tax * 100) AS top FROM lineitem',
    "month_valid_rows": 'SELECT event_id, user_id FROM events WHERE year(ts) = 2024 AND month(ts) = 1 AND user_id > 0 AND user_id < 1000',
    "exclude_keys": 'SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (1, 5, 9)',
    "length_between": "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 200 AND 2000 AND lang = 'en'",
    "case_rank": "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS priority_rank FROM orders",
    "prefilter_terms": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%idiot%' OR lower(text) LIKE '%scum%' OR lower(text) LIKE '%clown%'",
    "search_all_terms": "SELECT doc_id, source FROM documents WHERE contains(lower(concat(text, ' ', source)), 'the') AND contains(lower(concat(text, ' ', source)), 'src1') AND lang = 'en' ORDER BY doc_id LIMIT 60",
    "blocklist_anti": 'SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) b ON c_nationkey = b.s_nationkey',
    "pin_top": 'SELECT s_suppkey, row_number() OVER (ORDER BY CASE s_suppkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END, s_acctbal DESC, s_suppkey) AS place FROM supplier ORDER BY place',
    "join_inner": 'SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey',
    "join_inner_sql": 'SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey',
    "join_left_dropna": 'SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL',
    "join_multi_left": 'SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON c_custkey = user_id',
    "join_left": 'SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id',
    "join_semi": 'SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey',
    "exists_flag": 'SELECT c_custkey, u.user_id IS NOT NULL AS has_events FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON c_custkey = u.user_id',
    "join_anti": 'SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey',
    "join_broadcast_default": "SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey",
    "join_prefix": "SELECT d.source, d.lang, count(*) AS n FROM documents d JOIN (SELECT DISTINCT concat(lang, '|', source) AS k FROM documents WHERE n_chars > 5000) b ON d.lang = split_part(b.k, '|', 1) AND d.source = split_part(b.k, '|', 2) GROUP BY d.source, d.lang",
    "ci_overlap": 'WITH s AS (SELECT event_type AS bucket, avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) AS lo, avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) AS hi FROM events GROUP BY event_type) SELECT a.bucket AS left_bucket, b.bucket AS right_bucket, NOT (a.hi < b.lo OR b.hi < a.lo) AS overlaps FROM s a JOIN s b ON a.bucket < b.bucket',
    "densify_calendar": 'WITH m AS (SELECT DISTINCT year(l_shipdate) * 100 + month(l_shipdate) AS ym FROM lineitem), s AS (SELECT s_suppkey FROM supplier), c AS (SELECT l_suppkey, year(l_shipdate) * 100 + month(l_shipdate) AS ym, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT s_suppkey, CAST(m.ym AS BIGINT) AS ym, coalesce(c.n, 0) AS n FROM s CROSS JOIN m LEFT JOIN c ON c.l_suppkey = s_suppkey AND c.ym = m.ym',
    "agg_named": 'SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price, round(median(l_extendedprice), 4) AS median_price, round(stddev_samp(l_quantity), 4) AS std_qty, min(l_tax) AS min_tax, max(l_discount) AS max_discount FROM lineitem GROUP BY l_returnflag, l_linestatus',
    "agg_conditional": "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' AND value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big_clicks FROM events GROUP BY user_id",
    "agg_filtered_min": "SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_purchase FROM events GROUP BY user_id",
    "agg_bool_or": 'SELECT source, bool_or(n_chars > 10000) AS has_long, max(n_chars) AS longest FROM documents GROUP BY source',
    "qa_stats": 'SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) * 1.0 AS null_rate FROM events GROUP BY event_type',
    "zone_month_counts": 'SELECT l_suppkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS ym, count(*) AS n FROM lineitem GROUP BY 1, 2',
    "moments_merge": 'SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(sum(value * value) / count(*) - avg(value) * avg(value), 3) AS var, round(sqrt((sum(value * value) / count(*) - avg(value) * avg(value)) / count(*)), 4) AS stderr FROM events GROUP BY event_type',
    "histogram_desc": 'SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source',
    "pct_of_total": 'SELECT lang, count(*) AS n, round(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY lang',
    "rate_per_million": 'SELECT event_type, round(1000000 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events), 3) AS per_million FROM events GROUP BY event_type',
    "rating_pivot": 'SELECT source, count(*) AS n, round(100 * CAST(sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pct_1, round(100 * CAST(sum(CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pct_2, round(100 * CAST(sum(CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pct_3, round(100 * CAST(sum(CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pct_4, round(100 * CAST(sum(CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pct_5 FROM documents GROUP BY source',
    "monopoly_share": 'WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment) AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS rn FROM c) SELECT c_mktsegment, c_nationkey, n, round(CAST(n AS DOUBLE) / total, 6) AS share FROM r WHERE rn = 1 AND total >= 10',
    "mode_with_support": 'WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) SELECT user_id, event_type, n FROM r WHERE rn = 1 AND n >= 10',
    "primary_by_weight": 'WITH w AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS w FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderpriority) AS rn FROM w) SELECT o_custkey, o_orderpriority AS main_priority FROM r WHERE rn = 1',
    "cluster_rank_score": 'WITH m AS (SELECT source, avg(n_chars) AS mean FROM documents GROUP BY source), r AS (SELECT source, rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / CAST(2 AS DOUBLE) AS pos FROM m) SELECT d.doc_id, round(d.n_chars / CAST(1000 AS DOUBLE) - CAST(0.1 AS DOUBLE) * floor(r.pos), 6) AS combined FROM documents d JOIN r ON d.source = r.source',
    "rate_by_key": "SELECT o_orderpriority, round(100 * avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS pct_f FROM orders GROUP BY o_orderpriority",
    "entity_stats": "SELECT o_custkey, count(*) AS starts, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(100 * CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS win_pct FROM orders GROUP BY o_custkey",
    "tail_prob": 'SELECT event_type, round(avg(CASE WHEN value >= 100 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS p_tail FROM events GROUP BY event_type',
    "latest_per_key": 'SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1',
    "distinct_subset": 'SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1',
    "fold_small_groups": "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT d.doc_id, CASE WHEN c.n >= 50 THEN d.source ELSE 'other' END AS grp FROM documents d JOIN c ON d.source = c.source",
    "having_min_total": 'SELECT l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) >= 700',
    "run_report": "SELECT count(*) AS tasks, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(sum(value), 2) AS total FROM events",
    "geo_grouping_sets": 'SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())',
    "cube_counts": 'SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)',
    "rollup_counts": 'SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)',
    "bucket_median": 'SELECT source AS bucket, count(*) AS n, round(median(n_chars), 4) AS med FROM documents GROUP BY source',
    "rownum_first": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "winner_rank_points": 'WITH r AS (SELECT year(o_orderdate) AS y, o_orderkey, rank() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC) - 1 AS above, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS rn FROM orders) SELECT CAST(y AS BIGINT) AS y, CAST(above AS BIGINT) AS above, CAST(CASE WHEN above = 0 THEN 10 WHEN above = 1 THEN 5 WHEN above = 2 THEN 2 WHEN above = 3 THEN 1 ELSE 0 END AS BIGINT) AS points FROM r WHERE rn = 1',
    "topk_per_group": 'SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3',
    "runner_up_fallback": 'WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (0, 1, 2, 3) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS rn FROM c) SELECT c_mktsegment, c_nationkey, n FROM r WHERE rn = 1',
    "cumulative_share": 'WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS pos, round(100 * CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(n) OVER (PARTITION BY l_returnflag), 4) AS cum_pct FROM c',
    "minmax_norm": 'WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round(CASE WHEN hi = lo THEN 5 ELSE 10 * (s_acctbal - lo) / (hi - lo) END, 6) AS norm FROM supplier CROSS JOIN b',
    "softmax": 'WITH b AS (SELECT avg(s_acctbal) AS m FROM supplier), e AS (SELECT s_suppkey, exp((s_acctbal - m) / 5000) AS x FROM supplier CROSS JOIN b), t AS (SELECT sum(x) AS total FROM e) SELECT s_suppkey, round(x / total, 8) AS p FROM e CROSS JOIN t',
    "lag_lead": 'SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events',
    "ntile_range": 'SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter FROM orders',
    "topk_global": 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25',
    "topk_axes_union": 'SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT * FROM (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40) UNION ALL SELECT * FROM (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 40) UNION ALL SELECT * FROM (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_discount DESC, l_orderkey, l_linenumber LIMIT 40))',
    "best_per_key_topk": 'WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, l_extendedprice FROM b WHERE rn = 1 ORDER BY l_extendedprice DESC, l_orderkey LIMIT 50) SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey) + 999 AS BIGINT) AS cand_id FROM t',
    "sort_mixed": 'SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size ASC, p_retailprice DESC, p_partkey',
    "head_rows": 'SELECT n_nationkey, n_name FROM nation LIMIT 5',
    "topk_plus_forced": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 OR o_orderpriority = '1-URGENT'",
    "samples_per_key": 'SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 8',
    "hash_sample": 'SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100',
    "union_all": "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier",
    "union_sentinel_dedupe": "SELECT url_key, min(idx) AS idx FROM (SELECT concat('k', CAST(o_custkey AS VARCHAR)) AS url_key, o_orderkey AS idx FROM orders UNION ALL SELECT concat('k', CAST(c_custkey AS VARCHAR)), -1 FROM customer) u GROUP BY url_key",
    "merge_keep_best": "SELECT k, origin, norm FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY norm DESC, origin) AS rn FROM (SELECT c_nationkey AS k, 'c' AS origin, max(c_acctbal) AS norm FROM customer GROUP BY c_nationkey UNION ALL SELECT s_nationkey, 's', max(s_acctbal) FROM supplier GROUP BY s_nationkey) u) r WHERE rn = 1",
    "except_terms": 'SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000',
    "intersect_terms": 'SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier',
    "priority_source_merge": 'SELECT k, v, origin FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY origin) AS rn FROM (SELECT o_custkey AS k, max(o_totalprice) AS v, 1 AS origin FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, c_acctbal, 2 FROM customer) u) r WHERE rn = 1',
    "insert_ignore": "SELECT o_custkey AS id, 'old' AS origin FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) x UNION ALL SELECT c_custkey, 'new' FROM customer ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) y ON c_custkey = y.o_custkey",
    "century": 'SELECT o_orderkey, CAST(floor(year(o_orderdate) / CAST(100 AS DOUBLE)) + CASE WHEN year(o_orderdate) > 0 THEN 1 ELSE 0 END AS BIGINT) AS century FROM orders',
    "safe_ratio": 'SELECT o_orderkey, round(least(greatest(o_totalprice / nullif(o_custkey % 7, 0), 0), 50000), 4) AS ratio FROM orders',
    "fixed_bucket": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 0 THEN '0' WHEN l_linenumber <= 1 THEN '1' WHEN l_linenumber <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM lineitem",
    "enrich_rowwise": "SELECT page_id, contains(url, 'ref=') AS has_ref, length(url) AS url_len, CASE WHEN length(html) > 4000 THEN 'large' WHEN length(html) > 1500 THEN 'medium' ELSE 'small' END AS size_class FROM pages",
    "exclaim_count": "SELECT doc_id, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclaims FROM documents",
    "shorten": "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(left(text, 79), '…') ELSE text END AS short, text = '' OR length(text) < 140 AS placeholder FROM documents",
    "kelly": 'SELECT o_orderkey, round(least(greatest((0.3 * (1 + o_custkey % 9) - 0.7) / (1 + o_custkey % 9), 0), 0.25) * CAST(1 AS DOUBLE), 6) AS kelly FROM orders',
    "piecewise_score": 'SELECT s_suppkey, greatest(75, 105 - 3 * (s_suppkey % 15)) AS beyer, least(CAST(6 AS DOUBLE), 2 + CAST(0.3 AS DOUBLE) * (s_suppkey % 15)) AS pace FROM supplier',
    "vocab_map": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'tin') THEN 'tin' ELSE 'other' END AS metal FROM part",
    "log_loss": "SELECT o_orderpriority, round(avg(-CASE WHEN o_orderstatus = 'F' THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM (SELECT *, least(greatest((o_custkey % 100) / CAST(100 AS DOUBLE), 0.000001), 0.999999) * CAST(1 AS DOUBLE) AS p FROM orders) q GROUP BY o_orderpriority",
    "occupancy": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS booked, max(value) AS price FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS n_days, round(CAST(sum(booked) AS DOUBLE) / count(*), 6) AS occupancy, round(stddev_samp(price) / avg(price), 5) AS volatility FROM d GROUP BY user_id",
    "section_topk": 'SELECT c_mktsegment, c_custkey, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT c_mktsegment, c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON c_custkey = o_custkey) b WHERE rn = 1) t WHERE place <= 40',
    "map_points": 'SELECT DISTINCT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT c_custkey, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000) u WHERE c_nationkey IS NOT NULL',
    "top_member_share": 'WITH c AS (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY r_name) AS total, row_number() OVER (PARTITION BY r_name ORDER BY n DESC, n_name) AS rn FROM c) SELECT r_name, n_name, round(CAST(n AS DOUBLE) / total, 6) AS share FROM r WHERE rn = 1',
    "per_capita": 'SELECT n_name, round(CAST(count(*) AS DOUBLE) * 1000000 / (1000 + 37 * max(n_nationkey)), 1) AS per_million FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 3',
    "dominant_attr_per_group": 'WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) SELECT source, lang, round(100 * CAST(n AS DOUBLE) / total, 2) AS pct FROM r WHERE rn = 1',
    "longest_docs": 'SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30',
    "topic_extinct": 'WITH y AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, y) AS rn FROM y) SELECT p.k, CAST(p.y AS BIGINT) AS peak_year, p.n AS peak, round(CAST(r.recent AS DOUBLE) / (p.n * 5), 6) AS decline FROM p JOIN (SELECT k, sum(CASE WHEN y > 1996 THEN n ELSE 0 END) AS recent FROM y GROUP BY k) r ON p.k = r.k WHERE p.rn = 1 AND p.n >= 10',
    "topic_emergent": "SELECT o_orderpriority AS k, count(*) AS n, round(CAST(sum(CASE WHEN o_orderdate >= TIMESTAMP '1999-08-01 00:00:00' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS burst FROM orders GROUP BY o_orderpriority HAVING count(*) >= 50 AND count(DISTINCT year(o_orderdate)) >= 3",
    "backtest_points": 'WITH w AS (SELECT 1 AS wid, 0.6 AS a, 0.4 AS b UNION ALL SELECT 2, 0.2, 0.8 UNION ALL SELECT 3, 0.5, 0.5), s AS (SELECT wid, year(o_orderdate) AS y, o_orderkey, a * (o_totalprice / 1000) + b * (o_custkey % 100) AS score FROM orders CROSS JOIN w), r AS (SELECT wid, y, o_orderkey, row_number() OVER (PARTITION BY wid, y ORDER BY score DESC, o_orderkey) AS pos FROM s) SELECT CAST(wid AS BIGINT) AS wid, CAST(sum(CASE pos WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END) AS BIGINT) AS points FROM r GROUP BY wid',
    "baseline_points": 'WITH f AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT round(sum(CAST(18 AS DOUBLE) / n), 6) AS expected FROM f',
    "tumbling_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "session_gap": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid",
}
