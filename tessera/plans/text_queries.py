"""Text functions over documents, pages and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query, table
from ..functions import text as T

STOP = ("the", "and", "that", "this", "with", "from", "les", "des", "und", "der", "die", "que", "los")
_IN_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = f"SELECT doc_id, source, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents"
_CLEAN = f"SELECT * FROM ({_TOKENS}) WHERE length(w) BETWEEN 3 AND 24 AND regexp_matches(w, '[aeiou]') AND w NOT IN ({_IN_STOP})"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def words(spark, sf_dir):
    """One row a cleaned token. An inner explode would have Spark cut up each text once more, to see whether it has any token."""
    return docs(spark, sf_dir).select("doc_id", "source", "lang", F.explode_outer(T.tokens(F.col("text"), STOP)).alias("w")).where("w is not null")


@query(r"""SELECT event_id, TRY_CAST(CASE WHEN regexp_matches(b, '^[+-]?[0-9]*\.?[0-9]+$') THEN b END AS DOUBLE) AS price FROM
(SELECT event_id, regexp_replace(regexp_replace(trim('$' || CAST(event_id AS VARCHAR) || ',' || props), '^[$€£¥]+', ''), '[, ]', '', 'g') AS b FROM (SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'x') AS props FROM events))""")
def parse_price(spark, sf_dir):
    raw = F.concat(F.lit("$"), F.col("event_id").cast("string"), F.lit(","), F.coalesce(F.get_json_object("props", "$.k"), F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", T.parse_price(raw).alias("price"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) / (s_suppkey % 7) END AS odds FROM supplier")
def parse_odds(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.parse_odds(F.concat(key.cast("string"), F.lit("-"), (key % 7).cast("string"))).alias("odds"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_type), ' ', '-'), '-'), lambda p: upper(p[1]) || p[2:]), ' ') AS label FROM part")
def humanize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.humanize(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))).alias("label"))


@query("SELECT page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')), 60) AS label FROM pages")
def norm_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.norm_label(F.col("url")).alias("label"))


@query(r"SELECT doc_id, left(regexp_replace(lower(text), '\s+', ' ', 'g'), 150) AS fp FROM documents")
def fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fp"))


@query("SELECT page_id, nullif(regexp_extract(url, 'ref=([^&#]+)', 1), '') AS ref FROM pages")
def extract_query_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.query_param(F.col("url"), "ref").alias("ref"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("body"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS BIGINT) AS links FROM pages")
def html_links(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), ''), url) AS heading FROM pages")
def first_heading(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1), F.lit("")), "url").alias("heading"))


@query("SELECT doc_id, round(coalesce(len(list_filter(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda w: regexp_matches(w, '^[A-Z]+$'))) / nullif(CAST(len(regexp_extract_all(text, '[A-Za-z]{4,}')) AS DOUBLE), 0), 0), 6) AS caps FROM documents")
def caps_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(T.caps_ratio(F.col("text")), 6).alias("caps"))


@query(f"SELECT doc_id, w FROM ({_CLEAN})")
def tokens_clean(spark, sf_dir):
    """The cleaned tokens of every document, one row each."""
    return words(spark, sf_dir).select("doc_id", "w")


@query("SELECT page_id, array_to_string(list_filter(string_split(replace(regexp_extract(url, '//([^/?#]*)', 1), '-', '.'), '.'), lambda p: length(p) > 2 AND p NOT IN ('www', 'com', 'org', 'net')), ' ') AS phrase FROM pages")
def phrases_clean(spark, sf_dir):
    parts = F.filter(F.split(F.replace(F.regexp_extract("url", "//([^/?#]*)", 1), F.lit("-"), F.lit(".")), "[.]"), lambda p: (F.length(p) > 2) & ~p.isin("www", "com", "org", "net"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(parts, " ").alias("phrase"))


@query(r"SELECT doc_id, left(coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\s', 1), ''), text), 140) AS tldr FROM documents")
def first_sentence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text")).alias("tldr"))


@query(r"SELECT doc_id, left(coalesce(list_filter(string_split(text, chr(10)), lambda p: length(p) >= 40 AND NOT contains(p, '|'))[1], ''), 280) AS lead FROM documents")
def first_paragraph(spark, sf_dir):
    found = F.get(F.filter(F.split("text", "\n"), lambda p: (F.length(p) >= 40) & ~F.contains(p, F.lit("|"))), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", F.left(F.coalesce(found, F.lit("")), F.lit(280)).alias("lead"))


_PATTERNS = [("table", "[|]"), ("shout", "!!"), ("code", "[$%&#]{3}"), ("list", "[0-9]+[.]")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _PATTERNS) + " ELSE 'prose' END AS kind FROM documents")
def first_matching_pattern(spark, sf_dir):
    kind = F
    for name, pattern in _PATTERNS:
        kind = kind.when(F.col("text").rlike(pattern), name)
    return docs(spark, sf_dir).select("doc_id", kind.otherwise("prose").alias("kind"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[|]')) AS BIGINT) AS bars, CAST(len(regexp_extract_all(text, '!!')) // 2 AS BIGINT) AS shouts FROM documents")
def regex_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit("[|]")).cast("long").alias("bars"), F.expr("cast(regexp_count(text, '!!') div 2 as bigint)").alias("shouts"))


@query(f"""WITH c AS (SELECT doc_id, w, count(*) AS n FROM ({_CLEAN}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rn FROM c)
SELECT doc_id, string_agg(w || ':' || CAST(n AS VARCHAR), ' ' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY doc_id""")
def doc_top_tokens(spark, sf_dir):
    c = words(spark, sf_dir).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).where("rn <= 5")
    top = F.sort_array(F.collect_list(F.struct("rn", F.concat_ws(":", "w", F.col("n").cast("string")).alias("t"))))
    return r.groupBy("doc_id").agg(F.array_join(F.transform(top, lambda x: x["t"]), " ").alias("top"))


@query(f"SELECT source, w, count(*) AS n FROM ({_CLEAN}) GROUP BY source, w HAVING count(*) >= 20")
def phrase_counts(spark, sf_dir):
    return words(spark, sf_dir).groupBy("source", "w").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"SELECT w, count(DISTINCT doc_id) AS df FROM ({_CLEAN}) GROUP BY w HAVING count(DISTINCT doc_id) >= 5")
def doc_freq(spark, sf_dir):
    return words(spark, sf_dir).select("doc_id", "w").distinct().groupBy("w").agg(F.count("*").alias("df")).where("df >= 5")


def _tfidf(boost: bool):
    more = "* ln(1 + c.n)" if boost else ""
    return f"""WITH c AS (SELECT source, w, count(*) AS n FROM ({_CLEAN}) GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total FROM c GROUP BY source),
d AS (SELECT w, count(*) AS df FROM c GROUP BY w), s AS (SELECT c.source, c.w, round(CAST(c.n AS DOUBLE) / t.total * (ln((SELECT count(*) + 1 FROM t) / CAST(d.df + 1 AS DOUBLE)) + 1) {more}, 9) AS score
FROM c JOIN t USING (source) JOIN d USING (w) WHERE c.n >= 3 AND length(c.w) >= 4), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, w) AS rn FROM s)
SELECT source, w, round(score, 6) AS score FROM r WHERE rn <= 15"""


def _tfidf_top(spark, sf_dir, boost):
    c = words(spark, sf_dir).groupBy("source", "w").agg(F.count("*").alias("n"))
    total = c.groupBy("source").agg(F.sum("n").alias("total"))  # a row a source
    groups = total.agg(F.count("*").alias("groups"))
    c = c.join(F.broadcast(total), "source")
    df = c.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log((F.col("groups") + 1) / (F.col("df") + 1).cast("double")) + 1
    score = F.col("n").cast("double") / F.col("total") * idf
    s = c.where("n >= 3 and length(w) >= 4").join(df, "w").crossJoin(groups).withColumn("score", F.round(score * F.log(1 + F.col("n")) if boost else score, 9))
    r = s.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "w"))).where("rn <= 15")
    return r.select("source", "w", F.round("score", 6).alias("score"))


@query(_tfidf(False))
def tfidf_group(spark, sf_dir):
    return _tfidf_top(spark, sf_dir, False)


@query(_tfidf(True))
def tfidf_boosted(spark, sf_dir):
    return _tfidf_top(spark, sf_dir, True)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_from_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT o_orderkey, left(sha256(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderstatus, '|', o_orderpriority)), 16) AS h FROM orders")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.left(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256), F.lit(16)).alias("h"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS leaf, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("leaf"), F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("parent"))


@query("SELECT event_id, CAST(isodow(ts) - 1 AS BIGINT) AS dow, isodow(ts) - 1 IN (4, 5) AS weekend, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events")
def weekend_flags(spark, sf_dir):
    dow = F.weekday("ts")
    return table(spark, sf_dir, "events").select("event_id", dow.cast("long").alias("dow"), dow.isin(4, 5).alias("weekend"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day"))


@query("SELECT page_id, CAST(list_sum(list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM pages")
def extract_all_numbers(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))


@query("SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS num FROM customer")
def strip_annotations(spark, sf_dir):
    name = T.strip_annotations(F.concat("c_name", F.lit("[a] (USA)")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract(name, "([0-9]+)$", 1).try_cast("long").alias("num"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '/(en|fr|de|es)/', 1) IN ('en', 'fr') THEN regexp_extract(url, '/(en|fr|de|es)/', 1) WHEN regexp_extract(url, '[.](com|org)', 1) = 'org' THEN 'org' END AS pick FROM pages")
def first_valid_pattern(spark, sf_dir):
    lang, top = F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.regexp_extract("url", "[.](com|org)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.when(lang.isin("en", "fr"), lang), F.when(top == "org", top)).alias("pick"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY n_chars DESC, doc_id) AS rn FROM (SELECT *, left(regexp_replace(lower(text), '\\s+', ' ', 'g'), 60) AS fp FROM documents)) WHERE rn = 1 ORDER BY n_chars DESC, doc_id LIMIT 100")
def ranked_dedupe(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", "source", "n_chars", T.fingerprint(F.col("text"), 60).alias("fp"))
    best = own.withColumn("rn", F.row_number().over(W.partitionBy("source", "fp").orderBy(F.desc("n_chars"), "doc_id"))).where("rn = 1")
    return best.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
