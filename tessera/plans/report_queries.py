"""Scoring, report and formatting queries: keyword categories, severities, the first tier of the funnel, name and place joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query, table
from ..functions import text as T

# Vocabularies and their weights, in the order that settles ties.
CATEGORIES = {"article": (("the", 1.0), ("la", 1.0), ("der", 1.0)), "joiner": (("and", 1.5), ("und", 1.5), ("et", 1.5)), "place": (("in", 2.0), ("on", 1.0), ("de", 0.5))}
MARKERS = ("not", "never", "but")
CITIES = (("Lisbon", 38.72, -9.14), ("Cairo", 30.04, 31.24), ("Quito", -0.18, -78.47), ("Osaka", 34.69, 135.5), ("Perth", -31.95, 115.86))

_KEYWORDS = ", ".join(f"('{c}', {i}, '{w}', {x})" for i, (c, own) in enumerate(CATEGORIES.items()) for w, x in own)
_WORDS = "SELECT doc_id, source, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM documents"
_HITS = f"SELECT doc_id, source, category, place, w, weight, count(*) AS n FROM ({_WORDS}) JOIN (VALUES {_KEYWORDS}) k(category, place, word, weight) ON w = word GROUP BY ALL"
_FEATURES = """SELECT doc_id, source, len(ws) AS words, length(t) AS chars, length(t) - length(replace(t, '!', '')) AS exclam, len(list_filter(ws, lambda w: w IN ('not', 'never', 'but'))) AS markers,
len(list_filter(ws, lambda w: w IN ('the', 'and', 'in'))) AS strong FROM (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS ws FROM documents)"""


def _split(df):
    return df.withColumn("ws", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != ""))


def _hits(spark, sf_dir):
    """(doc_id, source, category, place, w, weight, n): occurrences of each keyword; only keywords leave the scan."""
    listed = spark.createDataFrame([(c, i, w, x) for i, (c, own) in enumerate(CATEGORIES.items()) for w, x in own], "category string, place int, w string, weight double")
    found = _split(table(spark, sf_dir, "documents")).select("doc_id", "source", F.explode_outer("ws").alias("w"))
    return found.join(F.broadcast(listed), "w").groupBy("doc_id", "source", "category", "place", "w", "weight").agg(F.count("*").alias("n"))


def _features(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    some = lambda *words: F.size(F.filter("ws", lambda w: w.isin(*words)))
    return _split(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.size("ws").alias("words"), F.length(text).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("exclam"),
        some(*MARKERS).alias("markers"), some("the", "and", "in").alias("strong"),
    )


@query(f"SELECT doc_id, arg_min(category, struct_pack(a := -score, b := place)) AS category, max(score) AS score FROM (SELECT doc_id, category, place, sum(least(n, 4) * weight) AS score FROM ({_HITS}) GROUP BY ALL) GROUP BY doc_id")
def keyword_category(spark, sf_dir):
    """The category with the most weighted hits, at most four a keyword; ties go to the first declared."""
    score = _hits(spark, sf_dir).groupBy("doc_id", "category", "place").agg(F.sum(F.least("n", F.lit(4)) * F.col("weight")).alias("score"))
    return score.groupBy("doc_id").agg(F.min_by("category", F.struct(-F.col("score"), F.col("place"))).alias("category"), F.max("score").alias("score"))


@query(f"SELECT source, doc_id, round(strong + 1.5 * markers + least(chars, 10000) / 10000.0 + 0.3 * exclam, 6) AS quality FROM ({_FEATURES}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(strong + 1.5 * markers + least(chars, 10000) / 10000.0 + 0.3 * exclam, 6) DESC, doc_id) <= 400")
def quality_topk(spark, sf_dir):
    quality = F.round(F.expr("strong + 1.5D * markers + least(chars, 10000) / 10000D + 0.3D * exclam"), 6)
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("quality"), "doc_id"))
    return _features(spark, sf_dir).select("source", "doc_id", quality.alias("quality")).withColumn("place", place).where("place <= 400").drop("place")


_TERM = f"SELECT source, w, count(DISTINCT doc_id) AS docs FROM ({_WORDS}) WHERE length(w) >= 5 GROUP BY ALL"


@query(f"SELECT source, arg_min(w, struct_pack(a := -t.docs, b := w)) AS term, max(t.docs) AS docs, round(max(t.docs) / any_value(n.docs), 6) AS share FROM ({_TERM}) t JOIN (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY ALL) n USING (source) GROUP BY source")
def dominant_term(spark, sf_dir):
    """The word that most documents of a source hold, and the share that does."""
    found = _split(table(spark, sf_dir, "documents"))
    term = found.select("source", "doc_id", F.explode_outer(F.array_distinct("ws")).alias("w")).where("length(w) >= 5").groupBy("source", "w").agg(F.countDistinct("doc_id").alias("docs"))
    best = term.groupBy("source").agg(F.min_by("w", F.struct(-F.col("docs"), F.col("w"))).alias("term"), F.max("docs").alias("docs"))
    total = found.groupBy("source").agg(F.countDistinct("doc_id").alias("all"))
    return best.join(total, "source").select("source", "term", "docs", F.round(F.col("docs") / F.col("all"), 6).alias("share"))


@query(f"SELECT source, round(avg(CASE WHEN markers > 0 THEN 1.0 ELSE 0 END), 6) AS share FROM ({_FEATURES}) GROUP BY source HAVING avg(CASE WHEN markers > 0 THEN 1.0 ELSE 0 END) >= 0.02")
def theme_share(spark, sf_dir):
    share = _features(spark, sf_dir).groupBy("source").agg(F.avg(F.when(F.col("markers") > 0, 1.0).otherwise(0.0)).alias("share"))
    return share.where("share >= 0.02").withColumn("share", F.round("share", 6))


@query("SELECT c_custkey, arg_min(name, km) AS city, round(min(km), 3) AS km FROM (SELECT c_custkey, name, 12742 * asin(sqrt(least(1, pow(sin(radians(la - lat) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lo - lon) / 2), 2)))) AS km FROM (SELECT c_custkey, c_custkey * 7 % 170 - 85 AS lat, c_custkey * 13 % 359 - 179 AS lon FROM customer) CROSS JOIN (VALUES " + ", ".join(map(str, CITIES)) + ") g(name, la, lo)) GROUP BY c_custkey")
def nearest_point(spark, sf_dir):
    """The nearest of a stated list of places, as an expression over the list: no join."""
    at = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey * 7 % 170 - 85 AS lat", "c_custkey * 13 % 359 - 179 AS lon")
    near = F.array_min(F.array(*[F.struct(T.haversine(F.col("lat"), F.col("lon"), F.lit(la), F.lit(lo)).alias("km"), F.lit(name).alias("city")) for name, la, lo in CITIES]))
    return at.select("c_custkey", near.alias("n")).select("c_custkey", "n.city", F.round("n.km", 3).alias("km"))


@query("WITH p AS (SELECT p_partkey, p_size, lower(regexp_extract(p_name, '[^ ]+$')) AS last, lower(left(p_name, 1)) AS initial FROM part) SELECT p_partkey, CAST(total AS BIGINT) AS total FROM p JOIN (SELECT last, initial, sum(p_size) AS total FROM p GROUP BY ALL) USING (last, initial)")
def join_name_key(spark, sf_dir):
    """Names joined on last name and first initial, one side spelled 'Last, First Jr.'; matches are summed before the join."""
    part = table(spark, sf_dir, "part")
    last = F.regexp_extract("p_name", "[^ ]+$", 0)
    mentions = part.select(T.person_key(F.concat(last, F.lit(", "), F.col("p_name"), F.lit(" Jr."))).alias("key"), "p_size")
    mentions = mentions.groupBy("key").agg(F.sum("p_size").alias("total"))
    return part.select("p_partkey", T.person_key(F.col("p_name")).alias("key")).join(mentions, "key").select("p_partkey", "total")


@query("SELECT place, p_partkey, p_name FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 8)) i(place, id) JOIN part ON p_partkey = id")
def join_reindex(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 999999999, 8)))).alias("place", "id"))
    return table(spark, sf_dir, "part").join(F.broadcast(ids), F.col("p_partkey") == F.col("id")).select("place", "p_partkey", "p_name")


@query("SELECT p_partkey, z[1] AS a, z[2] AS b FROM (SELECT p_partkey, unnest(list_zip(string_split(p_name, ' '), string_split(p_type, ' '))) AS z FROM part)")
def arrays_zip(spark, sf_dir):
    zipped = F.arrays_zip(F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(zipped).alias("z")).select("p_partkey", F.col("z")["a"].alias("a"), F.col("z")["b"].alias("b"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(unnest([0, 1])) AS start FROM events) GROUP BY ALL")
def sliding_hour(spark, sf_dir):
    """Windows of two hours that begin every hour."""
    found = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_rfc_date(spark, sf_dir):
    text = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit(" 00:00:00 GMT"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.rfc_date(text).alias("day"))


@query("SELECT c_custkey, CASE WHEN x >= 999995 THEN CAST((x + 5000) // 1000000 AS VARCHAR) || '.' || lpad(CAST((x + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || 'M' WHEN x >= 1000 THEN CAST((x + 5) // 1000 AS VARCHAR) || '.' || lpad(CAST((x + 5) // 10 % 100 AS VARCHAR), 2, '0') || 'K' ELSE CAST(x AS VARCHAR) END AS label FROM (SELECT c_custkey, c_custkey * c_custkey * 37 AS x FROM customer)")
def fmt_int(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.short_number(F.col("c_custkey") * F.col("c_custkey") * 37).alias("label"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'urgent' WHEN bool_or(o_orderpriority LIKE '2%') THEN 'high' ELSE 'other' END AS badge, list_sort(list(DISTINCT o_orderpriority)) AS keys FROM orders GROUP BY o_custkey")
def priority_badge(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("keys"))
    has = lambda p: F.exists("keys", lambda k: k.startswith(p))
    return keys.select("o_custkey", F.when(has("1"), "urgent").when(has("2"), "high").otherwise("other").alias("badge"), "keys")


@query("SELECT n_nationkey, round(exp(s) / sum(exp(s)) OVER (PARTITION BY n_regionkey), 9) AS share FROM (SELECT *, (0.7::DOUBLE * n_nationkey + 0.3::DOUBLE * (n_nationkey % 5) * 10 + 3 * (n_nationkey % 2)) / 10 AS s FROM nation)")
def blend_score(spark, sf_dir):
    """Weighted score, model share and adjustment blended, then a softmax over the field."""
    s = F.expr("(0.7D * n_nationkey + 0.3D * (n_nationkey % 5) * 10 + 3 * (n_nationkey % 2)) / 10")
    scored = table(spark, sf_dir, "nation").withColumn("e", F.exp(s))
    return scored.select("n_nationkey", F.round(F.col("e") / F.sum("e").over(W.partitionBy("n_regionkey")), 9).alias("share"))


@query("SELECT n_regionkey, to_json(list(struct_pack(nation := n_nationkey, name := n_name) ORDER BY n_nationkey)) AS artifact FROM nation GROUP BY n_regionkey")
def json_artifact(spark, sf_dir):
    own = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(own).alias("artifact"))


_MONTHLY = "SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ym) - 1 AS x, n FROM (SELECT o_orderpriority, year(o_orderdate) * 100 + month(o_orderdate) AS ym, count(*) AS n FROM orders GROUP BY ALL)"


@query(f"SELECT o_orderpriority, 'M' || string_agg(CAST(x * 4 AS VARCHAR) || ',' || CAST(y AS VARCHAR), ' L' ORDER BY x) AS path FROM (SELECT *, 40 - n * 40 // max(n) OVER (PARTITION BY o_orderpriority) AS y FROM ({_MONTHLY})) GROUP BY o_orderpriority")
def sparkline_path(spark, sf_dir):
    """An SVG path of each monthly series; only one number a month reaches the list."""
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    series = table(spark, sf_dir, "orders").groupBy("o_orderpriority", month.alias("ym")).agg(F.count("*").alias("n"))
    series = series.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("ym", "n"))).alias("s"), F.max("n").alias("top"))
    return series.selectExpr("o_orderpriority", "concat('M', array_join(transform(s, (p, i) -> concat(i * 4, ',', 40 - p.n * 40 div top)), ' L')) AS path")


@query("""WITH w AS (SELECT p_brand, w, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY ALL),
t AS (SELECT p_brand, string_agg(w, ' ' ORDER BY n DESC, w) AS words FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w) <= 5) GROUP BY p_brand),
s AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, words, max(n) AS n, list_sort(list(DISTINCT p_partkey)) AS samples FROM s JOIN t USING (p_brand) WHERE i = 1 OR i = n // 2 + 1 OR i = n GROUP BY ALL""")
def cluster_summary(spark, sf_dir):
    """The five commonest words of each cluster and its first, middle and last member."""
    part = table(spark, sf_dir, "part")
    counts = part.select("p_brand", F.explode(F.split("p_type", " ")).alias("w")).groupBy("p_brand", "w").agg(F.count("*").alias("n"))
    best = counts.withColumn("place", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("n"), "w"))).where("place <= 5")
    best = best.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("top"))
    group = W.partitionBy("p_brand")
    at = part.select("p_brand", "p_partkey", F.row_number().over(group.orderBy("p_partkey")).alias("i"), F.count("*").over(group).alias("n"))
    picked = at.where("i = 1 or i = n div 2 + 1 or i = n").groupBy("p_brand", "n").agg(F.array_sort(F.collect_set("p_partkey")).alias("samples"))
    return picked.join(best, "p_brand").select("p_brand", F.array_join("top.w", " ").alias("words"), "n", "samples")


@query()
def casefold_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.casefold_norm("text").alias("norm"))
