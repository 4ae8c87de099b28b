"""Composite queries: series, vectors, statistics, simulations and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import relational as R
from ..operators import series as S
from ..operators import stats as X
from ..operators import vectors as V

_SERIES = """WITH c AS (SELECT l_suppkey AS key, year(l_shipdate) * 100 + month(l_shipdate) AS ym, count(*) AS n FROM lineitem GROUP BY 1, 2),
d AS (SELECT k.key, m.ym, coalesce(c.n, 0) AS n, row_number() OVER (PARTITION BY k.key ORDER BY m.ym) - 1 AS i, count(*) OVER (PARTITION BY k.key) AS months
      FROM (SELECT DISTINCT key FROM c) k CROSS JOIN (SELECT DISTINCT ym FROM c) m LEFT JOIN c ON c.key = k.key AND c.ym = m.ym),
e AS (SELECT *, min(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY key) AS start FROM d),
f AS (SELECT key, max(n) AS peak, arg_min(ym, struct_pack(a := -n, b := ym)) AS peak_ym, arg_min(i, struct_pack(a := -n, b := ym)) AS peak_i, min(n) AS trough,
      arg_min(ym, struct_pack(a := n, b := ym)) AS trough_ym, arg_min(i, struct_pack(a := n, b := ym)) AS trough_i, count(*) FILTER (n > 0) AS active, CAST(sum(n) AS BIGINT) AS total, count(*) AS months,
      round(avg(n) FILTER (i >= months - 12), 6) AS recent, round(avg(n) FILTER (i >= start AND i < start + 24), 6) AS birth FROM e GROUP BY key)"""
_CLASS = "CASE WHEN peak < 10 OR active < 36 THEN 'minor' WHEN recent / peak < 0.35 THEN 'ghost' WHEN recent / nullif(birth, 0) >= 4 AND birth < 1000 AND recent >= 2 THEN 'emergent' WHEN recent / peak < 0.7 THEN 'cooling' WHEN recent / nullif(birth, 0) >= 1.5 THEN 'warming' ELSE 'stable' END"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.features(S.monthly(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate"), "l_suppkey", "l_shipdate"))


@query(_SERIES + " SELECT * FROM f")
def series_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(_SERIES + f" SELECT key, s_name, n_name, peak, recent, {_CLASS} AS class FROM f JOIN supplier ON key = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def series_class(spark, sf_dir):
    found = _features(spark, sf_dir).withColumn("class", S.series_class(10, 2))
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return found.join(where, F.col("key") == F.col("s_suppkey")).select("key", "s_name", "n_name", "peak", "recent", "class")


@query(_SERIES + " SELECT key, peak, round(recent / peak, 6) AS ratio FROM f WHERE peak >= 10 AND active >= 36 ORDER BY ratio, peak DESC, key LIMIT 12")
def rank_ghosts(spark, sf_dir):
    f = _features(spark, sf_dir).where("peak >= 10 and active >= 36")
    return f.select("key", "peak", F.round(F.col("recent") / F.col("peak"), 6).alias("ratio")).orderBy("ratio", F.desc("peak"), "key").limit(12)


@query(_SERIES + " SELECT key, round(recent / birth, 6) AS growth FROM f WHERE birth >= 1 AND birth <= 2000 AND recent >= 2 ORDER BY growth DESC, key LIMIT 12")
def rank_emergents(spark, sf_dir):
    f = _features(spark, sf_dir).where("birth >= 1 and birth <= 2000 and recent >= 2")
    return f.select("key", F.round(F.col("recent") / F.col("birth"), 6).alias("growth")).orderBy(F.desc("growth"), "key").limit(12)


@query(_SERIES + " SELECT key, peak_ym, trough_ym FROM f WHERE peak_i < trough_i AND trough <= 0.2 * peak AND trough_i < months - 6 ORDER BY key LIMIT 12")
def rank_resurrected(spark, sf_dir):
    return _features(spark, sf_dir).where("peak_i < trough_i and trough <= 0.2 * peak and trough_i < months - 6").select("key", "peak_ym", "trough_ym").orderBy("key").limit(12)


@query("SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-01', INTERVAL 1 MONTH)) AS DATE) AS month")
def month_calendar(spark, sf_dir):
    from ..sources.io import months

    return spark.range(1).select(months(F.lit("1995-01-15").cast("date"), F.lit("1995-12-20").cast("date")).alias("month"))


# -- vectors


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(e, e), 5).alias("squared"), F.round(F.get(V.l2_normalize(e), F.lit(0)), 6).alias("first"))


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q")
def cosine_sim(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    first = own.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return own.crossJoin(F.broadcast(first)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


_KNN = """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS place FROM p)"""


def _neighbours(spark, sf_dir, k):
    own = table(spark, sf_dir, "embeddings")
    return V.knn(own, own.where("vec_id % 20 = 0"), k)


@query(_KNN + " SELECT vec_id, neighbour, CAST(place AS BIGINT) AS place, round(s, 6) AS sim FROM r WHERE place <= 5")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5).select("vec_id", "neighbour", F.col("place").cast("long").alias("place"), F.round("similarity", 6).alias("sim"))


# knn_topk and semantic_topk_distinct are searches and ask for the ids divisible by 20; isolation and twins need every vector.
_KNN_ALL = """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS place FROM p)"""


@query()
def knn_inverted(spark, sf_dir):
    """knn_topk by an inverted file: not exact, and its recall is tested."""
    own = table(spark, sf_dir, "embeddings")
    return V.knn_inverted(own, own.where("vec_id % 20 = 0"), 5).select("vec_id", "neighbour", F.col("place").cast("long").alias("place"), F.round("similarity", 6).alias("sim"))


@query(_KNN_ALL + " SELECT vec_id, round(s, 6) AS sim FROM r WHERE place = 5 ORDER BY s, vec_id LIMIT 24")
def knn_isolation(spark, sf_dir):
    """The 24 loneliest of all vectors."""
    own = table(spark, sf_dir, "embeddings")
    return V.isolation(V.knn(own, own, 5), 5).orderBy("similarity", "vec_id").limit(24).select("vec_id", F.round("similarity", 6).alias("sim"))


@query(_KNN_ALL + " SELECT least(vec_id, neighbour) AS a, greatest(vec_id, neighbour) AS b, round(max(s), 6) AS sim FROM r WHERE place <= 7 AND la <> lb AND s BETWEEN 0.3 AND 0.5 GROUP BY 1, 2")
def hidden_twins(spark, sf_dir):
    """Twins among all vectors."""
    own = table(spark, sf_dir, "embeddings")
    return V.twins(V.knn(own, own, 7), own.select("vec_id", "label"), 0.3, 0.5).select("a", "b", F.round("similarity", 6).alias("sim"))


@query(_KNN + " SELECT vec_id, lb AS label, round(s, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, lb ORDER BY s DESC, neighbour) AS k FROM r WHERE place <= 50) WHERE k = 1")
def semantic_topk_distinct(spark, sf_dir):
    about = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("neighbour"), "label")
    both = _neighbours(spark, sf_dir, 50).join(about, "neighbour")
    first = F.row_number().over(W.partitionBy("vec_id", "label").orderBy(F.desc("similarity"), "neighbour"))
    return both.withColumn("k", first).where("k = 1").select("vec_id", "label", F.round("similarity", 6).alias("sim"))


@query()
def kmeans(spark, sf_dir):
    """Clusters of the embeddings: fitted on a bounded sample, assigned to all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    n = own.count()
    model = KMeans(k=10, seed=42, maxIter=20).fit(own.sample(min(1.0, 300_000 / max(n, 1)), seed=42))
    return model.transform(own).select("vec_id", "label", "prediction")


@query("SELECT * FROM (SELECT * FROM (SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 400) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) <= 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 40")
def variety_cap(spark, sf_dir):
    """Greedy in score order: at most 2 rows per (lang, source) and 40 per lang among the top 400."""
    order = [F.desc("n_chars"), "doc_id"]
    top = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").orderBy(*order).limit(400)
    return R.variety_cap(top, "lang", "source", order, 2, 40)


# -- statistics

_EDGES = "SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM documents"


@query(f"SELECT doc_id, CASE WHEN n_chars <= e[1] THEN 'q1' WHEN n_chars <= e[2] THEN 'q2' WHEN n_chars <= e[3] THEN 'q3' ELSE 'q4' END AS bucket FROM documents, ({_EDGES})")
def quantile_bucket(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    edges = R.quantiles(own, [], "n_chars", (0.25, 0.5, 0.75), ("a", "b", "c")).select(F.array_distinct(F.array("a", "b", "c")).alias("e"))
    return own.crossJoin(F.broadcast(edges)).select("doc_id", X.quantile_bucket(F.col("n_chars"), F.col("e"), ("q1", "q2", "q3", "q4")).alias("bucket"))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    at = (5, 25, 50, 75, 95)
    found = R.quantiles(table(spark, sf_dir, "events"), "event_type", "value", [p / 100 for p in at], [f"p{p}" for p in at])
    return found.select("event_type", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in at])


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS lo, round(quantile_cont(value, 0.5), 4) AS mid, max(value) AS hi FROM events")
def describe_stats(spark, sf_dir):
    v, own = "value", table(spark, sf_dir, "events")
    rest = own.agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return rest.crossJoin(R.quantiles(own, [], v, [0.5], ["mid"]).select(F.round("mid", 4).alias("mid"))).select("n", "mean", "std", "lo", "mid", "hi")


@query()
def bootstrap_ci(spark, sf_dir):
    return X.bootstrap_ci(table(spark, sf_dir, "events"), "event_type", "value")


@query()
def option_price(spark, sf_dir):
    return X.option_price(spark)


@query()
def race_sim(spark, sf_dir):
    return X.race_sim(spark, [8.0, 6.5, 5.0, 4.0, 3.0, 2.0, 1.0])


def _fields(spark: SparkSession, sf_dir: str) -> tuple[list[np.ndarray], list[int]]:
    """Each year's field: its 20 customers of the largest sums, by sum, orders, mean and largest order; the winner is the one
    with the latest order. So a field a year, of at most 20 rows."""
    own = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("group"), F.col("o_custkey").alias("key"))
    price = F.col("o_totalprice")
    own = own.agg(F.sum(price).alias("a"), F.count("*").cast("double").alias("b"), F.avg(price).alias("c"), F.max(price).alias("d"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return X.fields(own, "group", "key", ["a", "b", "c", "d"], "a", "last", 20)


@query()
def dirichlet_search(spark, sf_dir):
    return X.weight_search(spark, *_fields(spark, sf_dir))


@query()
def permutation_null(spark, sf_dir):
    return X.permutation_null(spark, *_fields(spark, sf_dir))


@query()
def model_grid(spark, sf_dir):
    """Hold-out log loss of 164 settings of three kinds of classifiers."""
    return _grid(spark, sf_dir)[0]


@query()
def model_ensemble(spark, sf_dir):
    """Mean chances of the five best settings for the hold-out rows."""
    return _grid(spark, sf_dir)[1]


def _grid(spark, sf_dir):
    from ..operators import models as M

    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), "o_totalprice", (F.col("o_custkey") % 100).alias("c"), F.year("o_orderdate").alias("y"))
    return M.run_grid(own, "o_orderkey", ["o_totalprice", "c", "y"], "label", F.col("y") >= 1999, most=600)
