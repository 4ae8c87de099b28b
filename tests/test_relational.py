"""Relational operators on tables of their own, with nulls, ties and no rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R

ROWS = [("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 4, 1.0), (None, 5, 2.0), (None, 6, None), ("c", 7, 9.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, id long, x double").repartition(3).cache()


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_best_rows_per_key(df):
    order = [F.desc_nulls_last("x"), "id"]
    assert got(R.topk_per_group(df, "k", order, 1).select("k", "id")) == got_rows([("a", 2), ("b", 4), (None, 5), ("c", 7)])
    assert got(R.topk_per_group(df, "k", order, 2, "at").select("k", "id", "at").where("k = 'a'")) == [("a", 2, 1), ("a", 3, 2)]
    assert got(R.latest_per_key(df, ["k"], ["id"]).select("id")) == [(3,), (4,), (6,), (7,)]
    assert R.topk_per_group(df.where("false"), "k", order, 1).count() == 0


def got_rows(rows):
    return sorted(rows, key=repr)


def test_global_top(df):
    assert [r["id"] for r in R.topk_global(df, [F.desc("x"), "id"], 3).collect()] == [7, 2, 3]
    best = R.best_per_key_topk(df, "k", [F.desc_nulls_last("x"), "id"], [F.desc_nulls_last("x"), "id"], 2, "n", 100)
    assert [(r["id"], r["n"]) for r in best.orderBy("n").collect()] == [(7, 100), (2, 101)]
    assert got(R.topk_union(df, ["id"], [["id"], [F.desc("id")]], 2)) == [(1,), (2,), (6,), (7,)]
    assert got(R.topk_or_forced(df, "k", ["id"], 1, F.col("x") == 7).select("id")) == [(1,), (2,), (3,), (4,), (5,), (7,)]


def test_merges(spark, df):
    a = spark.createDataFrame([(1, 0.5, "a"), (2, None, "a"), (3, 0.1, "a")], "k long, score double, origin string")
    b = spark.createDataFrame([(1, 0.5, "b"), (2, 0.0, "b"), (4, 0.9, "b")], "k long, score double, origin string")
    assert got(R.merge_keep_best([b, a], "k", "score")) == [(1, 0.5, "a"), (2, 0.0, "b"), (3, 0.1, "a"), (4, 0.9, "b")]
    first = R.priority_merge([b.drop("origin"), a.drop("origin")], "k")
    assert got(first) == [(1, 0.5, 1), (2, 0.0, 1), (3, 0.1, 2), (4, 0.9, 1)]
    blocked = spark.createDataFrame([("a", 9), (None, 1)], "key string, n int")
    assert got(R.blocklist(df, blocked, [("k", "key")]).select("id")) == [(4,), (5,), (6,), (7,)]


def test_places(spark, df):
    assert [r["id"] for r in R.numbered(df, [F.desc_nulls_last("x"), "id"]).orderBy("place").collect()] == [7, 2, 3, 1, 5, 4, 6]
    pinned = R.pin_first(df, "id", [6, 1], ["id"])
    assert [(r["id"], r["place"]) for r in pinned.orderBy("place").collect()] == [(i, p) for p, i in enumerate([6, 1, 2, 3, 4, 5, 7], 1)]
    many = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("id"))
    assert R.numbered(many, ["id"]).where("place <> id + 1").count() == 0 and R.numbered(many.where("false"), ["id"]).count() == 0


def test_samples_and_calendars(spark, df):
    one = got(R.hash_sample(df, "id", 3).select("id"))
    assert one == got(R.hash_sample(df.repartition(5), "id", 3).select("id")) and len(one) == 3
    n = spark.createDataFrame([("a", 1, 4)], "k string, m int, n long")
    keys, steps = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([(1,), (2,)], "m int")
    assert got(R.densify(n, keys, steps, {"n": 0})) == [("a", 1, 4), ("a", 2, 0), ("b", 1, 0), ("b", 2, 0)]
    assert got(R.with_counts(spark.createDataFrame([("a",), ("z",)], "k string"), [(df, "k", "n")], "k")) == [("a", 3), ("z", 0)]


def test_shares(df):
    assert got(R.share_of_total(df, "k")) == got_rows([("a", 3, 42.86), ("b", 1, 14.29), ("c", 1, 14.29), (None, 2, 28.57)])
    assert got(R.dominant(df, "k", "x").where("k = 'a'")) == [("a", 7.0, 2, 3)]
    assert got(R.fold_small(df, "k", 2).select("id", "grp")) == [(1, "a"), (2, "a"), (3, "a"), (4, "other"), (7, "other")]
    assert got(R.cumulative_share(df.where("k = 'a'"), "k", "id").select("id", "cum_pct")) == [(1, 33.3333), (2, 66.6667), (3, 100.0)]
    place = R.position_matrix(df.where("k = 'a'").withColumn("at", F.col("id")), "k", "at").first()
    assert (place["n"], place["at_1"], round(place["pct_2"], 3), place["pct_3"]) == (3, 1, 66.667, 100.0)


def test_scales(spark, df):
    some = df.where("x is not null")
    assert {r["id"]: r["norm"] for r in R.min_max(some, "x").collect()}[7] == 10.0
    assert {r["norm"] for r in R.min_max(some.withColumn("x", F.lit(3.0)), "x").collect()} == {5.0}
    assert abs(sum(r["p"] for r in R.softmax(some, "x", 2).collect()) - 1) < 1e-6
    ranks = R.rank_average(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v double"), "v")
    assert got(ranks) == [(1.0, 3.0), (2.0, 1.5), (2.0, 1.5)]
    sets = R.grouping_sets(df, [["k"], []], F.count("*").alias("n"))
    assert (None, 7) in got(sets) and ("a", 3) in got(sets)


def test_head_per_file(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert got(R.head_per_file(spark.read.parquet(str(tmp_path / "t")), 2).select("id")) == [(0,), (1,), (10,), (11,)]


def test_sessions(spark):
    rows = [("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 00:30:00", 2), ("u", "2024-01-01 01:00:01", 3), ("v", "2024-01-01 00:00:00", 4)]
    own = spark.createDataFrame(rows, "u string, s string, id int").withColumn("ts", F.col("s").cast("timestamp"))
    assert sorted((r["u"], r["n"]) for r in R.sessions(own, "u", "ts", "id", "30 minutes").collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_quantiles(spark):
    """Against numpy: hot values, ties, one row, nulls, few keys over many ranges, a share of its own for each key."""
    import random

    import numpy as np

    rng = random.Random(7)
    rows = [("hot", rng.choice([1.0, 2.0, 2.0, 9.5])) for _ in range(3000)] + [("wide", rng.random()) for _ in range(2001)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(8)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    found = {r["k"]: list(r)[1:] for r in R.quantiles(df, "k", "x", shares, [f"q{i}" for i in range(6)]).collect()}
    for key in ("hot", "wide", "one", None):
        assert np.allclose(found[key], np.quantile([x for k, x in rows if k == key and x is not None], shares))
    assert "none" not in found and np.allclose(list(R.quantiles(df, [], "x", [0.3], ["q"]).first()), np.quantile([x for _, x in rows if x is not None], 0.3))
    own = spark.createDataFrame([("hot", 0.2), ("wide", 0.7)], "k string, s double")
    got = {r["k"]: r["q"] for r in R.quantiles(df, "k", "x", ["s"], ["q"], own).collect()}
    assert all(abs(got[k] - np.quantile([x for j, x in rows if j == k], s)) < 1e-9 for k, s in (("hot", 0.2), ("wide", 0.7)))
    assert R.quantiles(df.where("false"), "k", "x", [0.5], ["q"]).count() == 0


def test_tiles(spark):
    from pyspark.sql import Window as W

    df = spark.range(0, 1003, 1, 6).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).alias("v")).unionByName(spark.createDataFrame([(-1, None, 5), (-2, None, 6)], "id long, k long, v long"))
    want = df.select("id", F.ntile(4).over(W.partitionBy("k").orderBy("v", "id")).alias("t"))
    assert got(R.ntile(df, "k", ["v", "id"], 4, "t").select("id", "t")) == got(want)


def test_variety_cap_is_greedy(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.random()) for i in range(60)]
    seen, kept = {}, []
    for i, g, h, v in sorted(rows, key=lambda r: -r[3]):
        if seen.get((g, h), 0) < 2 and seen.get(g, 0) < 5:
            seen[g, h], seen[g] = seen.get((g, h), 0) + 1, seen.get(g, 0) + 1
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, g string, h string, v double")
    assert sorted(r["id"] for r in R.variety_cap(df, "g", "h", [F.desc("v")], 2, 5).collect()) == sorted(kept)
