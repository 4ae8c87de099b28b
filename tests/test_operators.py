import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fanout, stats, vectors
from tessera.sources import io
from tessera.streaming import runs

PRICES = {"$1,250.00": 1250.0, "$95.00": 95.0, "$1,250": 1250.0, "$95": 95.0, "1,250.00": 1250.0, "1250": 1250.0, " $95.00 ": 95.0, "$0.00": 0.0, "$10,000.00": 10000.0, "$1,234,567.89": 1234567.89, "€95.00": 95.0, "£72.00": 72.0, "£10000": 10000.0, "": None, "null": None, "None": None, "nan": None, "abc": None, "$": None, "95d": None}


def test_parse_price(spark):
    df = spark.createDataFrame([(k,) for k in [*PRICES, None]], "s string").select("s", T.parse_price(F.col("s")).alias("p"))
    assert {r["s"]: r["p"] for r in df.collect()} == PRICES | {None: None}


def test_parse_odds(spark):
    df = spark.createDataFrame([("5-1",), ("5/2",), ("9:2",), ("7–1",), ("12",), ("x",), ("3-0",)], "s string").select(T.parse_odds(F.col("s")).alias("o"))
    assert [r["o"] for r in df.collect()] == [5.0, 2.5, 4.5, 7.0, 12.0, None, None]


def test_option_price_meets_closed_form(spark):
    row = stats.option_price(spark, 400_000, 50_000).first()
    d1 = (math.log(100 / 95) + (0.01 + 0.045)) / 0.3
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    exact = 100 * cdf(d1) - 95 * math.exp(-0.01) * cdf(d1 - 0.3)
    assert abs(row["price"] - exact) < 4 * row["stderr"]


def test_race_sim_is_monotone(spark):
    counts = {r["horse"]: r["n"] for r in stats.race_sim(spark, [8.0, 4.0, 1.0, 0.5], 40_000, 10_000).where("place = 1").collect()}
    assert sum(counts.values()) == 40_000 and counts[0] > counts[1] > counts[2] > counts[3]


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).cast("double").alias("v"))
    a = stats.bootstrap_ci(df, "g", "v").orderBy("bucket").collect()
    b = stats.bootstrap_ci(df.repartition(7), "g", "v").orderBy("bucket").collect()
    assert a == b and all(r["ci_low"] <= r["median"] <= r["ci_high"] for r in a)


def test_bootstrap_meets_resampling(spark):
    """The interval by ranks against a plain bootstrap of the rows."""
    rng = np.random.default_rng(1)
    rows = [("even", float(x)) for x in rng.normal(size=300)] + [("odd", float(x)) for x in rng.exponential(size=201)] + [("few", 3.0)] * 3 + [("none", None)]
    got = {r["bucket"]: r for r in stats.bootstrap_ci(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for name in ("even", "odd"):
        v = np.array([x for g, x in rows if g == name])
        plain = np.percentile(np.median(v[rng.integers(0, len(v), (4000, len(v)))], axis=1), (2.5, 97.5))
        assert np.allclose([got[name]["ci_low"], got[name]["ci_high"]], plain, atol=0.06) and got[name]["median"] == np.median(v)
    assert got["few"]["ci_low"] == got["few"]["ci_high"] == 3.0 and got["none"]["n"] == 0 and got["none"]["median"] is None


def test_verdicts(spark):
    kind = "bucket string, n long, ci_low double, ci_high double"
    apart = [("a", 200, 0.0, 1.0), ("b", 200, 2.0, 3.0)]
    assert stats.ci_verdict(spark.createDataFrame(apart, kind)).first()["verdict"] == "accepted"
    assert stats.ci_verdict(spark.createDataFrame([*apart, ("c", 200, 0.5, 2.5)], kind)).first()["verdict"] == "rejected"
    assert stats.ci_verdict(spark.createDataFrame(apart[:1], kind)).first()["reason"] == "single bucket"


def test_random_pick_expectation():
    fields = [np.eye(n) for n in (5, 5, 5, 4)]
    assert sum(stats.POINTS.sum() / len(f) for f in fields) == pytest.approx(15.3)


def test_knn_prefix(spark, small):
    own = spark.read.parquet(f"{small}/embeddings.parquet")
    some = own.where("vec_id < 5")
    five = vectors.knn(own, some, 5, block=2).orderBy("vec_id", "place").collect()
    three = vectors.knn(own, some, 3).orderBy("vec_id", "place").collect()
    assert [tuple(r) for r in five if r["place"] <= 3] == [tuple(r) for r in three]


def test_fanout(spark):
    def work(task):
        if task["id"] == 3:
            raise ValueError("no")
        return {"id": task["id"], "y": task["id"] * 2}

    rows = {r["id"]: r for r in fanout.parallel_map(spark.range(6), work, "id long, y long", 2).collect()}
    assert rows[2]["y"] == 4 and rows[None]["error"] == "ValueError: no" and len(rows) == 6
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 5

    assert fanout.with_backoff(flaky, sleep=lambda s: None) == 5
    assert fanout.run_process(["cat"], "abc") == "abc"
    budget = fanout.Budget(10)
    budget.add("a", 16)
    assert budget.warned
    with pytest.raises(RuntimeError):
        budget.add("b", 9)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "Id int, v string")
    assert io.resolve_column(df, ["key", "id"]) == "Id"
    with pytest.raises(KeyError):
        io.require_columns(df, ["x"])
    more = io.insert_ignore(df, spark.createDataFrame([(2, "z"), (3, "c"), (3, "c")], "Id int, v string"), "Id")
    assert sorted(map(tuple, more.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert [r["a"] for r in io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for inputs in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert io.once(spark, str(tmp_path / "t"), inputs, build).count() == 3
    assert len(built) == 2


def test_stream_equals_batch(spark, small, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    stream = runs.events_stream(spark, str(tmp_path))
    got = runs.drain(runs.running_totals(stream), "totals", str(tmp_path / "ck"))
    want = runs.running_totals(spark.read.parquet(f"{small}/events.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_isolation_and_twins_ask_every_vector(spark, tmp_path):
    """The loneliest vector and a pair of twins have ids that 20 doesn't divide."""
    from tessera import plans

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8) * 0.05 + np.eye(8)[0], "a") for i in range(60)]
    rows[7] = (7, -np.eye(8)[0], "a")
    rows += [(101 + i, np.eye(8)[1] + 0.01 * i * np.eye(8)[2], "a") for i in range(5)]
    rows.append((113, np.eye(8)[1] * 0.4 + np.eye(8)[3] * math.sqrt(1 - 0.16), "b"))
    df = spark.createDataFrame([(i, [float(x) for x in v], g) for i, v, g in rows], "vec_id long, embedding array<float>, label string")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert plans.QUERIES["knn_isolation"](spark, str(tmp_path)).first()["vec_id"] == 7
    names, vecs, labels = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float), [r[2] for r in rows]
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    similar = vecs @ vecs.T
    np.fill_diagonal(similar, -2)
    want = {tuple(sorted((names[i], names[j]))) for i in range(len(rows)) for j in np.argsort(-similar[i])[:7] if labels[i] != labels[j] and 0.3 <= similar[i, j] <= 0.5}
    got = {(r["a"], r["b"]) for r in plans.QUERIES["hidden_twins"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 5 and all(a % 20 and b % 20 for a, b in want)


def test_word_stats_and_signals(spark):
    from tessera.operators import scoring as S

    rows = [(1, "You IDIOT! Stupid, STUPID loser!!", 5), (2, None, 5), (3, "", 4), (4, "don't 123", 5), (5, "word " * 90 + "clown", 1)]
    own = S.with_word_stats(spark.createDataFrame(rows, "id int, text string, rating int"))
    got = {r["id"]: r for r in own.withColumn("score", S.lexicon_score()).collect()}
    assert [got[1][c] for c in ("words", "strong", "medium", "mild", "caps_ratio", "exclam")] == [5, 1, 3, 0, 0.4, 3]
    assert got[1]["score"] == round(3 + 4.5 + 6 * 0.4 + 0.08 * 3, 3) and got[2]["words"] == got[3]["words"] == 0 and got[4]["words"] == 1
    top = {(r["signal"], r["id"]): r["score"] for r in S.topk_signals(own.withColumn("g", F.lit("x")), "g", "id", S.signals(), 2).collect()}
    assert top["short", 1] == 2.0 and top["five_star_obscene", 1] == 6.6 and top["five_star_one_word", 2] == 1.0 and top["rant", 5] == 1.1375
    assert ("five_star_one_word", 3) not in top and top["exclamation", 1] == 3.0 and abs(top["screaming", 1] - 0.4 * 5**0.5) < 1e-6


def test_category_filters(spark):
    from tessera.operators import scoring as S

    rows = [("a", "a clown fish, you idiot"), ("a", "a clown and an id*t"), ("src2", "trash, I hate this trash"), ("a", "M***** C**** id*t"), ("a", "stupid"), ("a", None)]
    own = spark.createDataFrame(rows, "g string, text string").withColumn("hits", S.category_hits(F.col("text")))
    got = [[(h["word"], h["n"]) for h in r["kept"]] for r in own.select(S.filter_hits(F.col("hits"), F.col("text"), F.col("g")).alias("kept")).collect()]
    assert got == [[("idiot", 1)], [("idiot*", 1)], [], [], [], []]
    assert [r[0] for r in own.select(S.severity(F.col("hits"))).collect()][:2] == [4.0, 4.0]
    assert [r[0] for r in own.select(S.context(F.col("text"))).collect()][0] == "deploy"


def test_rerank_follows_its_order(spark):
    from tessera.operators import scoring as S

    hits = F.array(F.struct(F.lit("insult").alias("category"), F.lit("idiot").alias("word"), F.lit(2).alias("n")))
    score = lambda **x: spark.range(1).select(S.rerank(hits, F.lit(x.get("text", "")), F.lit(x.get("context", "deploy")), F.lit(x.get("group", "g")), F.lit(x.get("rating", 3)), F.lit(x.get("words", 50)), F.lit(0.1), F.lit(2))).first()[0]
    assert score() == 50 * 1.5 + 1 + 0.3 and score(group="src2") == 75 * 1.4 + 4 + 1.3 and score(group="src1") == round(75 * 0.6 + 1.3, 3)
    assert score(rating=1) == round(75 * 1.15 + 8 + 1.3, 3) and score(words=5) == round(76.3 / 2, 3) and score(text="a novel, broken") == round(75 * 0.3 + 1.4 + 1.3, 3)


def test_spam(spark):
    from tessera.operators import scoring as S

    rows = ["", None, "no no", "crap crap crap", "a b c d", "x " * 8 + "a b c d e f g", " ".join(f"part {i % 3} of one long line;" for i in range(20))]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(S.is_spam(F.col("t")), S.is_spam(F.col("t"), True)).collect()
    assert [r[0] for r in got] == [True, True, False, True, False, True, False] and got[-1][1] and not got[4][1]


def test_funnel(spark):
    from tessera.operators import scoring as S

    scored = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "id int, score double")
    vectors = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(40)], "id int, v array<double>")
    got = S.funnel(scored, vectors, "id", "v", first=30, clusters=3, last=12).collect()
    assert len(got) == 12 and [r["combined"] for r in got] == sorted((r["combined"] for r in got), reverse=True)
    assert {r["cluster_rank"] for r in got} <= {1, 2, 3} and all(abs(r["combined"] - r["score"] + 0.1 * r["cluster_rank"]) < 1e-9 for r in got)
    assert S.funnel(scored.where("false"), vectors, "id", "v").count() == 0


def test_trees_and_models():
    from tessera.operators import models as M

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    half = np.arange(600) < 400
    loss = lambda p: float(-np.log(np.clip(np.where(y[~half] == 1, p, 1 - p), 1e-6, 1)).mean())
    for setting, least in (({"model": "gbm", "trees": 100, "depth": 3, "rate": 0.1, "share": 0.9}, 0.3), ({"model": "rf", "trees": 60, "columns": "sqrt", "depth": None}, 0.45)):
        assert loss(M.fit_predict(setting, x[half], y[half], x[~half])) < least
    z = (x[:, 2] + 0.2 * rng.normal(size=600) > 0).astype(int)
    for penalty in ("l1", "l2"):
        p = M.fit_predict({"model": "logreg", "c": 100.0, "penalty": penalty, "solver": "full"}, x[half], z[half], x[~half])
        assert ((p > 0.5) == z[~half]).mean() > 0.88
    tree = M.grow(M.binned(x, [np.array([0.0])] * 3), np.where(x[:, 0] > 0, -1.0, 1.0), np.ones(600), 1, 3, rng)
    assert tree["column"][0] == 0 and len(M.grid()) == 164
    assert (M.fit_predict(M.grid()[0], x[:3], np.ones(3, int), x[:5]) == 1).all()


def test_grid(spark):
    from tessera.operators import models as M

    rows = spark.range(800).select("id", (F.col("id") % 17 / 17).alias("a"), (F.col("id") % 5).alias("b")).withColumn("label", (F.col("a") > 0.5).cast("int"))
    settings = [M.grid()[i] for i in (0, 110, 150)]
    found, ensemble = M.run_grid(rows, "id", ["a", "b"], "label", F.col("id") % 4 == 0, settings, most=200, best=2)
    losses = [r["log_loss"] for r in found.orderBy("log_loss").collect()]
    assert len(losses) == 3 and losses[0] < 0.2 and ensemble.count() == 200 and ensemble.where("(p > 0.5) <> (label = 1)").count() == 0


def test_fields_and_null(spark):
    rows = [(g, k, float(k * (g + 1)), 1.0, (g * 7 + k) % 5) for g in range(3) for k in range(9)]
    found, winners = stats.fields(spark.createDataFrame(rows, "g int, k int, a double, b double, w int"), "g", "k", ["a", "b"], "a", "w", 6)
    assert [f.shape for f in found] == [(6, 2)] * 3 and all(f[:, 0].min() == 0 and f[:, 0].max() == 1 and (f[:, 1] == 0.5).all() for f in found)
    null = stats.permutation_null(spark, found, winners, n=300, weights=50).first()
    assert null["n"] == 300 and 0 <= null["p_value"] <= 1 and null["expected"] == 9.0 and null["null_mean"] >= null["expected"] - 1


def test_inverted_file(spark, small):
    """All rows are indexed, hot cells are split, and at least nine of ten exact neighbours are found."""
    own = spark.read.parquet(f"{small}/embeddings.parquet")
    some = own.where("vec_id % 20 = 0")
    exact = vectors.knn(own, some, 5)
    assert vectors.recall(vectors.knn_inverted(own, some, 5), exact) >= 0.9
    everything = vectors.knn_inverted(own, some, 5, cells=4, probes=4, group=7)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    assert vectors.knn_inverted(own.where("false"), some, 5).count() == 0 == vectors.knn_inverted(own, some.where("false"), 5).count()


def test_inverted_file_recall(spark):
    """The given vectors of a larger table, without a fixed cell number."""
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    some = own.where("vec_id % 20 = 0")
    assert vectors.recall(vectors.knn_inverted(own, some, 5), vectors.knn(own, some, 5)) >= 0.9


def test_weight_search_finds_the_best(spark):
    """The search against every weighting by hand."""
    rng = np.random.default_rng(2)
    fields, winners = [rng.random((6, 3)) for _ in range(4)], [0, 3, 5, 2]
    found = stats.weight_search(spark, fields, winners, n=60, chunk=20, keep=3, seed=9).collect()
    worth = []
    for k in range(3):
        for w in np.random.default_rng(9 + k).dirichlet(np.ones(3), 20):
            places = [sorted(range(6), key=lambda i, f=f, w=w: -f[i] @ w).index(x) for f, x in zip(fields, winners, strict=True)]
            worth.append(sum((10, 5, 2, 1, 0, 0)[p] for p in places))
    assert [r["points"] for r in found] == sorted(worth, reverse=True)[:3]
