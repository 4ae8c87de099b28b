"""Reports on tables small enough to check by hand."""

import datetime
import math

from pyspark.sql import functions as F

from tessera.operators import reports as P


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_owners(spark):
    rows = [("tulips", "nl", 1800), ("tulips", "de", 200), ("fjord", "no", 900), ("beer", "us", 1400), ("beer", "de", 900), ("beer", "be", 300), ("cat", "us", 9000), ("rain", "us", 1500), ("rain", "gb", 1500)]
    counts = spark.createDataFrame(rows, "phrase string, owner string, n long")
    assert got(P.monopolies(counts, "phrase", "owner").select("phrase", "owner", "share")) == [("tulips", "nl", 0.9)]
    assert got(P.concept_owners(counts, "phrase", "owner", ["us"], least_total=2500).select("phrase", "owner")) == [("beer", "de"), ("rain", "gb")]


def test_places(spark):
    rows = [("kyoto", "temple", 400), ("kyoto", "kyoto", 900), ("kyoto", "rare", 700), ("rome", "temple", 100), ("rome", "pasta", 1900), ("tiny", "pasta", 5)]
    counts, places = spark.createDataFrame(rows, "city string, phrase string, n long"), spark.createDataFrame([("kyoto",), ("rome",)], "name string")
    assert got(P.monocultures(counts, "city", "phrase", least_global=500, places=places).select("city", "phrase")) == [("kyoto", "rare"), ("rome", "pasta")]
    assert got(P.theme_shares(counts.withColumn("phrase", F.when(F.col("phrase") == "rare", "old temple").otherwise(F.col("phrase"))), "city", "phrase", ["temple"])) == [("kyoto", 0.55), ("rome", 0.05)]
    assert got(P.capital_dominance(counts.withColumnRenamed("city", "country").withColumnRenamed("phrase", "city"), "country", "city", least=1900)) == [("kyoto", "kyoto", 0.45), ("rome", "pasta", 0.95)]


def test_trends(spark):
    day = datetime.date
    rows = [("old", day(2010, 3, 1))] * 20 + [("old", day(2011, 3, 1))] * 20 + [("old", day(2022, 3, 1))] * 12
    rows += [("new", day(2023, 6, 1))] * 40 + [("new", day(2019, 6, 1))] * 5 + [("new", day(2018, 6, 1))] * 5 + [("small", day(2010, 1, 1))] * 9
    found = {r["c"]: r for r in P.trends(spark.createDataFrame(rows, "c string, d date"), "c", "d", "2024-01-15").collect()}
    assert set(found) == {"old", "new"}
    assert (found["old"]["peak_year"], found["old"]["peak"], found["old"]["decline"], found["old"]["burst"]) == (2010, 20, 0.12, None)
    assert found["new"]["decline"] is None and found["new"]["burst"] == 0.8 and found["new"]["recent24"] == 40


def test_calendar(spark):
    first = datetime.date(2024, 1, 1)  # a Monday
    rows = [(1, first + datetime.timedelta(i), i % 2 == 0, 100.0 + i, "s1") for i in range(7)] + [(1, first, False, 50.0, "s2"), (2, first, True, None, "s1")]
    summary = P.calendar_summary(spark.createDataFrame(rows, "id long, day date, free boolean, price double, snap string"), ["id", "snap"], "day", "free", "price")
    own = {(r["id"], r["snap"]): r for r in P.with_demand(summary).collect()}
    a = own[1, "s1"]
    assert (a["n_days"], a["n_free"], a["n_weekend"], a["n_weekend_free"], a["median_price"]) == (7, 4, 2, 1, 103.0) and a["occupancy_weekend"] == 0.5
    assert math.isclose(a["occupancy"], 3 / 7) and own[1, "s2"]["occupancy_weekend"] is None and own[2, "s1"]["occupancy"] == 0.0 and own[2, "s1"]["weekend_premium"] is None
    listings = spark.createDataFrame([(1, 0.3), (9, 0.7)], "id long, proxy double")
    joined, trajectory = P.demand(listings, P.with_demand(summary), "id", "snap", "proxy")
    assert {r["id"]: r["proxy"] for r in joined.collect()} == {1: 1.0, 9: 0.7} and trajectory.count() == 3


def test_blend(spark):
    field = spark.createDataFrame([("a", 10.0, 0.5, 0.0, 1.0), ("b", 5.0, None, 1.0, 3.0), ("c", 0.0, 0.1, None, 30.0)], "name string, f double, p double, adj double, odds double")
    found = {r["name"]: r for r in P.blended(field, {"f": 1.0}, "p", "adj", "odds").collect()}
    assert found["a"]["score"] == 85.0 and found["b"]["score"] == 0.7 * 50 + 10 + 3 and math.isclose(sum(r["chance"] for r in found.values()), 1, abs_tol=1e-6)
    assert (found["a"]["value"], found["b"]["value"], found["c"]["value"]) == ("+", "-", "-") and found["a"]["stake"] == 0.25 and found["c"]["stake"] == 0.0


def test_findings(spark):
    rows = [("r1", "ml", "py", 3, 2, 900, "fine"), ("r1", "ml", "py", 1, 0, 900, "fine"), ("r2", "ml", None, 0, 1, 50, "TODO"), ("r3", "web", "js", 2, 9, 2000, ""), ("r4", "web", "js", 0, 0, 300, "coming soon")]
    own = spark.createDataFrame(rows, "repo string, cat string, lang string, badges int, code int, chars int, tldr string")
    assert got(P.landscape(own, "cat").select("cat", "pct")) == [("ml", 60.0), ("web", 40.0)]
    assert got(P.top_values(own, "cat", "lang", 1, "_unknown")) == [("ml", "py", 2, 66.7), ("web", "js", 2, 100.0)]
    assert [r["repo"] for r in P.best_distinct(own, "repo", F.expr("badges * 3 + code"), 2).collect()] == ["r3", "r1"]
    lonely = own.where(P.is_placeholder(F.col("tldr"), F.col("chars")))
    assert [r["repo"] for r in P.best_distinct(lonely, "repo", F.col("chars"), 9, ascending=True).collect()] == ["r2", "r4", "r3"]


def test_sections(spark):
    scored = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.8), (2, "x", 0.7), (3, "z", 0.6), (4, "w", 0.5)], "id int, image string, score double")
    about = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "id int, lat double")
    found = P.section(scored, "id", "image", "score", 2, about)
    assert [(r["id"], r["image"]) for r in found.collect()] == [(1, "x"), (3, "z")]
    assert got(P.map_points([found, found], "id", ["lat"])) == [(1, 5.0)]


def test_small_reports(spark):
    people = spark.createDataFrame([("Ann Lee", 1), ("Lee, Bob Jr.", 2), ("Cy Moe", 4)], "name string, n long")
    assert got(P.name_rollup(people, "name", "n")) == [("lee", 3), ("moe", 4)]
    assert [tuple(r) for r in P.score_histogram(spark.createDataFrame([(0.2,), (0.9,), (1.0,), (5.5,)], "s double"), "s").collect()] == [(0.0, 2), (1.0, 1), (5.0, 1)]
    a, b = spark.createDataFrame([("x",), ("y",)], "w string"), spark.createDataFrame([("y",), ("z",)], "w string")
    assert got(P.vocabulary([a, b], "w")) == [("x",), ("y",), ("z",)]
