"""Listings, split plans, batches, pairs, vector and shape files, sinks, tables of pages."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import html
from tessera.sources import files, io
from tessera.streaming import runs


def test_listing_and_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, size in (("a/x.jsonl", 25), ("y.jsonl", 10), ("z.jsonl", 0), ("w.csv", 3)):
        (tmp_path / name).write_bytes(b"1" * size)
    found = files.listing(spark, str(tmp_path), "*.jsonl")
    plan = [(r["path"].rpartition("/")[2], r["start"], r["stop"]) for r in files.split_plan(found, 10).orderBy("path", "start").collect()]
    assert plan == [("x.jsonl", 0, 10), ("x.jsonl", 10, 20), ("x.jsonl", 20, 25), ("y.jsonl", 0, 10)]


def test_splits_of_lines_lose_nothing(spark, tmp_path):
    """However small the splits, every line is read once, also those that a split cuts; malformed and blank ones are dropped."""
    lines = [json.dumps({"a": i, "t": "x" * (i % 50)}) if i % 7 else ["", "{bad"][i % 2] for i in range(2000)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    before, want = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}, [i for i in range(2000) if i % 7]
    try:
        for size, least in (("100000000", 1), ("10000", 5), ("997", 50)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, t string")
            assert sorted(r["a"] for r in got.collect()) == want and got.rdd.getNumPartitions() >= least
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches(spark, tmp_path):
    df = spark.range(23).withColumn("v", F.col("id") * 2).repartition(4)
    path = str(tmp_path / "t")
    for _ in range(2):
        files.rechunk(df, path, 10, ["id"])
        assert [r["id"] for r in files.read_batch(spark, path, 1, ["id"]).orderBy("id").collect()] == list(range(10, 20))
    assert files.read_batch(spark, path, 2).count() == 3 and files.read_batch(spark, path, 9).count() == 0
    assert "PartitionFilters: [isnotnull(batch" in files.read_batch(spark, path, 1)._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_vectors(spark, tmp_path):
    for name in ("s1", "s2"):
        np.save(tmp_path / f"{name}.npy", np.eye(2, dtype=np.float32))
        (tmp_path / f"{name}.json").write_text(json.dumps([f"{name}a", f"{name}b"]))
    np.save(tmp_path / "s3.npy", np.eye(2))
    found = files.complete(files.listing(spark, str(tmp_path)), (".npy", ".json"))
    assert [r["stem"] for r in found.collect()] == ["s1", "s2"] and files.complete(files.listing(spark, str(tmp_path)), (".npy", ".json"), 1).count() == 1
    assert {r["id"]: r["vector"] for r in files.read_vectors(spark, str(tmp_path)).collect()} == {f"{s}{x}": v for s in ("s1", "s2") for x, v in (("a", [1.0, 0.0]), ("b", [0.0, 1.0]))}


def test_shapes():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 4, 2, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = lambda k, b: struct.pack(">2i", k, len(b) // 2) + b
    rings = files.shape_rings(b"\0" * 100 + record(1, body) + record(2, struct.pack("<i", 0)))
    assert rings == [[ring], []] and files.svg_path(rings[0], (0, 0, 4, 2), 40) == "M0.0,20.0 L40.0,20.0 L40.0,0.0 L0.0,20.0 Z"
    assert files.choropleth({"a": "M0", "b": "M1", "c": "M2"}, {"a": 0.0, "b": 9.0}, 1, 1, ("x", "y")) == '<svg viewBox="0 0 1 1"><path id="a" d="M0" fill="x"/><path id="b" d="M1" fill="y"/><path id="c" d="M2" fill="none"/></svg>'


def test_cards():
    rows = [{"t": "a<b", "x": 1, "y": None, "i": "u?a&b"}, {"t": "c", "x": "&", "i": None}]
    assert files.cards(rows, "t", ["x", "y"], "i") == '<div class="card"><img src="u?a&amp;b"><h3>a&lt;b</h3><ul><li>x: 1</li></ul></div><div class="card"><h3>c</h3><ul><li>x: &amp;</li></ul></div>'


def test_sinks(spark, tmp_path):
    for k in range(2):
        io.write_jsonl(spark.range(k, k + 1), str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1]
    put = io.put_objects(spark.createDataFrame([("256/a.bin", b"xy"), ("b.bin", b"")], "name string, data binary"), f"file://{tmp_path}/objects")
    assert all(r["ok"] for r in put.collect()) and (tmp_path / "objects/256/a.bin").read_bytes() == b"xy"
    data = bytes(range(256)) * 50
    assert io.from_pieces(io.to_pieces(data, 100)) == data and max(map(len, io.to_pieces(data, 100))) == 100
    page = io.Patcher("<b>1</b>").replace("n", "<b>.*?</b>", "<b>2</b>").replace("m", "zz", "", required=False)
    assert page.page == "<b>2</b>" and page.hits == {"n": 1, "m": 0}
    with pytest.raises(ValueError):
        page.replace("x", "zz", "")


def test_guards(spark, tmp_path):
    path = str(tmp_path / "job1")
    spark.range(10_000).write.parquet(path)
    assert io.saved(spark, str(tmp_path), "job1").count() == io.guarded(spark.read.parquet(path), 10**9).count() == 10_000
    with pytest.raises(RuntimeError):
        io.guarded(spark.read.parquet(path), 10)

    def broken():
        raise OSError("down")

    assert io.first_available([broken, lambda: spark.range(0), lambda: spark.range(3)]).count() == 3 and io.first_available([lambda: spark.range(0)]).count() == 0
    with pytest.raises(OSError):
        io.first_available([broken])
    good, bad = io.gate(spark.createDataFrame([(500, 0.9), (500, 0.2), (3, 0.9), (None, 0.9)], "n int, ok double"), (F.col("n") >= 100) & (F.col("ok") >= 0.5))
    assert (good.count(), bad.count()) == (1, 3)


TABLES = """<table><tr><th>x</th></tr><tr><td>1</td></tr></table>
<table><tr><th colspan=3>Results</th></tr><tr><th>Finish</th><th>Horse <br>name</th><th>Trainer</th></tr>
<tr><th>1 [a]</th><td>Sea &amp; Hero</td><td>J. Doe</td></tr><tr><td>2</td><td>Angel</td></tr></table><table><tr><th>horse</th><th>trainer</th></tr><tr><td>a</td><td>b</td></tr></table>"""


def test_html_tables(spark):
    needles = {"finish": ["finish", "position"], "horse": ["horse"], "trainer": ["trainer"], "odds": ["odds"]}
    want = [{"finish": "1 [a]", "horse": "Sea & Hero", "trainer": "J. Doe", "odds": None}, {"finish": "2", "horse": "Angel", "trainer": None, "odds": None}]
    assert html.find_table(TABLES, needles, ["horse", "trainer"]) == want and html.find_table(None, needles, []) == [] and html.find_table("<p>", needles, []) == []
    own = spark.createDataFrame([(TABLES,), (None,)], "page string").select(html.table_rows(F.col("page"), needles, ["horse"]).alias("rows"))
    assert [r.asDict() for r in own.select(F.inline("rows")).collect()] == want


def test_running_snapshots(spark, tmp_path):
    """After every second batch the totals so far are on disk, and a partial total is never more than the final one."""
    source = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([("a", 1.0)] * (k + 1), "event_type string, value double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    runs.snapshots(runs.running_totals(stream), str(tmp_path / "snap"), str(tmp_path / "ck"), every=2)
    got = [(r["batch"], r["n"]) for r in spark.read.parquet(str(tmp_path / "snap")).orderBy("batch").collect()]
    assert [b for b, _ in got] == [1, 3] and got[0][1] < got[1][1] == 10


def test_plain_readers(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"id,v\n1,x\nbad,y\n3,z\n"))
    (tmp_path / "b.txt").write_text("one\n\n  two  \n")
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n\n{"a": 2}\n'))
    assert [r["id"] for r in io.read_csv(spark, str(tmp_path / "a.csv.gz"), "id int, v string").collect()] == [1, 3]
    assert [r["id"] for r in io.lookup(spark.read.csv(str(tmp_path / "a.csv.gz"), header=True), "id").collect()] == [1, 3]
    assert sorted(r["line"] for r in io.read_lines(spark, str(tmp_path / "b.txt")).collect()) == ["one", "two"]
    assert sorted(r["a"] for r in io.read_jsonl(spark, str(tmp_path / "c.jsonl.gz"), "a int").collect()) == [1, 2]
    assert bytes(io.read_binary(spark, str(tmp_path), "b.txt").first()["content"]) == b"one\n\n  two  \n"
    io.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "id int, v string"), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), header=True, schema="id int, v string").collect())) == [(1, "a,b"), (2, None)]
    io.write_documents(spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, x int"), str(tmp_path / "docs"), "k")
    assert json.loads(spark.read.text(str(tmp_path / "docs" / "k=k2")).first()[0]) == {"k": "k2", "x": 2}
    assert io.keep_existing(spark.range(1).withColumn("v", F.lit(1)), ["v", "w"]).columns == ["v"]


def test_event_time_streams(spark, tmp_path):
    """Deliveries that are repeated count once; windows and sessions hold what a batch query finds."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 40, start + datetime.timedelta(minutes=7 * (i % 40)), i % 3, "a", 1.0) for i in range(60)]
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    once = runs.deduplicated(stream(), "event_id", "ts", "1 day")
    assert runs.drain(once, "once", str(tmp_path / "c1"), "append").count() == 40
    found = runs.drain(runs.windowed(stream()), "windows", str(tmp_path / "c2"), "complete")
    assert found.agg(F.sum("n")).first()[0] == 60 and found.count() == 5
    found = runs.drain(runs.sessions(stream(), "10 minutes"), "sessions", str(tmp_path / "c3"), "complete")
    assert found.agg(F.sum("n")).first()[0] == 60
