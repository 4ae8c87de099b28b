"""Pictures, rasters, model batches and clients, on arrays small enough to check by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fanout, media


def test_orientations():
    p = np.arange(12).reshape(2, 2, 3)
    a, b, c, d = p[0, 0, 0], p[0, 1, 0], p[1, 0, 0], p[1, 1, 0]
    want = {1: [[a, b], [c, d]], 2: [[b, a], [d, c]], 3: [[d, c], [b, a]], 4: [[c, d], [a, b]], 5: [[a, c], [b, d]], 6: [[c, a], [d, b]], 7: [[d, b], [c, a]], 8: [[b, d], [a, c]]}
    assert {k: media.upright(p, k)[:, :, 0].tolist() for k in want} == want


def test_sizes_and_features(spark):
    picture = np.zeros((40, 80, 3), np.uint8)
    picture[:, 40:] = 255
    assert media.thumbnail(picture, 20).shape == (10, 20, 3) and media.thumbnail(picture, 500).shape == picture.shape
    assert np.allclose(media.resized(picture, 1, 2)[0, :, 0], [0, 255]) and abs(media.resized(picture, 7, 13).mean() - 127.5) < 1e-9
    own = spark.createDataFrame([(1, media.dump(picture), 6), (2, b"junk", None), (3, None, None)], "id long, body binary, turn int")
    small = {(r["id"], r["size"]): r for r in media.thumbnails(own, "id", "body", (10, 20), "turn").collect()}
    assert (small[1, 20]["width"], small[1, 20]["height"]) == (10, 20) and small[2, None]["error"] and len(small) == 4
    assert media.load(small[1, 10]["data"]).shape == (10, 5, 3)
    got = {r["id"]: r for r in media.with_features(own, "body").collect()}
    assert got[1]["width"] == 80 and abs(got[1]["brightness"] - 0.5) < 1e-9 and abs(got[1]["edge_density"] - 1 / 127 / 2) < 1e-9 and got[3]["error"]


def test_scores_and_detections(spark):
    own = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    assert [tuple(r) for r in own.select(*media.prompt_scores(F.col("v"), {"a": [2, 0], "b": [0, 1]})).collect()] == [(1.0, 0.0), (0.0, 0.0)]
    kind = "h int, boxes array<struct<label:string,score:double,x0:double,y0:double,x1:double,y1:double>>"
    box = lambda label, score, top=0.0, low=1.0: (label, score, 0.0, top, 9.0, low)
    rows = [(100, [box("tv", 0.9, 10.0, 30.0), box("tv", 0.5, 80.0, 90.0), box("cat", 0.8), box("dog", 0.1), box("potted plant", 0.3)]), (100, [])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(media.detections(F.col("boxes"), F.col("h"))).collect()]
    assert (got[0]["cat_count"], got[0]["dog_count"], got[0]["potted_plant_count"], got[0]["pet_count"], got[0]["n_objects"], got[0]["tv_detected"], got[0]["tv_above_middle"]) == (1, 0, 1, 1, 4, True, True)
    assert not got[1]["tv_detected"] and not got[1]["tv_above_middle"] and got[1]["n_objects"] == 0


def test_ndvi(spark):
    a, b = np.full((2, 3), 10, np.uint16), np.full((2, 3), 30, np.uint16)
    own = spark.createDataFrame([("t", media.dump(a), media.dump(b)), ("u", media.dump(a), media.dump(b[:1]))], "id string, r binary, n binary")
    got = {r["id"]: r for r in media.ndvi(own, "id", "r", "n").collect()}
    assert abs(got["t"]["mean_ndvi"] - 0.5) < 1e-6 and got["t"]["pixels"] == 6 and "bands" in got["u"]["error"]


def lengths():
    return lambda texts: [[len(t), 2.0] for t in texts]


def test_batched_inference(spark):
    got = {r["id"]: r for r in fanout.classify(spark.createDataFrame([(1, "abcd"), (2, "a"), (3, None)], "id long, t string"), lengths, ["long", "short"], "id", "t").collect()}
    assert [got[i]["label"] for i in (1, 2, 3)] == ["long", "short", "short"] and got[3]["score"] == pytest.approx(1 / (1 + np.exp(-2)))
    calls = []
    once = fanout.per_process(lambda: calls.append(1) or 5)
    assert once() == once() == 5 and len(calls) == 1


def test_chunks_and_kinds(spark):
    assert fanout.chunks([1, 2, 3], 2) == [[1, 2], [3]] and fanout.strided([1, 2, 3], 2) == [[1, 3], [2]] and fanout.strided([], 2) == []
    tasks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "kind string, x long")
    got = {r["y"]: r["ok"] for r in fanout.dispatch(tasks, {"a": lambda t: {"y": t["x"] * 10}, "b": lambda t: {"y": -t["x"]}}, "y long").collect()}
    assert got == {10: True, -2: True, None: False}
    budget = fanout.Budget(100)
    for what, cost in (("a", 5), ("b", 7), ("a", 1)):
        budget.add(what, cost)
    assert budget.totals() == {"a": 6, "b": 7, "total": 13, "peak": 7}


def test_asking_in_batches(spark):
    def ask(batch):
        if any(r["id"] == 9 for r in batch):
            return "no idea"
        return "Sure: " + json.dumps([{"id": r["id"], "label": f"l{r['id']}"} for r in batch if r["id"] != 2]) + " done"

    got = {r["id"]: r for r in fanout.ask_batches(spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "id long").coalesce(1), ask, "label string", "id", 3).collect()}
    assert got[1]["label"] == "l1" and got[3]["ok"] and not got[2]["ok"] and got[2]["error"] == "no answer" and "ValueError" in got[9]["error"]


def test_fetching(spark):
    assert [fanout.page_status(*x) for x in ((200, "ok"), (200, "captcha"), (200, "404 Page Not Found"), (403, ""), (429, ""), (410, ""), (503, ""), (302, ""))] == ["ok", "blocked", "not_found", "forbidden", "rate_limited", "not_found", "server_error", "http_302"]

    def get(url):
        if url == "x":
            raise OSError
        return {"a": (200, "page"), "b": (404, ""), "c": (503, "")}[url]

    got = {r["url"]: (r["status"], r["body"]) for r in fanout.fetch(spark.createDataFrame([(u,) for u in "abcx"], "url string"), get, 2, sleep=lambda s: None).collect()}
    assert got == {"a": ("ok", "page"), "b": ("not_found", None), "c": ("server_error", None), "x": ("exception: OSError", None)}


def test_canary(spark):
    def work(task):
        if task["id"] % 4 == 0:
            raise ValueError
        return {"y": task["id"]}

    assert 0.5 < fanout.canary(spark.range(400), work, "y long", 0.5, 0.5, "id") < 1
    with pytest.raises(RuntimeError):
        fanout.canary(spark.range(400), work, "y long", 0.5, 0.95, "id")


def test_rate_limit(spark):
    """Two partitions that share 20 a second take at least 0.1 s a task each."""
    import time

    began = time.time()
    assert fanout.parallel_map(spark.range(8), lambda t: {"y": t["id"]}, "y long", max_parallelism=2, per_second=20).count() == 8
    assert time.time() - began >= 0.3
