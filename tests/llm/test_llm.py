"""Operators against brute force, round trips, held-out labels, odd rows and empty tables."""

import hashlib
import math
import os
import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, decontam, exact_dedup, langid, near_dedup, packing, quality, queries, substring_dedup, toxicity, url_filter
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    assert compare(spark, connect(small), small, queries.QUERIES[name], queries.SQL[name]) == ""


def test_language_held_out(spark, small):
    found = queries.QUERIES["op1_language_id"](spark, small).where("held_out")
    gold = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    n, ok = found.join(gold, "doc_id").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and ok / n > 0.95


def test_language_odd_rows(spark, odd, empty):
    model = langid.fit(odd, F.lit(True))
    out = {r["text"]: r for r in langid.predict(odd, model).collect()}
    assert out[None]["lang_pred"] == out[""]["lang_pred"] == out["...!!! 123"]["lang_pred"] == "und" and out["x"]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and langid.predict(empty, model).count() == 0
    assert langid.predict(odd, langid.fit(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality", "quality", 0.9), ("op8_toxicity", "toxic", 0.85)])
def test_scores(spark, small, name, label, least):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = queries.QUERIES[name](spark, small)
    both = out.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where(F.col("held_out"))
    n, ok = both.agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label))).first()
    assert out.count() == docs.count() and ok >= (least - 0.1) * n


def test_scores_odd_rows(odd, empty):
    weights = np.zeros(quality.BUCKETS)
    out = quality.score(odd, (weights, 1.0)).collect()
    assert len(out) == 11 and all(abs(r["score"] - 1 / (1 + math.exp(-1))) < 1e-9 for r in out)
    model = toxicity.train([b"you idiot here.", b"an idiot, they said.", b"fine words only."] * 30, np.array([1, 1, 0] * 30))
    rows = toxicity.tag(odd, model).collect()
    assert len(rows) == 11 and [r["score"] for r in rows if not r["text"]] == [0.0, 0.0]
    assert quality.score(empty, (weights, 0.0)).count() == toxicity.tag(empty, model).count() == 0


def test_toxic_offsets(spark):
    clean = [b"you are here.", b"they said so, an hour ago.", b"fine words only."]  # the words around are clean ones
    model = toxicity.train([b"you idiot here.", b"an idiot, they said.", *clean] * 30, np.array([1, 1, 0, 0, 0] * 30))
    text = "Größe und so. You IDIOT here"
    spans = toxicity.tag(spark.createDataFrame([(text,)], "text string"), model).first()["spans"]
    assert [text[s["start"] : s["stop"]] for s in spans] == ["IDIOT"]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, move, start = rng.normal(size=7), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, _ = toxicity.forward_backward(emit, np.array([0, 4]), np.array([4, 3]), move, start)
    for first, n in ((0, 4), (4, 3)):
        weight = np.zeros(n)
        total = 0.0
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = math.exp(start[y[0]] + sum(emit[first + i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            weight += w * np.array(y)
        assert np.allclose(p[first : first + n], weight / total)


@pytest.mark.parametrize(("bits", "block"), [(256, 40_000), (4, 100_000)])
def test_exact_dedup(odd, empty, bits, block):
    """Blocks below the longest text, so that names go up several levels; digests of four bits collide and force the join on blocks."""
    out = exact_dedup.dedup(odd, block=block, digest_bits=bits).collect()
    texts = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in odd.collect()}
    for r in out:
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(1, 2, 2), (2, 2, 2), (3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2), (7, 7, 2), (None, None, 1), (8, 8, 1), (9, 9, 1)}
    assert sum(r["kept"] for r in out) == 7 and exact_dedup.dedup(empty).count() == 0


def brute_windows(rows, window):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    first, out = {}, {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), (k, i))
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))) if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for fan in (substring_dedup.FAN, 3, 2):  # in groups of few chunks, whose first windows meet again
        out = substring_dedup.remove_repeats(df, window=5, chunk_bytes=300, width=1, shard_bits=6, fan=fan)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()} == brute_windows(rows, 5)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_odd_rows(odd):
    out = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd).collect()]
    assert len(out) == 11 and (5, 30_000, 0) in out and (6, 30_000, 30_000) in out and (3, 0, 0) in out and (None, 5, 0) in out


def test_myers():
    def table(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            now = [i]
            for j, b in enumerate(t, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
            row = now
        return min(row), row.index(min(row))

    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert decontam.myers(p, t) == table(p, t)


def test_decontamination(spark, odd, empty):
    rng = random.Random(2)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))) for k in range(5)]
    bench = spark.createDataFrame([*items, (99, None), (98, "tiny")], "item_id long, text string")
    docs, want = [], {}
    for k, item in items:
        for n in (0, 5, int(len(item) * decontam.RATE), 2 * int(len(item) * decontam.RATE) + 10):
            chars = list(item)
            for i in rng.sample(range(len(chars)), n):
                chars[i] = "Z"
            key = 100 * k + n
            docs.append((key, "before it  " + "".join(chars) + "\nafter it"))
            if n <= len(item) * decontam.RATE:
                want[key, k] = n
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
    assert decontam.matches(odd, bench).count() == decontam.matches(empty, bench).count() == decontam.matches(odd, bench.where("false")).count() == 0


def brute_classes(rows, threshold=0.8):
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        both = sum((bags[x] & bags[y]).values())
        if both >= threshold * (sum(bags[x].values()) + sum(bags[y].values()) - both) - 1e-9:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_dedup(spark, empty):
    """Families of texts with all numbers of edits, so that similarities lie on both sides of the threshold."""
    rng = random.Random(6)
    rows = []
    for family in range(3):
        base = [f"w{rng.randrange(40)}" for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for i in rng.sample(range(len(own)), rng.randrange(0, 5)):
                own[i] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got}) and near_dedup.near_classes(empty).count() == 0


def test_near_links_of_a_family_are_not_compared_pair_by_pair(spark):
    """Each text of a family is similar to most others, but its buckets' first and central texts are others' that are not."""
    rng = random.Random(1)
    base, texts = [f"b{i}" for i in range(400)], []
    for k in range(80):
        own = list(base)
        for i in range(100):
            own[(50 * (k % 8) + i) % 400] = f"f{k // 8}x{i}"
        texts.append(" ".join(own))
    for _ in range(50):
        own = list(base)
        for i in rng.sample(range(400), 4):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    compared = {}

    class Counted(common.Scratch):
        def save(self, df, name, rows=None):
            out = super().save(df, name, rows)
            if name.endswith("-pairs") and name >= "links4":
                compared[name] = out.count()
            return out

    rows = list(enumerate(texts))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), scratch=Counted(spark)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)
    assert 0 < compared[max(compared)] < 400, compared  # the last step compares in full what is left: 840 pairs before the rounds


def test_near_odd_rows(odd):
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == 11 and sum(r["kept"] for r in got) == 7


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a, b = ({i: int(rng.integers(1, 9)) for i in range(lo, lo + 40)} for lo in (0, 10))
    j = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(50)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(50))
    sig = [near_dedup.signatures(near_dedup.mix(np.array(list(x), np.uint64) + np.uint64(9)), np.zeros(len(x), np.int64), np.array(list(x.values())), 1, 6000)[0] for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - j) < 0.03


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.public_tokenizer())
    for text in ("Hello  world\n\n x", "über <|endoftext|> straße", "", "a" * 3000):
        assert packing.encoder(packing.public_tokenizer())(text) == plain.encode(text, add_special_tokens=False).ids
    got = packing.pack(odd, size=64).toPandas()
    assert got["length"].sum() == sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64 and packing.pack(empty).count() == 0


def test_plan_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # 6 + 3 leaves 1; two 2s fill the gap of 4 left by the 3
    rows = packing.plan(counts, 10)
    first = sorted(int(r[0]) for r in rows if r[2] == 0)
    assert first == [2, 2, 6] and rows[:, 4].sum() == 4


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\\\h \\t ### </turn>\n", "", None, "a:b\\c####"]
    rows = [(1, k, role, nasty[k % 5]) for k, role in enumerate(["system", "user", "assistant", "us:er", "assistant", "user"])] + [(None, None, None, "x"), (2, 0, "assistant", None), (2, 0, "assistant", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    out = {r["conv_id"]: r for r in chat.digests(chat.expand(conv)).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:6])
    loss = "".join(t or "" for _, _, r, t in rows[:6] if r == "assistant")
    assert out[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and out[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert out[2]["n_turns"] == 2 and out[None]["n_turns"] == 1 and chat.expand(conv.where("false")).count() == 0
    masked = chat.expand(conv).where("conv_id = 1 and target is not null").collect()
    assert len(masked) == 2 and all(r["formatted"][r["loss_stop"] :] == chat.CLOSE for r in masked)


def test_url_filter(spark):
    entries = spark.createDataFrame([("domain", "Bad.com", "block", "2024-01-01"), ("domain", "bad.com", "remove", "2024-02-01"), ("host", "ok.bad.com", "allow", "2024-01-05"), ("prefix", "x.org/a/", "block", "2024-01-01"), (None, "x", "block", "2024-01-01"), ("domain", "d.io", "block", "2024-03-01"), ("domain", "d.io", "remove", "2024-03-01")], "kind string, value string, action string, dated string").withColumn("dated", F.to_date("dated"))
    rows = [(1, "http://a.BAD.com/x", "2024-01-10"), (1, "http://a.bad.com", "2024-02-01"), (3, "http://ok.bad.com/", "2024-01-06"), (4, "http://ok.bad.com/", "2024-01-02"), (5, "https://x.org/a/b?c", "2024-01-01"), (6, "https://x.org/ab", "2024-01-01"), (7, None, "2024-01-01"), (8, "junk", None), (9, "http://d.io", "2024-03-02"), (10, "http://x.org/" + "a/" * 20_000, "2024-01-02")]
    pages = spark.createDataFrame(rows, "page_id long, url string, f string").select("page_id", "url", F.to_date("f").alias("fetched_at"), F.lit(1).alias("host"), F.lit(2).alias("kind"))
    out = url_filter.evaluate(pages, entries)
    assert sorted((r["page_id"], r["decision"]) for r in out.collect()) == [(1, "block"), (1, "none"), (3, "allow"), (4, "block"), (5, "block"), (6, "none"), (7, "none"), (8, "none"), (9, "block"), (10, "block")]
    assert url_filter.evaluate(pages.where("false"), entries).count() == 0 and url_filter.evaluate(pages, entries.where("false")).where("decision <> 'none'").count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, small)
        assert kept.columns == docs.columns
        rows = kept.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    near = near_dedup.near_classes(docs)
    assert near.where("NOT kept").count() == 0
    assert cp.pack(spark, docs, small).select("doc_id").distinct().count() == docs.count() > 100


def test_pipeline_repeated_and_null_ids(spark, tmp_path):
    """Each stage drops rows, not ids."""
    import corpus_pipeline as cp

    near = " ".join(f"w{i}" for i in range(60))
    item = "what is the boiling point of water at sea level in degrees"
    rows = [(7, "x one"), (7, "x one"), (7, "y two"), (3, "x one"), (None, "unique null"), (None, "twice null"), (None, "twice null"), (8, near), (8, near + " w60"), (None, "so then, my dear pupils, tell me now: " + item), (9, item), (9, "clean nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    once = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = [(3, "x one"), (7, "y two"), (None, "unique null"), (None, "twice null"), (8, near), (8, near + " w60"), (None, "so then, my dear pupils, tell me now: " + item), (9, item), (9, "clean nine")]
    got = cp.dedup_exact(spark, docs, str(tmp_path))
    assert once(got) == sorted(want, key=repr)
    got = cp.dedup_near(spark, got, str(tmp_path))
    assert once(got) == sorted(set(want) - {(8, near + " w60")}, key=repr)
    got = cp.decontaminate(spark, got, str(tmp_path))
    assert once(got) == sorted(set(want) - {(8, near + " w60"), (None, "so then, my dear pupils, tell me now: " + item), (9, item)}, key=repr)


def test_pipeline_drops_unknown_languages(spark, small):
    """Unlearned scripts and random letters go; clean documents and their beginnings stay."""
    import corpus_pipeline as cp

    rng = random.Random(5)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    scripts = {"Cyrillic": (0x430, 0x450), "Greek": (0x3B1, 0x3C9), "Arabic": (0x627, 0x64A), "Han": (0x4E00, 0x9000), "Latin": (97, 123)}
    rows = []
    for k, (lo, hi) in enumerate(scripts.values()):
        for i in range(40):
            n = rng.choice([20, 60, 150, 400])
            rows.append((10_000 * (k + 1) + i, " ".join("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(2, 10))) for _ in range(n)), None))
    clean = [r for r in docs.collect() if r["text"] and len(r["text"].split()) >= 20]
    starts = [(1_000_000 + r["doc_id"], " ".join(r["text"].split()[:4]), None) for r in clean]
    both = docs.unionByName(spark.createDataFrame(rows + starts, docs.schema))
    kept = {r["doc_id"] for r in cp.language_id(spark, both, small).select("doc_id").collect()}
    assert {k: sum(10_000 * k <= i < 10_000 * (k + 1) for i in kept) for k in range(1, 6)} == dict.fromkeys(range(1, 6), 0)
    assert sum(r["doc_id"] in kept for r in clean) == len(clean)
    assert sum(i >= 1_000_000 for i in kept) >= 0.98 * len(starts)


def test_short_items(spark):
    """Items too short for an edit as whole words, those of 17 to 23 characters with an edit."""
    items = [(1, "2+2=4"), (2, "Paris"), (3, "who wrote hamlet?"), (4, ""), (5, " x "), (6, "is 7 a prime number?"), (7, "の"), (8, "a b"), (9, "?")]
    docs = ["so 2+2=4.", "12+2=4", "in  PARIS, they", "comparison", "parisian paris", "Who  wrote\nHamlet?", "who wrote hamlat?", "who wrqte hamlat?", "x", "axe", "is 8 a prime number?", "no (の) here", "a b a bc", "ca b", "odd?!", ""]
    got = decontam.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(0, 1): 0, (2, 2): 0, (4, 2): 0, (5, 3): 0, (6, 3): 1, (8, 5): 0, (10, 6): 1, (11, 7): 0, (12, 8): 0, (14, 9): 0} | {(i, 9): 0 for i in (5, 6, 7, 10)}
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
    assert [(r["start"], r["stop"]) for r in got if (r["doc_id"], r["item_id"]) == (4, 2)] == [(9, 14)]


def test_rare_language_is_learned(spark):
    """Each language is sampled by itself: common ones down to the bound, a rare one not at all."""
    rows = [(i, "the cat and the dog", "en") for i in range(6000)] + [(10_000 + i, "der hund und die katze", "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: r["count"] for r in langid.training(docs, F.lit(True), max_train=60).groupBy("lang").count().collect()}
    assert got["de"] == 5 and 30 <= got["en"] <= 100
    assert langid.fit(docs, F.lit(True), max_train=60)[0] == ["de", "en"]
    assert langid.training(docs, F.lit(True), max_train=6000).count() == 6005


def test_url_prefixes_of_hosts(spark):
    """Prefixes without a path, and with an upper-case host; the path keeps its case."""
    entries = spark.createDataFrame([("prefix", "x.org/", "block"), ("prefix", "Y.Org/Aa/", "block"), ("prefix", "x.org/ok", "allow"), ("host", "x.org", "allow")], "kind string, value string, action string").withColumn("dated", F.lit("2024-01-01").cast("date"))
    urls = ["http://x.org", "http://X.org/", "http://x.org/b?c", "http://x.org/ok/d", "http://a.x.org/", "http://y.org/Aa/1", "http://y.org/aa/1", "http://y.org", "junk"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    got = {r["page_id"]: r["decision"] for r in url_filter.evaluate(pages, entries).collect()}
    assert [got[i] for i in range(9)] == ["block", "block", "block", "allow", "none", "block", "none", "none", "none"]


def test_url_filter_with_the_hosts_at_hand(spark, small):
    """A dated list of the hosts and paths of the table, so that every rule meets pages, against a plain evaluation."""
    from datetime import date, timedelta
    from urllib.parse import urlsplit

    pages = [(r["page_id"], r["url"], date(2024, 1, 1) + timedelta(r["page_id"] % 366)) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect() if r["url"]]
    entries = []
    for k, (_, url, _) in enumerate(pages):
        host, path = (urlsplit(url).hostname or "").lower(), urlsplit(url).path
        value = [("domain", host.partition(".")[2]), ("host", host), ("prefix", host + "/" + path.strip("/").split("/")[0]), ("prefix", host)][k % 4]
        entries += [(*value, action, date(2024, 1, 1) + timedelta((37 * k + 90 * j) % 366)) for j, action in enumerate(("block", "allow", "remove"))]
    order = {"remove": 0, "allow": 1, "block": 2}
    groups = {}
    for kind, value, action, dated in entries:
        groups.setdefault((kind, value.rstrip("/")), []).append((dated, order[action], action))
    want = {}
    for key, url, day in pages:
        host, path = (urlsplit(url).hostname or "").lower(), urlsplit(url).path
        best = (0, 0, "none")
        for (kind, value), dates in groups.items():
            fits = host == value if kind == "host" else host == value or host.endswith("." + value) if kind == "domain" else host + path == value or (host + path).startswith(value + "/")
            held = max([x for x in dates if x[0] <= day], default=None)
            if fits and held and held[2] != "remove":
                best = max(best, ({"prefix": 3, "host": 2, "domain": 1}[kind], len(value), held[2]))
        want[key] = best[2]
    got = url_filter.evaluate(spark.createDataFrame(pages, "page_id long, url string, fetched_at date"), spark.createDataFrame(entries, "kind string, value string, action string, dated date"))
    assert {r["page_id"]: r["decision"] for r in got.collect()} == want and {"none", "allow", "block"} == set(want.values())


def thue_morse(n):
    """2**n letters; modulo a power of two, polynomial hashes of the word and of its complement agree."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_span_hashes_tell_spans_apart():
    words = [b"", b"a", b"a\0", b"ab" * 4, b"ab" * 4 + b"a", b"x" * 64, b"x" * 65, *(thue_morse(n).translate(t).encode() for n in (3, 5, 6, 10, 11) for t in ({}, str.maketrans("ab", "ba")))]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    ends = starts + np.array([len(w) for w in words])
    one, two = common.span_hashes(buf, starts, ends), common.span_hashes(buf, starts, ends, 1)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words) and not set(one.tolist()) & set(two.tolist())
    again = common.span_hashes(np.concatenate([np.frombuffer(b"zz", np.uint8), buf]), starts + 2, ends + 2)
    assert (again == one).all()


def test_shingle_numbers_round_trip():
    numbers = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 500, np.uint64))
    assert (near_dedup.unpacked(near_dedup.packed(numbers)) == numbers).all() and near_dedup.unpacked(b"").size == 0


def test_near_texts_of_colliding_words(spark):
    """Words that polynomial hashes confuse are different words."""
    word, tail = thue_morse(11), " ".join(f"w{i}" for i in range(4))
    rows = [(1, f"{word} {tail}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {tail}")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {1, 2}


def test_shared_folder(spark, monkeypatch):
    """Only a local master may do without spark.checkpoint.dir."""

    class Other:
        conf = {"spark.master": "spark://host:7077"}

    assert common.shared_dir(spark)
    with pytest.raises(ValueError):
        common.shared_dir(Other)
    with common.Scratch(spark) as scratch:
        assert scratch.save(spark.range(3), "a").count() == 3
        base = scratch.base
    assert not os.path.exists(base)


def test_substring_compares_words(spark):
    """Words that polynomial hashes confuse, and windows whose hashes are equal though their words differ."""
    for n in (6, 10, 11):
        word, tail = thue_morse(n), " ".join(f"w{i}" for i in range(19))
        rows = [(1, f"{word} {tail}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {tail}"), (3, f"{word}  {tail} more")]
        out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in out} == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (20, "more")}
    blob, starts = b"aa ab aa ac ab", np.array([0, 3, 6, 9, 12])
    for hashes in (np.zeros(5, np.uint64), np.array([1, 2, 1, 3, 2], np.uint64), np.array([1, 2, 1, 2, 2], np.uint64)):
        assert substring_dedup.first_equal(blob, starts, starts + 2, hashes).tolist() == [0, 1, 0, 3, 1]


def test_substring_leaves_no_table(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    with common.Scratch(spark) as scratch:
        assert substring_dedup.remove_repeats(odd, window=3, group=7, scratch=scratch).count() == 11
    assert {t.name for t in spark.catalog.listTables()} == before


def test_substring_odd_ids(spark):
    """Ids as text: numbers are compared as such, the rest comes last."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [("10", text), ("9", text), ("x", text), (None, text)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), texts=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 25), (0, 25), (9, 0), (10, 25)]


def test_deal_keys_are_equal_for_equal_windows():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 5, 400).astype(np.uint64)
    for window in (1, 2, 3, 4, 5, 20):
        at = np.arange(len(word) - window + 1)
        keys, seen = substring_dedup.deal_keys(word, at, window), {}
        assert all(seen.setdefault(tuple(word[i : i + window]), k) == k for i, k in zip(at, keys.tolist(), strict=True))


MEDIUM, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(scores, labels):
    """The chance that a row of label 1 scores above one of label 0."""
    order = np.argsort(scores, kind="stable")
    values = np.asarray(scores)[order]
    ranks = np.empty(len(order))
    for a, b in zip(first := np.flatnonzero(np.diff(values, prepend=-1.0)), [*first[1:], len(values)], strict=True):
        ranks[order[a:b]] = (a + b - 1) / 2
    one = np.asarray(labels) == 1
    return (ranks[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(("name", "label", "recall", "alarms", "least"), [("op2_quality", "quality", 0.97, 0.25, 0.93), ("op8_toxicity", "toxic", 0.88, 0.03, 0.92)])
def test_scores_hold_out(spark, name, label, recall, alarms, least):
    """Recall, false alarms and the area under the curve of held-out rows: a constant answer fails each of them."""
    got = queries.QUERIES[name](spark, LARGE).where("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").select("score", "predicted", F.col(label).alias("label")).toPandas()
    one, zero = got[got["label"] == 1], got[got["label"] == 0]
    assert len(one) >= 50 and len(zero) >= 50
    assert one["predicted"].mean() >= recall and zero["predicted"].mean() <= alarms and auc(got["score"], got["label"]) >= least


def test_language_by_plain_binding(spark):
    """Bind and bundle letter by letter, without counts or buckets: the same vectors, cosines and languages."""
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, "кошка и собака", "ru"), (4, "Über naïve cafés, naïve!", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def vector(text):
        codes = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
        line = [0] + [c for c, before in zip(codes, [0, *codes], strict=False) if c or before] + [0]
        own = {c: langid.letter_vectors(np.array([c]))[0].astype(int) for c in line}
        assert all(abs(own[a] @ own[b]) < 150 for a in own for b in own if a != b)
        return sum(np.roll(own[a], 2) * np.roll(own[b], 1) * own[c] for a, b, c in zip(line, line[1:], line[2:], strict=False))

    plain = {lang: vector(text) for _, text, lang in rows}
    names, prototypes = langid.fit(docs, F.lit(True))
    for k, name in enumerate(names):
        assert np.allclose(prototypes[k], plain[name] / np.linalg.norm(plain[name]), atol=1e-6)
    for text in ("the dog and the cat", "собака", "die maus", "naïve"):
        v = vector(text)
        cosines = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in plain.items()}
        got = langid.predict(spark.createDataFrame([(text,)], "text string"), (names, prototypes)).first()
        assert got["lang_pred"] == max(cosines, key=cosines.get) and abs(got["score"] - max(0.0, max(cosines.values()))) < 1e-5


def test_quality_by_plain_means(spark):
    """Whole texts, character n-grams of any script: the mean of the features' weights under a softmax of two classes."""
    rng = np.random.default_rng(4)
    weights, bias = rng.normal(size=quality.BUCKETS), 0.3
    texts = ["größer als naïve\n\n cafés 東京タワー", "a", "", None, "x" * 9000 + " y", "aa aa  aa"]
    got = [r["score"] for r in quality.score(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), (weights, bias)).collect()]

    def features(text):
        padded = text + "\n" * quality.GRAM
        grams = [padded[i : i + quality.GRAM] for i in range(len(text))]
        ids = []
        for g in grams:
            h = np.zeros(1, np.uint64)
            for k, c in enumerate(g):
                h = common.mix(h + np.uint64(ord(c)) + common.salt(k + 1))
            ids.append(int(h[0] % np.uint64(quality.BUCKETS)))
        for w in text.encode().split():
            buf = np.frombuffer(w, np.uint8)
            ids.append(int(common.span_hashes(buf, np.array([0]), np.array([len(buf)]))[0] % np.uint64(quality.BUCKETS)))
        return ids

    for text, score in zip(texts, got, strict=True):
        ids = features(text or "")
        logit = bias + (np.mean(weights.astype(np.float32)[ids].astype(float)) if ids else 0.0)
        assert abs(score - 1 / (1 + math.exp(-logit))) < 1e-6


def test_training_on_odd_tables(spark, odd, empty):
    """Nulls, copies, very long texts and no rows at all: a model comes out, and it scores all rows."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, y int")
    for docs in (odd, empty):
        for known in (labels, labels.where("false")):
            model = quality.fit(docs, known, F.lit(True), "y")
            assert quality.score(odd, model).where("score BETWEEN 0 AND 1").count() == 11
            model = toxicity.fit(docs, known, F.lit(True), "y")
            assert toxicity.tag(odd, model).where("score BETWEEN 0 AND 1").count() == 11
    assert toxicity.fit(odd, labels, F.lit(True), "y", max_bytes=0)[0].any() == False  # noqa: E712


def test_token_ids_are_those_of_tokenizers(small):
    """Every document of two tables, and random strings over all of Unicode."""
    import duckdb
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(packing.public_tokenizer()), packing.encoder(packing.public_tokenizer())
    texts = [t for d in (small, MEDIUM) for (t,) in duckdb.sql(f"SELECT text FROM '{d}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    rng = random.Random(8)
    blocks = [(32, 127), (160, 591), (0x300, 0x600), (0x900, 0xE00), (0x2000, 0x2100), (0x3040, 0x30FF), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (9, 14)]
    texts += ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    for text, ids in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(ours(text)) == ids.ids


def plain_plan(lengths, size):
    """Best-two-fit piece by piece: the bins as sorted tuples of lengths."""
    left, bins = Counter(lengths), []
    while left:
        gap, own, pool = size, [], Counter(left)
        while gap:
            fits = [n for n in pool if n <= gap]
            if not fits:
                break
            n = max(fits)
            own.append(n)
            pool[n] -= 1
            pool = +pool
            gap -= n
        if gap and len(own) > 1:
            least = own[-1]
            best, pairs = least, [(a + b, max(a, b)) for a in pool for b in pool if a >= b and a + b <= least + gap and (a != b or pool[a] > 1)]
            total, first = max(pairs, default=(0, 0))
            if total > best:
                own[-1:] = [first, total - first]
        for n in own:
            left[n] -= 1
        left = +left
        bins.append(tuple(sorted(own)))
    return sorted(bins)


def test_plan_is_best_two_fit():
    rng = random.Random(9)
    for case in range(60):
        size = rng.choice([10, 24, 64])
        lengths = [min(size, max(1, int(rng.expovariate(1 / (size / 4))))) for _ in range(rng.randrange(1, 80))]
        counts = np.bincount(lengths, minlength=size + 1)
        bins, at = {}, {}
        for n, first, sequence, offset, times in packing.plan(counts, size).tolist():
            for t in range(times):
                bins.setdefault(sequence + t, []).append((offset, n))
            at.setdefault(n, []).extend(range(first, first + times))
        assert all(sorted(x) == list(range(counts[n])) for n, x in at.items()) and sum(map(len, bins.values())) == len(lengths)
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= size
        assert sorted(tuple(sorted(n for _, n in own)) for own in bins.values()) == plain_plan(lengths, size), case


def test_pack_ties_and_repeats(spark):
    """Rows that are all alike, with one id: every piece has a place of its own."""
    got = packing.pack(spark.createDataFrame([(1, "same text")] * 40 + [(None, None)] * 5, "doc_id long, text string").repartition(7), size=8).toPandas()
    places = {(s, o + i) for s, o, n in zip(got["sequence_id"], got["offset"], got["length"], strict=True) for i in range(n)}
    assert len(got) == 45 and len(places) == got["length"].sum()


def test_pipeline_clashing_columns(spark, tmp_path):
    """Every stage gives the columns of its input, whatever they are called, and takes an empty table."""
    import corpus_pipeline as cp

    spark.createDataFrame([(1, "an item that nothing holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"the words of text number {i} are {'abcdefgh'[i % 8]} and so on", "en", 0.5, "x", i, None, "p", 1) for i in range(20)] + [(99, None, "en", 0.5, "x", 0, None, "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, `a.b` int, `__row` string, `__path` string, `rid` int")
    docs.write.parquet(str(tmp_path / "docs"))
    for own in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for name, stage in cp.STAGES:
            got = stage(spark, own, str(tmp_path))
            if name != "best-fit packing":
                assert got.columns == docs.columns, name
                assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in rows} and got.count() >= 19, name
            else:
                assert got.select("doc_id").distinct().count() == 21
            empty = stage(spark, own.where("false"), str(tmp_path))
            assert empty.count() == 0 and empty.columns == got.columns
    assert cp._numbered(spark.read.parquet(str(tmp_path / "docs")), None)[0].count() == 21  # nothing was written: there is no scratch


def test_chat_long_conversation(spark):
    """A thousand turns, one of a million characters."""
    rows = [(1, k, "assistant" if k % 500 == 499 else "user", "x" * 1_000_000 if k == 7 else f"turn {k}") for k in range(1000)]
    out = chat.digests(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert out["n_turns"] == 1000 and out["loss_chars"] == len("turn 499turn 999")


def test_hosts(spark):
    """Trailing dots, ports, users, and bracketed addresses."""
    entries = spark.createDataFrame([("domain", "x.org", "block"), ("host", "[::1]", "block")], "kind string, value string, action string").withColumn("dated", F.lit("2024-01-01").cast("date"))
    urls = ["http://x.org./a", "http://u:p@a.x.org:80/", "http://[::1]:8080/a", "http://[::2]/", "http://xx.org."]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    assert [r["decision"] for r in url_filter.evaluate(pages, entries).orderBy("page_id").collect()] == ["block", "block", "block", "none", "none"]


def test_near_classes_of_a_table(spark):
    """Every text of a table against every other: no class is split or joined wrongly."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{MEDIUM}/documents.parquet'").fetchall()
    bags = [Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 4 else Counter({tuple(w): 1} if w else {}) for w in ((t or "").lower().split() for _, t in rows)]
    sizes, at = [sum(b.values()) for b in bags], {}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, bag in enumerate(bags):
        for shingle in bag:
            at.setdefault(shingle, []).append(i)
    blank = [i for i, n in enumerate(sizes) if not n]
    pairs = {(i, j) for own in at.values() if len(own) > 1 for i, j in combinations(own, 2) if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])} | set(zip(blank, blank[1:], strict=False))
    for i, j in pairs:
        both = sum((bags[i] & bags[j]).values())
        if both >= 0.8 * (sizes[i] + sizes[j] - both) - 1e-9:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    want = {k: min(own) for own in groups.values() for k in own}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_executors_need_no_copy_of_the_subpackage(small, tmp_path):
    from tests import alone

    assert all(alone.rows(small, str(tmp_path), "op1_language_id", "op2_quality", "op4_substring_dedup", "op7_pack", "op8_toxicity"))
