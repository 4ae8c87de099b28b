"""Toxic spans by a linear-chain conditional random field over the tokens of each sentence.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, lower-cased; a sentence ends at . ! ? or a line feed.
Document labels are turned into token labels: a token of a toxic document is labelled toxic where its word, or its stem
of five bytes, is significantly commoner in toxic than in other documents (log-likelihood ratio). The field has two
states and hashed features (word, stem, ending, and the words before and after); it is trained by numpy gradient steps.
Forward-backward marginals give each token's probability; a document's score is the largest of them, and runs of tokens
at 0.5 or more are its offending spans. Documents are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, col, fold, mix, sampled, span_hashes, texts_within
from .near_dedup import M, ROWS, bag, shingles, signatures

BUCKETS = 1 << 18
SEED = 411
MAX_TOXIC, MAX_CLEAN = 1_500, 3_000  # labelled documents, by expectation, of either kind in the training sample
MAX_BYTES = 64 << 20  # of text that the training sample may have; documents beyond it, in the order of hashes, are left out whole
EVIDENCE = 20.0  # least log-likelihood ratio of a word or stem
STEM = 5
PIECE = 1 << 19  # bytes tagged at once


def _lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of two-byte Latin letters, byte for byte."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    after = np.concatenate([[0], buf[:-1]])
    out[(after == 0xC3) & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
    return out


def tokens(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Tokens of all texts: byte start and end in the joined buffer, text number, sentence number and hashes."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    buf = _lower(raw)
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    inside = word[buf]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.zeros(256, bool)
    stop[[10, 33, 46, 63]] = True
    stops = np.concatenate([[0], np.cumsum(stop[buf])])
    return {
        "raw": raw, "buf": buf, "begins": begins, "start": starts, "end": ends,
        "doc": np.searchsorted(begins, starts, "right") - 1,
        "sentence": stops[starts],
        "word": span_hashes(buf, starts, ends),
        "stem": span_hashes(buf, starts, np.minimum(ends, starts + STEM)),
        "ending": span_hashes(buf, np.maximum(starts, ends - 3), ends),
    }


def observed(t: dict[str, np.ndarray]) -> np.ndarray:
    """Buckets of the features of each token, one row a token."""
    word, same = t["word"], np.concatenate([t["sentence"][1:] == t["sentence"][:-1], [False]])
    before, after = np.zeros_like(word), np.zeros_like(word)
    if len(word):
        before[1:] = np.where(same[:-1], word[:-1], 0)
        after[:-1] = np.where(same[:-1], word[1:], 0)
    kinds = [word, t["stem"], t["ending"], before, after]
    return np.stack([mix(x + np.uint64(k * 0x9E3779B9)) % np.uint64(BUCKETS) for k, x in enumerate(kinds)], 1).astype(np.int32)


def chains(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each sentence."""
    if not len(sentence):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sentence)]]))


def forward_backward(emit: np.ndarray, first: np.ndarray, length: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token and the expected number of each transition.

    emit is the score of state 1 of each token, state 0 scoring 0. All sentences step together, the longest first, so
    that those still running are a prefix; messages are kept as shares that sum to 1.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    most = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, most + 1), "right")
    up = np.empty((len(emit), 2))
    factor = np.exp(np.clip(emit, -40, 40))
    kernel = np.exp(move)
    for step in range(most):
        at = first[: alive[step]] + step
        if step:
            a0, a1 = up[at - 1, 0], up[at - 1, 1]
            b0, b1 = a0 * kernel[0, 0] + a1 * kernel[1, 0], a0 * kernel[0, 1] + a1 * kernel[1, 1]
        else:
            b0, b1 = np.full(len(at), np.exp(start[0])), np.full(len(at), np.exp(start[1]))
        b1 = b1 * factor[at]
        total = b0 + b1
        up[at, 0], up[at, 1] = b0 / total, b1 / total
    marginal, counts = np.empty(len(emit)), np.zeros((2, 2))
    down = np.ones((len(first), 2))
    for step in range(most - 1, -1, -1):
        n = alive[step]
        at = first[:n] + step
        here = up[at] * down[:n]
        marginal[at] = here[:, 1] / here.sum(1)
        if step:
            d0, d1 = down[:n, 0], down[:n, 1] * factor[at]
            a = up[at - 1]
            pair = np.stack([a[:, 0] * kernel[0, 0] * d0, a[:, 0] * kernel[0, 1] * d1, a[:, 1] * kernel[1, 0] * d0, a[:, 1] * kernel[1, 1] * d1], 1)
            counts += (pair / pair.sum(1, keepdims=True)).sum(0).reshape(2, 2)
            back = np.stack([kernel[0, 0] * d0 + kernel[0, 1] * d1, kernel[1, 0] * d0 + kernel[1, 1] * d1], 1)
            down[:n] = back / back.sum(1, keepdims=True)
    return marginal, counts


def _evidence(key: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Those keys whose share of toxic documents exceeds that of clean ones with enough evidence."""
    _, first = np.unique(key ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)  # once a document
    names, back = np.unique(key[first], return_inverse=True)
    a = np.bincount(back, labels[doc[first]])
    b = np.bincount(back) - a
    n, m = labels.sum(), (1 - labels).sum()
    pa, pb, p = a / n, b / m, (a + b) / (n + m)
    ll = lambda k, of, q: k * np.log(np.maximum(q, 1e-12)) + (of - k) * np.log(np.maximum(1 - q, 1e-12))
    ratio = 2 * (ll(a, n, pa) + ll(b, m, pb) - ll(a, n, p) - ll(b, m, p))
    return names[(pa > 10 * pb) & (ratio >= EVIDENCE)]


def _in_pieces(texts: list[bytes]) -> dict[str, np.ndarray]:
    """tokens() of many texts, PIECE bytes at a time, so that the memory taken is that of the tokens."""
    parts, sentence = [], 0
    for part in by_size([len(t) for t in texts], PIECE):
        t = tokens(texts[part])
        own = {k: t[k] for k in ("word", "stem", "ending")} | {"doc": t["doc"] + part.start, "sentence": t["sentence"] + sentence}
        sentence += int(t["sentence"][-1]) + 2 if len(t["sentence"]) else 0
        parts.append(own)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _apart(texts: list[bytes], labels: np.ndarray) -> list[int]:
    """Numbers of the texts that are no near copy of an earlier one of their label (no band of their signatures agrees):
    the words of a text that was copied often would else pass for evidence."""
    seen, keep = set(), []
    for part in by_size([len(t) for t in texts], PIECE):
        of = signatures(*bag(*shingles(texts[part])), part.stop - part.start)
        for i, row in enumerate(of, part.start):
            own = {(int(labels[i]), k, row[k : k + ROWS].tobytes()) for k in range(0, M, ROWS)}
            if seen.isdisjoint(own):
                keep.append(i)
            seen |= own
    return keep


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 4_000) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Feature weights, bias, transition and start scores, learned from whole texts and their 0/1 labels."""
    weights, bias, move, start = np.zeros(BUCKETS), -5.0, np.zeros((2, 2)), np.zeros(2)
    if not labels.sum() or not (1 - labels).sum():
        return weights, bias, move, start
    t = _in_pieces(texts)
    gold = np.zeros(len(t["word"]), bool)
    for kind in ("word", "stem"):
        gold |= (labels[t["doc"]] == 1) & np.isin(t[kind], _evidence(t[kind], t["doc"], labels))
    first, length = chains(t["sentence"])
    rng = np.random.default_rng(SEED)
    has = np.add.reduceat(gold.astype(np.int64), first) > 0 if len(first) else np.empty(0, bool)
    rest = np.flatnonzero(~has)
    chosen = np.concatenate([np.flatnonzero(has), rng.permutation(rest)[: 8 * max(int(has.sum()), 2_000)]])
    ids = observed(t)
    squares, small = np.full(BUCKETS, 1e-6), [np.full((2, 2), 1e-6), np.full(2, 1e-6), 1e-6]
    for _ in range(epochs):
        chosen = rng.permutation(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // batch)):
            size = length[part]
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            at = np.repeat(first[part] - begin, size) + np.arange(size.sum())
            own, y = ids[at], gold[at].astype(float)
            p, moves = forward_backward(weights[own].sum(1) + bias, begin, size, move, start)
            slope = np.bincount(own.ravel(), np.repeat(y - p, own.shape[1]), BUCKETS) / len(part) - 1e-6 * weights
            squares += slope * slope
            weights += 0.5 * slope / np.sqrt(squares)
            inner = np.ones(len(at), bool)
            inner[begin] = False
            inner = np.flatnonzero(inner)
            seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4).reshape(2, 2)
            for k, g in enumerate([(seen - moves) / len(part), np.array([(p[begin] - y[begin]).sum(), (y[begin] - p[begin]).sum()]) / len(part), (y - p).sum() / len(part)]):
                small[k] = small[k] + g * g
                by = 0.2 * g / np.sqrt(small[k])
                if k == 0:
                    move = move + by
                elif k == 1:
                    start = start + by
                else:
                    bias = bias + float(by)
    return weights, bias, move, start


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES):
    """Learn from a bounded sample of labels(doc_id, label) where train_rows holds; null labels and ids teach nothing.

    Of repeated ids the largest label and the smallest text count, of equal texts and near copies one is used. The ids of the
    sample are bounded, so they are broadcast; the driver gets the sample's texts only, at most max_bytes of them.
    """
    rows = labels.where(train_rows).select(F.col("doc_id"), col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    there = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    keep = F.when(F.col("label") == 1, sampled(F.col("doc_id"), min(1.0, max_toxic / max(there.get(1, 0), 1)), SEED))
    rows = rows.where(keep.otherwise(sampled(F.col("doc_id"), min(1.0, max_clean / max(there.get(0, 0), 1)), SEED)))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * (max_toxic + max_clean))
    got = texts_within(docs, rows, SEED, max_bytes).toPandas().sort_values("doc_id").drop_duplicates("text")
    if got.empty:
        return train([], np.empty(0, np.int64))
    texts, known = [x.encode("utf-8", "surrogatepass") for x in got["text"]], got["label"].to_numpy(np.int64)
    keep = _apart(texts, known)
    return train([texts[i] for i in keep], known[keep])


def tag(docs: DataFrame, model, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of docs, score (0 without tokens) and, if asked for, spans: array<struct<start,stop,score>>, the code
    point offsets of runs of tokens at 0.5 or more. A null text counts as empty. Columns of those names are replaced."""
    weights, bias, move, start = model
    weights = weights.astype(np.float32)
    kind = "score double" + ", spans array<struct<start:long,stop:long,score:double>>" * spans

    @F.pandas_udf(kind)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in batch]
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            for part in by_size([len(x) for x in texts], PIECE):
                t = tokens(texts[part])
                if not len(t["word"]):
                    continue
                ids, emit = observed(t), np.full(len(t["word"]), bias)
                for k in range(ids.shape[1]):
                    emit += weights[ids[:, k]]
                p, _ = forward_backward(emit, *chains(t["sentence"]), move, start)
                np.maximum.at(scores[part], t["doc"], p)
                if spans and (p >= 0.5).any():
                    points = np.concatenate([[0], np.cumsum((t["raw"] & 0xC0) != 0x80)])
                    hot = np.flatnonzero(p >= 0.5)
                    split = np.flatnonzero((np.diff(hot) > 1) | (np.diff(t["doc"][hot]) > 0)) + 1
                    for run in np.split(hot, split):
                        doc = t["doc"][run[0]]
                        origin = points[t["begins"][doc]]
                        found[part.start + doc].append((int(points[t["start"][run[0]]] - origin), int(points[t["end"][run[-1]]] - origin), float(p[run].max())))
            out = pd.DataFrame({"score": np.clip(scores, 0, 1)})
            if spans:
                out["spans"] = [[{"start": a, "stop": b, "score": s} for a, b, s in own] for own in found]
            yield out

    names = ["score", "spans"][: 1 + spans]
    keep = [col(c) for c in docs.columns if c not in names]
    out = docs.select(*keep, of(col(text)).alias("__tagged"))
    return out.select(*keep, *[F.col(f"__tagged.{n}").alias(n) for n in names])


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    tagged = tag(docs.select("doc_id", held_out, "text"), model).drop("text")
    return tagged.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))
