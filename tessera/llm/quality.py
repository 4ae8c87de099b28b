"""Quality classifier: hashed word and character n-gram embeddings, averaged per document, under a softmax.

Features are whitespace words and n-grams of four characters, hashed to BUCKETS rows of a learned embedding table.
A document's vector is the mean of its features' rows; a softmax over two classes follows. Everything is trained by
numpy stochastic gradient descent on a bounded sample. The output is linear in the embeddings, so for scoring the table
is folded into one number per bucket: the difference of the two logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import ascii_space, by_size, col, fold, mix, runs, salt, sampled, span_hashes, texts_within

BUCKETS = 1 << 17
DIM = 16
EPOCHS = 6
SEED = 907
MAX_TRAIN = 4_000  # labelled documents, by expectation, that the embeddings are learned from
MAX_BYTES = 64 << 20  # of text that they may have; documents beyond it, in the order of hashes, are left out whole
GRAM = 4
PIECE = 1 << 18  # characters hashed at once


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text that each belongs to.

    Texts stand apart by line feeds, so a text's features don't depend on its neighbours.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in encoded)])
    buf = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    starts, ends = runs(~ascii_space()[buf])
    words = span_hashes(buf, starts, ends)

    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer(("\n" * GRAM).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + GRAM * owner  # places of the texts' own characters
    grams = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        grams = mix(grams + points[at + k] + salt(k + 1))
    ids = np.concatenate([grams, words]) % np.uint64(BUCKETS)
    return ids.astype(np.int32), np.concatenate([owner, np.searchsorted(begins, starts, "right") - 1])


def _texts(batch: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch]


@F.pandas_udf(StructType([StructField("ids", BinaryType()), StructField("n", BinaryType())]))
def _bag(batch: pd.Series) -> pd.DataFrame:
    out = []
    for text in _texts(batch):
        ids, n = np.unique(features([text])[0], return_counts=True)
        out.append((ids.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["ids", "n"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """The folded logit of each bucket and the bias; zeros where there is nothing to learn from."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out[:] = rng.normal(0, 0.1, (2, DIM))
    steps, total = 0, max(1, EPOCHS * len(bags))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, n = bags[i]
            if not len(ids):
                continue
            step = rate * (1 - steps / total)
            steps += 1
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[ids]
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, mean)
            bias -= step * p
            table[ids] -= (step * share * min(len(ids), 200))[:, None] * back
    return table @ (out[1] - out[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Learn from rows of labels(doc_id, label) where train_rows holds, at most about max_train of them.

    Null labels and ids teach nothing; of repeated ids the smallest label and text count. The ids of the sample are at most
    2 x max_train rows, so broadcasting them is bounded; the driver gets the bags of buckets of at most max_bytes of text.
    """
    rows = labels.where(train_rows).select(F.col("doc_id"), col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    there = rows.count()
    if there > max_train:
        rows = rows.where(sampled(F.col("doc_id"), max_train / there, SEED))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(2 * max_train)
    own = texts_within(docs, rows, SEED, max_bytes)
    got = own.select("doc_id", "label", _bag(F.col("text")).alias("bag")).select("doc_id", "label", "bag.ids", "bag.n").toPandas().sort_values("doc_id")
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(got["ids"], got["n"], strict=True)]
    return train(bags, got["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the probability of label 1 from the whole text; null counts as empty (the bias alone)."""
    weights, bias = model[0].astype(np.float32), model[1]

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = _texts(batch)
            out = np.full(len(texts), bias)
            for part in by_size([len(t) for t in texts], PIECE):
                ids, owner = features(texts[part])
                n = part.stop - part.start
                total = np.bincount(owner, weights[ids], n)
                out[part] += total / np.maximum(np.bincount(owner, minlength=n), 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.select(*[col(c) for c in docs.columns if c != name], of(col(text)).alias(name))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = score(docs.select("doc_id", held_out, "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
