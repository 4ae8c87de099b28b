"""Shared pieces: scratch tables in the cluster's shared folder, fold membership, vectorised text hashing."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20  # rows and bytes that a Python worker gets at once while a table is saved
FILE_ROWS = 500_000  # narrow rows of a file, where their number is known before


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, where all is one machine, may leave
    it unset and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="tessera-"))
    return _FALLBACK[0]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what is run inside, so that Python workers stay small."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder, so that later steps survive the loss of any executor.

    The rows that an operator returns read some of them, so they stay until close(): call it, or use the object in a
    `with` statement, when these rows have been written or collected.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base, self._tables = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write a table and read it; `rows`, if known, says how many files at most are worth while: one per FILE_ROWS."""
        path = f"{self.base}/{name}"
        if rows is not None:
            df = df.coalesce(1 + rows // FILE_ROWS)
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def buckets(self, df: DataFrame, name: str, by: str, n: int) -> DataFrame:
        """Like save(), in n buckets sorted by a column, so that joins on it move only the other side. Spark keeps bucketed
        tables in its catalog; drop() and close() take it out again."""
        table = f"{self.base.rpartition('/')[2].replace('-', '_')}_{name}"
        with small_batches(self.spark):
            writer = df.write.bucketBy(n, by).sortBy(by).option("path", f"{self.base}/{name}").option("compression", "zstd")
            writer.saveAsTable(table)
        self._tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self._tables.pop(name)}`")
            self._delete(f"{self.base}/{name}")

    def close(self) -> None:
        self.drop(*list(self._tables))
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def once(key: str, build: Callable[[], object]) -> object:
    """build(), once in a process: functions are shipped by value, so a cache among their globals would last for one task."""
    kept = vars(sys).setdefault("_tessera_once", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(key: Column, share: float | Column, seed: int) -> Column:
    """True for about this share of the keys, the same ones on every run."""
    least = F.round(share * 1_000_000) if isinstance(share, Column) else int(round(share * 1_000_000))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < least


def texts_within(docs: DataFrame, rows: DataFrame, seed: int, max_bytes: int) -> DataFrame:
    """doc_id, label, text of docs(doc_id, text) for a bounded table rows(doc_id, label): one text an id (the smallest), null
    texts aside. Documents are taken in the order of hashes as long as their bytes add up to max_bytes at most; the others
    are left out whole. Only ids and sizes of the rows come to the driver."""
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    place = F.xxhash64("doc_id", F.lit(seed)).alias("place")
    size = own.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.max(F.octet_length("text")).alias("size"), place).toPandas()
    size = size.sort_values(["place", "doc_id"])
    chosen = size[size["size"].cumsum() <= max_bytes][["doc_id", "label"]]
    few = docs.sparkSession.createDataFrame(list(chosen.itertuples(index=False, name=None)), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, label int")
    return own.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


# -- vectorised hashing of many texts at once ------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(k: int, by: int = 0x9E3779B97F4A7C15) -> np.uint64:
    """k times an odd constant, modulo 2**64."""
    return np.uint64(k * by & 0xFFFFFFFFFFFFFFFF)


LONG = 64  # bytes; longer spans are hashed one by one
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]: its blocks of eight bytes pass through the finaliser one after another.

    Spans of up to eight bytes and one length never collide. Spans of more than LONG bytes take BLAKE2b, so that no
    pattern of a long text makes collisions likely. Different seeds give independent hashes.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _MULT + np.uint64(seed * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    at, some = 0, np.flatnonzero(size <= LONG)
    while len(some):
        left = size[some] - at
        some, left = some[left > 0], left[left > 0]
        block = words[starts[some] + at] & _MASKS[np.minimum(left, 8)]
        out[some] = mix((out[some] ^ block) * _MULT + np.uint64(at + 1))
        at += 8
    for k in np.flatnonzero(size > LONG):
        own = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[k] = int.from_bytes(own.digest(), "little")
    return out


def ascii_space() -> np.ndarray:
    """A table over bytes: True for the characters of [\\x20\\x09-\\x0D]."""
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def by_size(sizes: list[int], most: int):
    """Slices of a list, each of at most `most` in sum or one element."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))
