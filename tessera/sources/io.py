"""Sources and sinks: schema checks, tolerant readers, idempotent writes and resume."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that is a column, by exact name, then without regard to case."""
    for name in candidates:
        if name in df.columns:
            return name
    lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in lower:
            return lower[name.lower()]
    raise KeyError(f"none of {candidates} in {df.columns}")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV (gzip too) under a schema, malformed lines dropped."""
    return spark.read.csv(path, schema=schema, header=header, mode="DROPMALFORMED")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gzip too) under a schema; blank and malformed lines are dropped, and splits fall between lines."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def lookup(df: DataFrame, key: str, kind: str = "int") -> DataFrame:
    """Rows whose key casts; the others are skipped."""
    return df.withColumn(key, F.col(key).try_cast(kind)).where(F.col(key).isNotNull())


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those rows whose key it doesn't hold yet; of equal new keys one stays."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One JSON document a row, in a folder per key."""
    df.select(F.col(key), F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def stable_hash(values: dict) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()[:16]


def once(spark: SparkSession, path: str, inputs: dict, build, force: bool = False) -> DataFrame:
    """The table at path if it was built from these inputs, else build() written there with a manifest beside it."""
    manifest, tag = f"{path}.manifest", stable_hash(inputs)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    if force or not there or spark.read.text(manifest).first()["value"] != tag:
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        spark.createDataFrame([(tag,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(path)


def months(start: Column, stop: Column) -> Column:
    """The first days of all months from start to stop."""
    return F.explode(F.sequence(F.trunc(start, "month"), F.trunc(stop, "month"), F.expr("interval 1 month")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; for results that come in parts, streams included (foreachBatch)."""
    df.write.mode("append").json(path)


def put_objects(objects: DataFrame, base: str, name: str = "name", data: str = "data") -> DataFrame:
    """Write each row's bytes as a file of its own below `base` (any file system that Arrow knows): name, ok, error.

    A task that runs again overwrites what it wrote. An object that can't be written is a row with its error."""

    def put(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for page in pages:
            rows = []
            for key, body in zip(page["name"], page["data"], strict=True):
                try:
                    store.create_dir(f"{root}/{key}".rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{root}/{key}") as out:
                        out.write(body)
                    rows.append((key, True, None))
                except Exception as e:
                    rows.append((key, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["name", "ok", "error"])

    return objects.select(F.col(name).alias("name"), F.col(data).alias("data")).mapInPandas(put, "name string, ok boolean, error string")


def guarded(df: DataFrame, most_bytes: int) -> DataFrame:
    """df if the optimiser expects it to read at most so many bytes, else an error before anything is read."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected > most_bytes:
        raise RuntimeError(f"the query would read about {expected} bytes; the limit is {most_bytes}")
    return df


def first_available(builders: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read and has rows; the last error if none can, the last empty source if all are empty."""
    found, error = None, None
    for build in builders:
        try:
            found = build()
            if not found.isEmpty():
                return found
        except Exception as e:
            error = e
    if found is None and error is not None:
        raise error
    return found


def saved(spark: SparkSession, base: str, job: str) -> DataFrame:
    """The result table that a finished job left under its id; a job without one raises."""
    return spark.read.parquet(f"{base}/{job}")


class Patcher:
    """Replaces pieces of a page by patterns; a required pattern that isn't found raises, so no page is half updated."""

    def __init__(self, page: str):
        self.page, self.hits = page, {}

    def replace(self, label: str, pattern: str, replacement: str, count: int = 1, required: bool = True) -> Patcher:
        page, n = re.subn(pattern, replacement, self.page, count=count)
        self.hits[label] = n
        if required and not n:
            raise ValueError(f"{label}: {pattern!r} isn't in the page")
        self.page = page
        return self


def to_pieces(data: bytes, size: int) -> list[str]:
    """Gzip, base64, and cut into pieces of at most `size` characters."""
    text = base64.b64encode(gzip.compress(data, mtime=0)).decode()
    return [text[i : i + size] for i in range(0, len(text), size)]


def from_pieces(pieces: list[str]) -> bytes:
    return gzip.decompress(base64.b64decode("".join(pieces)))


def gate(found: DataFrame, passes) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and all others, null results among them."""
    good = F.coalesce(passes, F.lit(False))
    return found.where(good), found.where(~good)
