"""From documents to packed training sequences: each stage works on all that its predecessor kept.

A document is a row: a stage numbers the rows of its input and decides on each, so repeated and null doc_ids are no matter.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, exact_dedup, langid, near_dedup, packing
from tessera.llm.common import Scratch, col, fold

MOST_FILES = 10_000  # files of a table whose list is small enough to be sent to the executors
_OPEN: list[Scratch] = []  # tables that results of stages read


def _scratch(spark: SparkSession) -> Scratch:
    _OPEN.append(Scratch(spark))
    return _OPEN[-1]


def _close(spark: SparkSession) -> None:
    """Delete what the stages have left, when their results are no longer read."""
    while _OPEN:
        _OPEN.pop().close()


def _free(docs: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a number for each row, the same at every read, and its column's name.

    The rows of a Parquet table are numbered by file and place in the file, however it is split, so nothing is written. Other
    inputs, and tables of more than MOST_FILES files, are written with their numbers.
    """
    row, files = _free(docs, "__row"), _numbered_files(docs)
    if files is None:
        return scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row
    path = _free(docs, "__path")
    here = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row)).join(F.broadcast(files), F.col(path) == F.col("__file"))
    return here.select(*map(col, docs.columns), (F.shiftleft(F.col("__number"), 40) + F.col(row)).alias(row)), row


def _numbered_files(docs: DataFrame) -> DataFrame | None:
    """(__file, __number) of a scanned table's files; None if docs is anything else or has too many."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or _free(docs, "_metadata") != "_metadata":
        return None
    try:
        found = docs.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index")).select("p").distinct().limit(MOST_FILES + 1).collect()
    except AnalysisException:  # a source without such metadata
        return None
    rows = [(r["p"], k) for k, r in enumerate(sorted(found))]
    return docs.sparkSession.createDataFrame(rows, "__file string, __number long") if len(rows) <= MOST_FILES else None


def _without(rows: DataFrame, row: str, numbers: DataFrame, scratch: Scratch) -> DataFrame:
    """Numbered rows without those numbers. These are written first, so that Spark knows their size: it sends them to the
    executors if they are below its broadcast threshold, and shuffles beyond it."""
    gone = _free(rows, "__gone")
    found = scratch.save(numbers.select(col(row).alias(gone)).distinct(), "gone")
    return rows.join(found, col(row) == col(gone), "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter (or a text) or unlike every language go. All rows of
    a repeated id are judged one by one; columns keep their names and values, whatever they are called."""
    scratch = _scratch(spark)
    learned = langid.training(docs, fold(F.col("doc_id"), 3) != 1)
    languages, prototypes, units = langid.profiles(learned)
    rows, row = _numbered(docs, scratch)
    names = _free(rows, "__language"), _free(rows, "__likeness")
    found = langid.predict(rows.select(row, "text"), (languages, prototypes), like=(units, langid.least_likeness(learned, units)), names=names)
    return _without(rows, row, found.where(col(names[0]) == "und"), scratch)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, null and empty ones being equal; ids may be repeated or null."""
    scratch = _scratch(spark)
    rows, row = _numbered(docs, scratch)
    return _without(rows, row, exact_dedup.dedup(rows.select("doc_id", "text", row), row=row, scratch=scratch).where("NOT kept"), scratch)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays; ids may be repeated or null."""
    scratch = _scratch(spark)
    rows, row = _numbered(docs, scratch)
    return _without(rows, row, near_dedup.near_classes(rows.select("doc_id", "text", row), row=row, scratch=scratch).where("NOT kept"), scratch)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, judged row by row; a null text holds none."""
    scratch = _scratch(spark)
    rows, row = _numbered(docs, scratch)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(rows, row, decontam.matches(rows.select(row, "text"), items, doc_id=row).select(F.col("doc_id").alias(row)), scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; null and empty texts are one end token each."""
    return packing.pack(docs.select("doc_id", "text"), scratch=_scratch(spark))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", dedup_exact),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the shared folder and read again; what only earlier stages needed is deleted."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        _close(spark)
        scratch.drop(f"stage{k - 1}")
    return docs


#: No SQL can express the trained and hashed stages; tests hold them against brute force.
ORACLE_SQL = None
