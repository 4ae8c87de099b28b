"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg's identifiers, distributed).

A normalised text is cut into fixed-size byte blocks. Distinct blocks are sorted and numbered, so equal blocks, and only
these, share an integer name. Adjacent names are then paired, the distinct pairs sorted and numbered, and so on until a
document is left with one name: its identity at that level. Two texts are equal exactly when level and name agree.

Blocks of text are shuffled once, as distinct values with map-side combining, so thousands of copies cost no more than
one. Names travel back to the documents along a SHA-256 of the block; if two different blocks ever shared a digest (the
names show it), the join is made on the blocks themselves. So identities are free of collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows with a number each; the aggregate before has dealt them by value, so sorting needs no exchange."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, digest_bits: int = 256, row: str | None = None) -> DataFrame:
    """(rid, doc_id, points, sha, level, name) for every row of docs: rid is the row's own number (column `row`, if given), points the code points
    of the text as given, sha the SHA-256 of the normalised text. Equal (level, name): equal normalised texts.

    What is joined on a key that may be hot is a saved table, so that Spark can split the rows of the hot key."""
    own = docs.select(
        (col(row) if row else F.monotonically_increasing_id()).alias("rid"), col(doc_id).alias("doc_id"),
        F.length(F.coalesce(col(text), F.lit(""))).cast("long").alias("points"), without_space(col(text)).cast("binary").alias("body"),
    )
    n = F.greatest(F.ceil(F.octet_length("body") / block), F.lit(1)).cast("int")
    cut = own.withColumn("n", n).withColumn("sha", F.sha2("body", 256))
    cut = cut.withColumn("blocks", F.expr(f"transform(sequence(0, n - 1), i -> substring(body, i * {block} + 1, {block}))")).drop("body")
    # There is always a block. An inner explode would have Spark look for one first, and cut the text up anew for that.
    rows = cut.select("rid", "doc_id", "points", "sha", "n", F.posexplode_outer("blocks").alias("at", "block"))

    def digest(sha: Column) -> Column:
        return F.unhex(sha) if digest_bits == 256 else F.substring(sha, 1, digest_bits // 4)

    names = _named(rows.select("block").distinct(), ["block"])
    narrow = scratch.save(names.select("name", digest(F.sha2("block", 256)).alias("digest")), "names")
    if narrow.groupBy("digest").count().where("count > 1").isEmpty():
        sha = F.when(F.col("n") == 1, F.col("sha")).otherwise(F.sha2("block", 256))  # a text of one block has its digest already
        joined = rows.withColumn("digest", digest(sha)).drop("block").join(narrow, "digest")
    else:
        whole = scratch.save(names, "blocks")
        joined = rows.join(whole, "block")
    first = F.col("at") == 0
    level = scratch.save(joined.select("rid", "at", "n", "name", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "points", "sha")]), "level0")
    about = level.where(first).select("rid", "doc_id", "points", "sha")
    done = [level.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    most, left, depth = *level.agg(F.max("n"), F.count_if(F.col("n") > 1)).first(), 0
    level = level.select("rid", "at", "n", "name")
    while (most or 1) > 1:
        depth += 1
        half = level.where("n > 1").groupBy("rid", F.shiftright("at", 1).alias("at"), F.expr("(n + 1) div 2").cast("int").alias("n"))
        half = half.agg(*[F.coalesce(F.max(F.when(F.col("at") % 2 == side, F.col("name"))), F.lit(-1)).alias(c) for side, c in ((0, "left"), (1, "right"))])
        half = scratch.save(half, f"pairs{depth}", left)
        names = scratch.save(_named(half.select("left", "right").distinct(), ["left", "right"]), f"names{depth}", left)
        level = scratch.save(half.join(names, ["left", "right"]).select("rid", "at", "n", "name"), f"level{depth}", left)
        scratch.drop(f"pairs{depth}", f"names{depth}")
        done.append(level.where("n = 1").select("rid", F.lit(depth).alias("level"), "name"))
        most = (most + 1) // 2
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return about.join(whole, "rid")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, digest_bits: int = 256, row: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and `row` if given: a column of distinct long
    numbers that tells rows apart and says which is first.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; a null text counts as empty. Of equal texts the row
    with the most code points stays, then the smallest doc_id (nulls last), then the first row. Of rows that share a
    doc_id at most one per group stays. An empty table gives no rows; other columns of docs don't matter. The result reads
    tables of `scratch`, which the caller may close when done.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.save(identities(docs, scratch, doc_id, text, block, digest_bits, row), "found")
    scratch.drop("names", "blocks")
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    groups = found.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    out = found.join(scratch.save(groups, "groups"), ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("first.rid"))).alias("kept"), F.col("sha").alias("text_sha256"), *([F.col("rid").alias(row)] if row else []),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
