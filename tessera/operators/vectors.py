"""Vector operators: similarity as expressions, nearest neighbours in blocks, isolation and twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    length = F.sqrt(dot(a, a))
    return F.when(length < 1e-12, F.lit(1.0)).otherwise(length)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(key, neighbour, similarity, place): the k nearest vectors of each query by cosine, itself left out, ties by key.

    The queries are a stated set, handed to the executors in blocks of `block` rows; each block makes one pass over the
    vectors, a partition keeps its k best per query (a matrix product), and a window over k rows a partition finishes.
    So neither side is broadcast whole, and no task holds more than a block and a batch.
    """
    kind = vectors.schema[key].dataType.simpleString()
    found = None
    wanted = queries.select(key, vector).toLocalIterator(prefetchPartitions=True)
    while rows := [r for _, r in zip(range(block), wanted, strict=False)]:
        ids, base = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        base /= np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-12)

        def near(pages: Iterator[pd.DataFrame], ids=ids, base=base) -> Iterator[pd.DataFrame]:
            for page in pages:
                if not len(page):
                    continue
                page = page.sort_values(key)  # so that of equal similarities the smallest keys come first
                own = np.stack(page[vector].to_numpy()).astype(np.float64)
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                names = page[key].to_numpy()
                similar = np.round(base @ own.T, 12)  # the last bits depend on the shape of the blocks
                similar[ids[:, None] == names[None, :]] = -np.inf
                n = min(k, len(names))
                least = -np.partition(-similar, n - 1, axis=1)[:, n - 1 : n]
                above, level = similar > least, similar == least
                keep = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= n - above.sum(1, keepdims=True)))
                row, at = np.nonzero(keep)
                out = pd.DataFrame({key: ids[row], "neighbour": names[at], "similarity": similar[row, at]})
                yield out[np.isfinite(out["similarity"])]

        part = vectors.select(key, vector).mapInPandas(near, f"{key} {kind}, neighbour {kind}, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"{key} {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def isolation(neighbours: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(key, similarity) with the k-th neighbour; the smallest are the loneliest."""
    return neighbours.where(F.col("place") == k).select(key, "similarity")


def twins(neighbours: DataFrame, about: DataFrame, low: float, high: float, key: str = "vec_id", group: str = "label") -> DataFrame:
    """Unordered pairs (a, b, similarity) within a band of similarity whose groups differ."""
    left, right = about.select(F.col(key), F.col(group).alias("ga")), about.select(F.col(key).alias("neighbour"), F.col(group).alias("gb"))
    both = neighbours.where(F.col("similarity").between(low, high)).join(left, key).join(right, "neighbour").where("ga <> gb")
    return both.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _units(page: pd.Series) -> np.ndarray:
    own = np.stack(page.to_numpy()).astype(np.float64)
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, cells: int, key: str, vector: str, most: int = 20_000, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of k-means by cosine, fitted on at most `most` vectors (those with the smallest hashes of their keys), and
    these vectors."""
    got = vectors.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).select(vector).limit(most).toPandas()
    x = _units(got[vector])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        empty = np.bincount(at, minlength=len(centres)) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, x


def probes_for(centres: np.ndarray, x: np.ndarray, k: int, share: float, queries: int = 1000) -> int:
    """How many of its nearest cells a query must be compared with, so that `share` of the sample's own k nearest neighbours
    lie in them; neighbours among all rows lie nearer, so more of these are found."""
    asked = x[: min(queries, len(x))]
    similar = asked @ x.T
    similar[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argsort(-similar, axis=1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return len(centres)
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    place = order[np.arange(len(asked))[:, None], (x @ centres.T).argmax(1)[top]]
    return 1 + int(np.quantile(place, share, method="higher"))


def knn_inverted(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, probes: int = 0, share: float = 0.95, group: int = 8192, most: int = 20_000) -> DataFrame:
    """(key, neighbour, similarity, place): the k nearest vectors of each query by cosine among those of the `probes` cells
    nearest to it, itself left out, ties by key.

    Every vector is in the cell of its nearest centre, of about as many cells as the root of their number. How many cells are
    probed is found on the sample that the centres are fitted on: enough for `share` of its neighbours. So a query meets few of the vectors, and both sides are shuffled by cell instead of one pass over all
    vectors a block. A cell of many vectors or queries is split into groups of at most about `group` of each, every part of
    the one side meeting every part of the other: no task holds a whole cell. knn() is the exact form.
    """
    kind = vectors.schema[key].dataType.simpleString()
    empty = vectors.sparkSession.createDataFrame([], f"{key} {kind}, neighbour {kind}, similarity double, place int")
    n = vectors.count()
    if not n:
        return empty
    centres, own = centroids(vectors, cells or min(4096, max(1, int(n**0.5))), key, vector, most)
    near = min(len(centres), probes or probes_for(centres, own, k, share))

    def cells_of(count: int):
        @F.pandas_udf("array<int>")
        def of(batch: pd.Series) -> pd.Series:
            similar = _units(batch) @ centres.T
            return pd.Series(list(np.argsort(-similar, axis=1, kind="stable")[:, :count].astype(np.int32)))

        return of

    def dealt(rows: DataFrame, count: int, other: DataFrame, mine: str, theirs: str) -> DataFrame:
        """Rows by cell, their own part of it, and all parts of the other side."""
        own = rows.select(F.col(key).alias(f"{mine}_key"), F.col(vector).alias(f"{mine}_vector"), F.explode_outer(cells_of(count)(F.col(vector))).alias("cell"))
        return own.join(other, "cell").select(F.col("cell").alias("cell"), F.col(f"{mine}_key").alias(key), F.col(f"{mine}_vector").alias(vector), F.pmod(F.xxhash64(F.col(f"{mine}_key")), F.col(f"n_{mine}")).alias(mine), F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col(f"n_{theirs}") - 1)).alias(theirs))

    parts = lambda rows, count, name: rows.select(F.explode_outer(cells_of(count)(F.col(vector))).alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / group).cast("long").alias(name))
    sizes = F.broadcast(parts(vectors, 1, "n_a").join(parts(queries, near, "n_b"), "cell"))  # a row a cell
    left = dealt(vectors.select(key, vector), 1, sizes, "a", "b")
    right = dealt(queries.select(key, vector), near, sizes, "b", "a")

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({key: [], "neighbour": [], "similarity": []})
        own = own.sort_values(key)
        names, x = own[key].to_numpy(), _units(own[vector])
        out = []
        for begin in range(0, len(asked), 1024):
            part = asked.iloc[begin : begin + 1024]
            ids = part[key].to_numpy()
            similar = np.round(_units(part[vector]) @ x.T, 12)
            similar[ids[:, None] == names[None, :]] = -np.inf
            top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(ids)), top.shape[1])
            found = pd.DataFrame({key: ids[row], "neighbour": names[top.ravel()], "similarity": similar[row, top.ravel()]})
            out.append(found[np.isfinite(found["similarity"])])
        return pd.concat(out)

    on = ["cell", "a", "b"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(best, f"{key} {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    n = exact.count()
    return exact.join(found, [key, "neighbour"], "left_semi").count() / n if n else 1.0
