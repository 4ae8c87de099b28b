"""Statistics: quantile buckets, bootstrap intervals and their verdict, Monte Carlo, permutation and weight search.

Random work is dealt as numbered chunks; the seed of a chunk is a base plus its number, so results don't depend on
partitioning, and what comes back is a sum per group or one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quantile_bucket(value: Column, edges: Column, names: tuple[str, ...]) -> Column:
    """Right-closed buckets from ascending edges (an array column), the lowest included."""
    out = F
    for k, name in enumerate(names[:-1]):
        out = out.when(value <= F.get(edges, F.lit(k)), name)
    return out.otherwise(names[-1])


def log_loss(label: Column, p: Column, least: float = 1e-6) -> Column:
    """The mean log loss of probabilities p of a boolean label, as an aggregate; p is kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.avg(-F.when(label, F.log(p)).otherwise(F.log(1 - p)))


def bootstrap_ci(rows: DataFrame, bucket: str, value: str, resamples: int = 1000, seed: int = 42, least: int = 5) -> DataFrame:
    """(bucket, n, median, ci_low, ci_high): percentile interval of the bootstrap median.

    The median of a resample of n rows is their middle order statistic, and that of n uniform ranks is a beta variable. So
    `resamples` draws need only n, and the interval's ends are two ranks of the bucket; the quantiles at these ranks are
    read off the sorted values. No row is copied, and no bucket meets in one task. Below `least` rows the interval is the
    median. Null values count for nothing; a bucket without others has nulls.
    """
    from .relational import quantiles

    counts = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(value).alias("n"))

    @F.pandas_udf("low double, high double")
    def ends(sizes: pd.Series) -> pd.DataFrame:
        out = []
        for n in sizes:
            if n < least:
                out.append((0.5, 0.5))
                continue
            rng = np.random.default_rng(seed)
            k = (n + 1) // 2
            first = rng.beta(k, n - k + 1, resamples)
            second = first + (1 - first) * rng.beta(1, n - k, resamples) if n % 2 == 0 else first
            middle = (np.minimum(np.floor(first * n), n - 1) + np.minimum(np.floor(second * n), n - 1)) / 2
            out.append(tuple(np.percentile(middle, (2.5, 97.5)) / (n - 1)))
        return pd.DataFrame(out, columns=["low", "high"])

    wanted = counts.withColumn("__e", ends("n")).select("bucket", "n", "__e.low", "__e.high")
    found = quantiles(rows.select(F.col(bucket).alias("bucket"), value), "bucket", value, [0.5, "low", "high"], ["median", "ci_low", "ci_high"], wanted.select("bucket", "low", "high"))
    both = counts.join(found.withColumnRenamed("bucket", "__b"), F.col("bucket").eqNullSafe(F.col("__b")), "left")
    return both.select("bucket", "n", "median", "ci_low", "ci_high")


def ci_verdict(intervals: DataFrame, least: int = 100) -> DataFrame:
    """(verdict, reason): accepted if no two buckets overlap; rejected if any do, with one bucket, or a small bucket."""
    a, b = intervals.alias("a"), intervals.alias("b")
    overlap = a.join(b, (F.col("a.bucket") < F.col("b.bucket")) & ~((F.col("a.ci_high") < F.col("b.ci_low")) | (F.col("b.ci_high") < F.col("a.ci_low"))))
    n = intervals.agg(F.count("*").alias("buckets"), F.min("n").alias("least"))
    seen = n.crossJoin(overlap.agg(F.count("*").alias("overlaps")))
    reason = F.when(F.col("buckets") < 2, "single bucket").when(F.col("least") < least, "small bucket").when(F.col("overlaps") > 0, "overlapping intervals").otherwise("all intervals apart")
    return seen.select(F.when(reason == "all intervals apart", "accepted").otherwise("rejected").alias("verdict"), reason.alias("reason"))


def option_price(spark: SparkSession, n: int = 1_000_000, chunk: int = 125_000, s0: float = 100, strike: float = 95, years: float = 1, rate: float = 0.01, sigma: float = 0.3, seed: int = 42) -> DataFrame:
    """(n, price, stderr) of a European call by simulated terminal prices."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for k in page["id"]:
                z = np.random.default_rng(seed + int(k)).standard_normal(chunk)
                end = s0 * np.exp((rate - sigma**2 / 2) * years + sigma * np.sqrt(years) * z)
                pay = np.exp(-rate * years) * np.maximum(end - strike, 0)
                yield pd.DataFrame({"n": [chunk], "s": [pay.sum()], "q": [(pay * pay).sum()]})

    parts = spark.range(-(-n // chunk)).mapInPandas(run, "n long, s double, q double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return parts.select("n", mean.alias("price"), F.sqrt((F.col("q") / F.col("n") - mean * mean) / F.col("n")).alias("stderr"))


def race_sim(spark: SparkSession, scores: list[float], n: int = 200_000, chunk: int = 25_000, noise: float = 1.8, seed: int = 7) -> DataFrame:
    """(horse, place, n): how often each finishes in places 1 to 4; noise on the log chances, then a Gumbel-max order."""
    log_p = np.log(np.asarray(scores) / np.sum(scores))

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for k in page["id"]:
                rng = np.random.default_rng(seed + int(k))
                key = log_p + rng.normal(0, noise, (chunk, len(log_p))) + rng.gumbel(size=(chunk, len(log_p)))
                order = np.argsort(-key, axis=1)[:, :4]
                for place in range(order.shape[1]):
                    count = np.bincount(order[:, place], minlength=len(log_p))
                    yield pd.DataFrame({"horse": np.arange(len(log_p)), "place": place + 1, "n": count})

    return spark.range(-(-n // chunk)).mapInPandas(run, "horse int, place int, n long").groupBy("horse", "place").agg(F.sum("n").alias("n"))


POINTS = np.array([10.0, 5, 2, 1])


def points_of(weights: np.ndarray, fields: list[np.ndarray], winners: list[int]) -> np.ndarray:
    """Total rank points of each weight row: 10, 5, 2, 1 as the winner of a field ranks first to fourth."""
    total = np.zeros(len(weights))
    for field, winner in zip(fields, winners, strict=True):
        score = weights @ field.T
        above = (score > score[:, [winner]]).sum(1)
        total += np.where(above < 4, POINTS[np.minimum(above, 3)], 0)
    return total


def weight_search(spark: SparkSession, fields: list[np.ndarray], winners: list[int], n: int = 5000, chunk: int = 500, keep: int = 10, seed: int = 3) -> DataFrame:
    """(weights, points): the best of n Dirichlet(1) weight vectors; each chunk keeps its best, then all are ranked."""
    width = fields[0].shape[1]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for k in page["id"]:
                w = np.random.default_rng(seed + int(k)).dirichlet(np.ones(width), chunk)
                p = points_of(w, fields, winners)
                best = np.argsort(-p, kind="stable")[:keep]
                yield pd.DataFrame({"chunk": k, "place": range(len(best)), "weights": list(w[best]), "points": p[best]})

    found = spark.range(-(-n // chunk)).mapInPandas(run, "chunk long, place int, weights array<double>, points double")
    return found.orderBy(F.desc("points"), "chunk", "place").limit(keep).select("weights", "points")


def fields(rows: DataFrame, group: str, key: str, factors: list[str], size_by: str, won_by: str, size: int) -> tuple[list[np.ndarray], list[int]]:
    """Of each group the `size` rows with the largest size_by (ties by key), their factors scaled to 0..1 within the group, and
    the number of the row with the largest won_by. The driver gets `size` rows a group."""
    from .relational import topk_per_group

    got = topk_per_group(rows, group, [F.desc(size_by), key], size).select(group, key, *factors, won_by).orderBy(group, key).collect()
    out, winners = [], []
    for name in dict.fromkeys(r[group] for r in got):
        own = [r for r in got if r[group] == name]
        x = np.array([[float(r[f]) for f in factors] for r in own])
        low, spread = x.min(0), x.max(0) - x.min(0)
        out.append(np.where(spread > 0, (x - low) / np.where(spread > 0, spread, 1), 0.5))
        winners.append(max(range(len(own)), key=lambda i: own[i][won_by]))
    return out, winners


def permutation_null(spark: SparkSession, fields: list[np.ndarray], winners: list[int], n: int = 2000, weights: int = 5000, seed: int = 11) -> DataFrame:
    """(n, observed, null_mean, p_value, expected): does the best of `weights` searches beat that of shuffled winners?

    Every row's points under every weighting are found once; a permutation only picks the rows that count as winners.
    expected is the mean of a single weighting under random winners."""
    w = np.random.default_rng(seed).dirichlet(np.ones(fields[0].shape[1]), weights)
    worth = []  # of each field: weightings x rows
    for field in fields:
        place = np.argsort(np.argsort(-(w @ field.T), axis=1, kind="stable"), axis=1, kind="stable")
        worth.append(np.where(place < 4, POINTS[np.minimum(place, 3)], 0).astype(np.float32))
    observed = float(sum(p[:, k] for p, k in zip(worth, winners, strict=True)).max())

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for k in page["id"]:
                rng = np.random.default_rng(seed + 1 + int(k))
                out.append(float(sum(p[:, rng.integers(p.shape[1])] for p in worth).max()))
            yield pd.DataFrame({"best": out})

    null = spark.range(n).mapInPandas(run, "best double")
    expected = float(sum(POINTS[: len(f)].sum() / len(f) for f in fields))
    return null.agg(F.count("*").alias("n"), F.lit(observed).alias("observed"), F.avg("best").alias("null_mean"), F.avg((F.col("best") >= observed).cast("double")).alias("p_value"), F.lit(expected).alias("expected"))
