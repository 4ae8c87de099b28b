"""Monthly series per key: calendar-dense counts, their features, classes and rankings.

Counts are aggregated once per (key, month); the dense calendar is keys x months, both far smaller than the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monthly_counts(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ym, n) of the months in which a key has rows."""
    return rows.groupBy(key, (F.year(ts) * 100 + F.month(ts)).cast("long").alias("ym")).agg(F.count("*").alias("n"))


def monthly(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ym, n), zero where a key has no rows in a month that others have."""
    own = monthly_counts(rows, key, ts).withColumnRenamed(key, "key")
    months, keys = own.select("ym").distinct(), own.select("key").distinct()
    return keys.crossJoin(months).join(own, ["key", "ym"], "left").select("key", "ym", F.coalesce("n", F.lit(0)).alias("n"))


def features(series: DataFrame, recent: int = 12, birth: int = 24) -> DataFrame:
    """Per key: peak and its month (first), trough after it, first active month, active months, recent and birth means."""
    by = W.partitionBy("key").orderBy("ym")
    at = series.withColumn("i", F.row_number().over(by) - 1).withColumn("last", F.count("*").over(W.partitionBy("key")))
    at = at.withColumn("start", F.min(F.when(F.col("n") > 0, F.col("i"))).over(W.partitionBy("key")))
    first = lambda order: F.min(F.struct(order.alias("o"), F.col("ym").alias("ym"), F.col("i").alias("i")))
    out = at.groupBy("key").agg(
        F.max("n").alias("peak"), first(-F.col("n")).alias("p"), first(F.col("n")).alias("t"), F.min("n").alias("trough"),
        F.count_if(F.col("n") > 0).alias("active"), F.sum("n").alias("total"), F.count("*").alias("months"),
        F.avg(F.when(F.col("i") >= F.col("last") - recent, F.col("n"))).alias("recent"),
        F.avg(F.when((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + birth), F.col("n"))).alias("birth"),
    )
    return out.select(
        "key", "peak", F.col("p.ym").cast("long").alias("peak_ym"), F.col("p.i").cast("long").alias("peak_i"), "trough",
        F.col("t.ym").cast("long").alias("trough_ym"), F.col("t.i").cast("long").alias("trough_i"), "active", "total", "months",
        F.round("recent", 6).alias("recent"), F.round("birth", 6).alias("birth"),
    )


def series_class(peak: float = 5000, least_recent: float = 500, months: int = 36) -> Column:
    """ghost, emergent, cooling, warming or stable over the columns of features(); the first rule that holds."""
    ratio, growth = F.col("recent") / F.nullif(F.col("peak"), F.lit(0)), F.col("recent") / F.nullif(F.col("birth"), F.lit(0.0))
    return (
        F.when((F.col("peak") < peak) | (F.col("active") < months), "minor")
        .when(ratio < 0.35, "ghost")
        .when((growth >= 4) & (F.col("birth") < 1000) & (F.col("recent") >= least_recent), "emergent")
        .when(ratio < 0.7, "cooling")
        .when(growth >= 1.5, "warming")
        .otherwise("stable")
    )
