"""Relational operators over any DataFrame: best rows per key, merges, blocklists, pins, samples, calendars, shares.

Order is a list of columns (names or expressions such as F.desc("x")); ties should be settled by its last ones. Where only
one row a key is kept, an aggregate does it, so that rows are combined before they are moved; where several are, a window
limited to k rows a key, which Spark also applies before it moves rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _same(keys: Sequence[str], other: str) -> Column:
    """Are the keys, nulls included, those of columns other0, other1, ...?"""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)], F.lit(True))


def topk_per_group(df: DataFrame, keys: str | Sequence[str], order: Order, k: int, place: str | None = None) -> DataFrame:
    """The k first rows of each key (null is a key), with their place from 1 if a name for it is given."""
    at = place or "__place"
    out = df.withColumn(at, F.row_number().over(W.partitionBy(*_list(keys)).orderBy(*order))).where(F.col(at) <= k)
    return out if place else out.drop(at)


def latest_per_key(df: DataFrame, keys: str | Sequence[str], order: Order, k: int = 1) -> DataFrame:
    """The last k rows of each key in this (ascending) order of column names."""
    return topk_per_group(df, keys, [F.desc(c) for c in order], k)


def topk_global(df: DataFrame, order: Order, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def topk_union(df: DataFrame, keys: Sequence[str], orders: Sequence[Order], k: int) -> DataFrame:
    """Distinct keys of the k first rows along each of several orders."""
    return reduce(DataFrame.unionByName, [topk_global(df, o, k).select(*keys) for o in orders]).distinct()


def best_per_key_topk(df: DataFrame, keys: str | Sequence[str], within: Order, order: Order, k: int, number: str = "number", first: int = 1) -> DataFrame:
    """The first row of each key, of these the k first, numbered without gaps from `first`."""
    best = topk_global(topk_per_group(df, keys, within, 1), order, k)
    return best.withColumn(number, (F.row_number().over(W.orderBy(*order)) + (first - 1)).cast("long"))  # k rows


def topk_or_forced(df: DataFrame, keys: str | Sequence[str], order: Order, k: int, forced: Column) -> DataFrame:
    """The k first rows of each key, and all rows for which `forced` holds."""
    place = F.row_number().over(W.partitionBy(*_list(keys)).orderBy(*order))
    return df.withColumn("__place", place).where((F.col("__place") <= k) | forced).drop("__place")


def variety_cap(df: DataFrame, outer: str | Sequence[str], inner: str | Sequence[str], order: Order, per_inner: int, per_outer: int) -> DataFrame:
    """What a greedy pass in order keeps, if at most per_inner rows of each (outer, inner) and per_outer of each outer may stay.

    A row that is late for its inner group is late whatever else was kept, and a full outer group stays full: so the first
    rows of the inner groups, and of these the first of the outer ones, are just the greedy choice."""
    return topk_per_group(topk_per_group(df, [*_list(outer), *_list(inner)], order, per_inner), outer, order, per_outer)


def merge_keep_best(frames: Sequence[DataFrame], keys: str | Sequence[str], score: str, origin: str = "origin") -> DataFrame:
    """Of all frames (of equal columns) the row with the largest score of each key; ties go to the smaller origin."""
    both = reduce(DataFrame.unionByName, frames)
    rest = [c for c in both.columns if c not in _list(keys)]
    top = F.min_by(F.struct(*rest), F.struct(F.col(score).isNull(), F.negative(F.col(score)), F.col(origin)))
    return both.groupBy(*_list(keys)).agg(top.alias("__best")).select(*_list(keys), *[F.col("__best")[c].alias(c) for c in rest])


def priority_merge(frames: Sequence[DataFrame], keys: str | Sequence[str], origin: str = "origin") -> DataFrame:
    """Of frames in falling priority the first row of each key, with the number of its frame from 1."""
    both = reduce(DataFrame.unionByName, [f.withColumn(origin, F.lit(i)) for i, f in enumerate(frames, 1)])
    rest = [c for c in both.columns if c not in _list(keys)]
    ties = F.struct(F.col(origin), *[F.col(c) for c in rest if c != origin])
    return both.groupBy(*_list(keys)).agg(F.min_by(F.struct(*rest), ties).alias("__best")).select(*_list(keys), *[F.col("__best")[c].alias(c) for c in rest])


def blocklist(df: DataFrame, blocked: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows without a match in `blocked`; on: pairs of a column of df and one of blocked. Nulls match nothing."""
    return df.join(blocked, reduce(Column.__and__, [df[a] == blocked[b] for a, b in on]), "left_anti")


def numbered(df: DataFrame, order: Order, name: str = "place") -> DataFrame:
    """All rows with their place from 1 in an order, without bringing them to one task: rows are dealt by ranges and sorted,
    and each range is moved up by the number of rows before it. The sorted rows are kept on disk, so that both reads see the
    same ranges, until spark.catalog.clearCache(); what an executor loses is computed again."""
    own = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("__id", 33)
    counts = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = counts.select("__part", before.alias("__before"))
    out = own.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__before")


def pin_first(df: DataFrame, key: str, pins: Sequence, order: Order, name: str = "place") -> DataFrame:
    """All rows numbered: those whose key is pinned first, in the order of the pins, then the others in theirs."""
    rank = reduce(lambda when, p: when.when(F.col(key) == p[1], p[0]), enumerate(pins), F).otherwise(len(pins)) if pins else F.lit(0)
    return numbered(df, [rank, *order], name)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same on every run and however they are dealt: those with the smallest hash of the key as text."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)


def densify(df: DataFrame, keys: DataFrame, calendar: DataFrame, fill: dict) -> DataFrame:
    """Every key with every step of the calendar: the rows of df, or `fill` where it has none."""
    on = [*keys.columns, *calendar.columns]
    return keys.crossJoin(F.broadcast(calendar)).join(df, on, "left").fillna(fill)


def with_counts(df: DataFrame, others: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """df and, for each (rows, their key, name), how many of those rows have its key; 0 without any."""
    for rows, own, name in others:
        n = rows.groupBy(F.col(own).alias("__key")).agg(F.count("*").alias(name))
        df = df.join(n, df[key] == n["__key"], "left").drop("__key").fillna({name: 0})
    return df


def share_of_total(df: DataFrame, keys: str | Sequence[str], per: float = 100, digits: int = 2, name: str = "pct") -> DataFrame:
    """Rows of each key and their share of all, as a part of `per`; the window is over the few keys."""
    n = df.groupBy(*_list(keys)).agg(F.count("*").alias("n"))
    return n.withColumn(name, F.round(per * F.col("n").cast("double") / F.sum("n").over(W.partitionBy()), digits))


def dominant(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """keys, value, n, total: the commonest value of each key (ties: the smallest), its rows, and all rows of the key."""
    n = df.groupBy(*_list(keys), value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    out = n.groupBy(*_list(keys)).agg(best.alias("b"), F.sum("n").alias("total"))
    return out.select(*_list(keys), F.col("b")[value].alias(value), F.col("b")["n"].alias("n"), "total")


def fold_small(df: DataFrame, key: str, least: int, other: str = "other", name: str = "grp") -> DataFrame:
    """df with its key, or `other` where fewer than `least` rows have it."""
    n = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return df.join(n, df[key] == n["__key"]).withColumn(name, F.when(F.col("__n") >= least, F.col(key)).otherwise(other)).drop("__key", "__n")


def cumulative_share(df: DataFrame, keys: str | Sequence[str], at: str, per: float = 100, digits: int = 4, name: str = "cum_pct") -> DataFrame:
    """For each key and position the share of the key's rows up to this position."""
    n = df.groupBy(*_list(keys), at).agg(F.count("*").alias("n"))
    whole = W.partitionBy(*_list(keys))
    upto = F.sum("n").over(whole.orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    return n.withColumn(name, F.round(per * upto.cast("double") / F.sum("n").over(whole), digits))


def position_matrix(df: DataFrame, entity: str, position: str, upto: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """entity, n, and for each position k: at_k (rows there), pct_k (share of rows there or before)."""
    aggs = [F.count("*").alias("n")]
    for k in upto:
        aggs += [F.count_if(F.col(position) == k).alias(f"at_{k}"), (100 * F.avg((F.col(position) <= k).cast("double"))).alias(f"pct_{k}")]
    return df.groupBy(entity).agg(*aggs)


def min_max(df: DataFrame, value: str, scale: float = 10, constant: float = 5, digits: int = 6, name: str = "norm") -> DataFrame:
    """value moved to 0..scale over all rows; `constant` where all are equal."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    norm = F.when(F.col("__hi") == F.col("__lo"), F.lit(constant).cast("double")).otherwise(scale * (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0).cast("double")))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.round(norm, digits)).drop("__lo", "__hi")


def softmax(df: DataFrame, value: str, temperature: float, digits: int = 8, name: str = "p") -> DataFrame:
    """exp((value - mean) / temperature) over all rows, summing to 1: two one-row aggregates, no window."""
    own = df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("__mean")))).withColumn("__e", F.exp((F.col(value) - F.col("__mean")) / temperature))
    return own.crossJoin(F.broadcast(own.agg(F.sum("__e").alias("__all")))).withColumn(name, F.round(F.col("__e") / F.col("__all"), digits)).drop("__mean", "__e", "__all")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """Aggregates over several groupings at once; columns that a grouping leaves out are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggs)


def head_per_file(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each file of a scanned table, by their places in the files."""
    return df.where(F.col("_metadata.row_index") < n)


def rank_average(df: DataFrame, value: str, name: str = "pos") -> DataFrame:
    """df (few rows) with the average rank of falling values."""
    rank = F.rank().over(W.orderBy(F.desc(value))) + (F.count("*").over(W.partitionBy(value)) - 1) / F.lit(2.0)
    return df.withColumn(name, rank)


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """key, started, n: rows of a key that follow each other within a gap, such as '30 minutes'."""
    by = W.partitionBy(key).orderBy(ts, tie)
    fresh = F.when(F.col(ts) - F.lag(ts).over(by) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    own = df.select(key, ts, tie, fresh.alias("__fresh")).withColumn("__session", F.sum("__fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return own.groupBy(key, "__session").agg(F.min(ts).alias("started"), F.count("*").alias("n")).drop("__session")


def quantiles(df: DataFrame, keys: str | Sequence[str], value: str, shares: Sequence[float | str], names: Sequence[str], about: DataFrame | None = None) -> DataFrame:
    """keys and exact quantiles of a value's rows that aren't null, interpolated between neighbours; no key's values meet in one
    task. A share may be the name of a column of about(keys, ...), so that each key has its own.

    Values are first counted, so that equal ones are combined before they move; the counts are sorted by ranges, each range
    adds up its own, and a key's ranges are moved up by what lies before them. So a value knows its ranks and whether a
    wanted one is among them. The sorted counts are kept on disk while they are used.
    """
    keys = _list(keys)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    own = n.orderBy(*keys, "__v").withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    part = own.groupBy(*keys, "__part").agg(F.sum("__n").alias("__all"))  # a row a key and range
    by = W.partitionBy(*keys)
    part = part.withColumn("__before", F.coalesce(F.sum("__all").over(by.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__all").over(by))
    part = part.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before", "__total")
    at = own.join(part, _same(keys, "__p") & (F.col("__part") == F.col("__p")))
    upto = F.sum("__n").over(W.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    at = at.withColumn("__stop", F.col("__before") + upto).withColumn("__start", F.col("__stop") - F.col("__n"))
    if about is not None:
        own_key = about.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in about.columns if c not in keys])
        at = at.join(own_key, _same(keys, "__k"))
    aggs = []
    for k, share in enumerate(shares):
        place = (F.col(share) if isinstance(share, str) else F.lit(float(share))) * (F.col("__total") - 1)
        held = lambda rank: F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__stop")), F.col("__v")))
        aggs += [held(F.floor(place)).alias(f"__low{k}"), held(F.ceil(place)).alias(f"__high{k}"), F.max(place - F.floor(place)).alias(f"__f{k}")]
    out = at.groupBy(*keys).agg(*aggs) if keys else at.agg(*aggs)
    between = lambda k: F.col(f"__low{k}") + F.col(f"__f{k}") * (F.col(f"__high{k}") - F.col(f"__low{k}"))
    return out.select(*keys, *[between(k).alias(name) for k, name in enumerate(names)])


def ntile(df: DataFrame, keys: str | Sequence[str], order: Order, n: int, name: str = "tile") -> DataFrame:
    """df with the tile 1 to n of each row within its key, the first tiles taking one row more where they can't be equal; a
    key's rows needn't meet in one task."""
    keys = _list(keys)
    places = numbered(df, [*keys, *order], "__at")
    ends = places.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    at, size, more = F.col("__at") - F.col("__first"), F.floor(F.col("__n") / n), F.col("__n") % n
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return places.join(ends, _same(keys, "__k")).select(*df.columns, (tile + 1).cast("long").alias(name))
