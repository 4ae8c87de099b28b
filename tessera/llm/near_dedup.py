"""MinHash near-dedup with BagMinHash signatures.

A document is the multiset of its five-word shingles. For each shingle of weight w, points arrive by Poisson processes
over the dyadic parts [0,1), [1,2), [2,4), ... of the discretised weights below w, at a rate equal to the part's width.
A point falls on a uniform unit cell of its part (binary splits down the hierarchy) and counts if that cell lies below
w; it belongs to one of M uniform components, which keep their earliest points. The chance that a component of two
documents agrees is their weighted Jaccard similarity, without bias. A process is followed only as long as it can still
beat the latest of the components, so a signature takes little more than one point a shingle.

Signatures are cut into bands. Copies are collapsed first. In each bucket every text is compared with the bucket's first
text only, then the links found are closed to classes. Texts that are still in different classes are compared with a few
central texts and, in rounds, with a few drawn at random. Pairs of a bucket that are left in different classes are bounded
one by one, which grows with the square of what is left, and compared where the bounds allow a link: no candidate link is
lost. Each comparison is the exact multiset overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import Scratch, ascii_space, by_size, col, mix, runs, salt, span_hashes

WORDS = 5
BANDS, ROWS = 20, 4
M = BANDS * ROWS
THRESHOLD = 0.8
PICKS = 4  # texts of a mixed bucket's commonest class, and others, that each text outside that class is compared with in a round
CENTRAL = 8  # texts that all members of mixed buckets with one commonest class are compared with
GROUPS = 64  # of shingles, whose counts bound the overlap of two texts
WIDTH = 6  # bytes of a shingle's number
PIECE = 1 << 19  # bytes worked on at once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `words` words of each text and the text of each; a shorter text is one run of all its words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts, ends = runs(~ascii_space()[buf])
    hashes, owner = span_hashes(buf, starts, ends), np.searchsorted(begins, starts, "right") - 1
    if not len(hashes):
        return hashes, owner
    out, n = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
    for k in range(words):
        at = np.arange(k, len(hashes))
        same = owner[at] == owner[at - k]
        out[: len(at)] = np.where(same, mix(out[: len(at)] + hashes[at] + salt(k + 1)), out[: len(at)])
        n[: len(at)] += same
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    whole = (n == words) | first
    return out[whole], owner[whole]


def bag(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their texts and weights."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    if not len(h):
        return h, o, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    return h[first], o[first], np.diff(np.concatenate([first, [len(h)]]))


def signatures(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """Earliest point of each component, one row a text; inf for a text without shingles."""
    best = np.full(texts * m, np.inf)
    seeds, docs, widths, lows, tops = [], [], [], [], []
    level, low, width = 0, 0, 1
    while (more := np.flatnonzero(weight > low)).size:
        seeds.append(mix(h[more] + salt(level + 1, 0xD1342543DE82EF95)))
        docs.append(owner[more])
        widths.append(np.full(more.size, float(width)))
        lows.append(np.full(more.size, low))
        tops.append(weight[more])
        level, low, width = level + 1, low + width, low + width
    if not seeds:
        return best.reshape(texts, m)
    seed, doc, width, low, top = (np.concatenate(x) for x in (seeds, docs, widths, lows, tops))
    time, latest, step = np.zeros(len(seed)), np.full(texts, np.inf), 0
    while len(seed):
        step += 1
        a = mix(seed + salt(step))
        b = mix(a + _STEP)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        keep = time < latest[doc]
        seed, doc, width, low, top, time, b = (x[keep] for x in (seed, doc, width, low, top, time, b))
        cell = low + ((b >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
        hit = cell < top
        np.minimum.at(best, doc[hit] * m + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)[hit], time[hit])
        seen = np.flatnonzero(np.bincount(doc, minlength=texts))
        latest[seen] = best.reshape(texts, m)[seen].max(1)
    return best.reshape(texts, m)


def layers(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set of 48-bit numbers: the k-th copy of a shingle has a number of its own.

    Two texts of a and b shingles count one too many with a chance of a * b / 2**48 (for 20,000 words each about one in a million).
    """
    rank = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.unique(mix(np.repeat(h, weight) + rank.astype(np.uint64) * _STEP) >> np.uint64(64 - 8 * WIDTH))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of WIDTH bytes, byte plane by byte plane: those of the high bytes hardly change along a sorted set."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(WIDTH, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :WIDTH] = planes.T
    return out.view("<u8").ravel()


def profile(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, row: str | None = None) -> DataFrame:
    """rid, doc_id, key (digest of the words), bands, size, layers of every row; texts are read whole."""
    own = docs.select((col(row) if row else F.monotonically_increasing_id()).alias("rid"), col(doc_id).alias("doc_id"), col(text).alias("text"))

    @F.pandas_udf("key binary, bands array<long>, size int, layers binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x.lower().encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in batch]
            keys = [hashlib.blake2b(b" ".join(x.split()), digest_size=16).digest() for x in texts]
            bandsof, sets = [], []
            for part in by_size([len(x) for x in texts], PIECE):
                n = part.stop - part.start
                h, owner, weight = bag(*shingles(texts[part], words))
                signature = signatures(h, owner, weight, n, bands * rows)
                bits = signature.view(np.uint64).reshape(n, bands, rows)
                hashed = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, (n, bands)).copy()
                for k in range(rows):
                    hashed = mix(hashed + bits[:, :, k])
                cut = np.searchsorted(owner, np.arange(n + 1))
                for i in range(n):
                    some = cut[i] < cut[i + 1]
                    bandsof.append(hashed[i].view(np.int64).tolist() if some else [])
                    sets.append(layers(h[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]))
            yield pd.DataFrame({"key": keys, "bands": bandsof, "size": [len(s) for s in sets], "layers": [packed(s) for s in sets]})

    out = own.select("rid", "doc_id", of("text").alias("p"))
    return out.select("rid", "doc_id", "p.key", "p.bands", "p.size", "p.layers")


@F.pandas_udf(IntegerType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int32")


def classes(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node of the saved edges(a, b): the smallest node of its connected component.

    Labels pass along edges and jump to their own label's label, so the rounds grow with the logarithm of a path.
    """
    n = 2 * edges.count()
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both", n)
    label = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), f"{name}-0", n)
    step = 0
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mine = label.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        step += 1
        new = mine.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved"))
        new = scratch.save(new, f"{name}-{step}", n)
        scratch.drop(f"{name}-{step - 1}")
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def trees(parent: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every a of the saved parent(a, b), which has one row an a and b < a: the root of its tree, by pointer
    jumping."""
    own, n, step = parent.select(F.col("a").alias("node"), F.col("b").alias("label")), parent.count(), 0
    while True:
        step += 1
        jump = own.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.save(own.join(jump, "label", "left").select("node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")), f"{name}-{step}", n)
        scratch.drop(f"{name}-{step - 1}")
        own = new.select("node", "label")
        if new.where("moved").isEmpty():
            return own


@F.pandas_udf(ArrayType(IntegerType()))
def _grouped(layers: pd.Series, alone: pd.Series) -> pd.Series:
    count = lambda x: np.bincount((x % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    of = lambda x, y: count(unpacked(x)) - (0 if y is None else count(np.asarray(y, np.int64).view(np.uint64)))
    return pd.Series([of(x, y).astype(np.int32) for x, y in zip(layers, alone, strict=True)])


def _shared_sizes(sets: DataFrame, among: DataFrame) -> DataFrame:
    """(rid, groups, shared): how many members of a set occur in another of the sets `among` as well, by GROUPS hashed groups
    and in all. Similarity can only rest on these, so the sum of the smaller group counts bounds the overlap of a pair."""

    def numbers(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            own = [unpacked(x) for x in page["layers"]]
            yield pd.DataFrame({"rid": np.repeat(page["rid"].to_numpy(), [len(x) for x in own]), "x": np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)})

    own = sets.join(among, "rid").select("rid", "layers")
    alone = own.mapInPandas(numbers, "rid long, x long").groupBy("x").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).where("n = 1")
    alone = alone.groupBy("rid").agg(F.collect_list("x").alias("alone"))
    out = own.join(alone, "rid", "left").select("rid", _grouped("layers", "alone").alias("groups"))
    return out.select("rid", "groups", F.aggregate("groups", F.lit(0), lambda n, x: n + x).alias("shared"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, row: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class), class_size, kept, and `row` if given: a
    column of distinct long numbers that tells rows apart and says which is first.

    Classes are the connected components of texts whose multisets of lower-case five-word shingles have a weighted
    Jaccard similarity of threshold or more. Texts of equal words are always of one class, texts without a word among
    them (null counts as empty); a text of fewer than five words is one shingle. One row of each class is kept: the
    smallest doc_id (nulls last), then the first row. No rows give no rows; other columns are ignored. The result reads
    tables of `scratch`, which the caller may close when done.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.save(profile(docs, doc_id, text, row=row), "profile")
    # What rows are joined with on a key that may be hot is a saved table, so that Spark can split the hot key's rows.
    copies = scratch.save(rows.groupBy("key").agg(F.min("rid").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    member = rows.select("rid", "doc_id", "key", "size", "bands").join(copies, "key", "left").withColumn("rep", F.coalesce("rep", "rid"))
    member = scratch.save(member.select("rid", "doc_id", "rep", "size", F.when(F.col("rid") == F.col("rep"), F.col("bands")).alias("bands")), "member")
    band = member.where("bands is not null").select("rid", "size", F.explode("bands").alias("bucket"))
    buckets = scratch.save(band.groupBy("bucket").agg(F.min("rid").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    full = scratch.save(band.join(buckets, "bucket"), "full")
    needed = scratch.save(full.select("rid").distinct(), "needed")
    sets = scratch.save(rows.select("rid", "size", "layers").join(needed, "rid"), "sets")
    scratch.drop("profile", "buckets", "needed")

    def fits(a: str, b: str):
        return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs(a, b) that are similar enough."""
        sizes = sets.select(F.col("rid"), F.col("size"))
        both = pairs.join(sizes.select(F.col("rid").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("rid").alias("b"), F.col("size").alias("nb")), "b")
        both = scratch.save(both.where(fits("na", "nb")), f"{name}-pairs")  # of known size: layers move only where pairs are many
        met = both.join(sets.select(F.col("rid").alias("a"), F.col("layers").alias("la")), "a").join(sets.select(F.col("rid").alias("b"), F.col("layers").alias("lb")), "b")
        shared = met.select("a", "b", "na", "nb", _overlap("la", "lb").alias("shared"))
        return scratch.save(shared.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b"), name)

    to_pivot = full.where("rid <> pivot").select(F.col("rid").alias("a"), F.col("pivot").alias("b"))
    label = trees(linked(to_pivot.groupBy("a").agg(F.min("b").alias("b")), "links1"), scratch, "trees")  # a class's first text has no row

    def ends(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different classes so far, and these classes."""
        at = lambda n: label.select(F.col("node").alias(n), F.col("label").alias(f"c{n}"))
        both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    def joined(pairs: DataFrame, name: str) -> None:
        """Add the links among these pairs: whole classes become nodes, so only what is new is closed."""
        nonlocal label
        new = linked(pairs, name)
        if new.isEmpty():
            return
        edges = scratch.save(ends(new).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"{name}-edges", new.count())
        to = classes(edges, scratch, f"{name}-classes").where("node <> label")
        onto = to.select(F.col("node").alias("label"), F.col("label").alias("low"))
        moved = label.join(onto, "label", "left").select("node", F.coalesce("low", "label").alias("label"))
        label = scratch.save(moved.unionByName(to), f"{name}-label", label.count() + new.count())

    def apart(pairs: DataFrame) -> DataFrame:
        return ends(pairs).select("a", "b")

    joined(apart(to_pivot.distinct()), "links2")

    def mixed() -> DataFrame:
        """Members of the buckets that still hold more than one class, and the commonest class of the bucket."""
        now = full.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "rid", "size", F.coalesce("label", "rid").alias("label"))
        share = now.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        most = share.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("kinds"), F.sum("n").alias("all"))
        most = most.where("kinds > 1 and all > 2").select("bucket", F.col("most.label").alias("main"))
        return now.join(most, "bucket")

    rest = scratch.save(mixed(), "rest1")
    if not rest.isEmpty():
        common = scratch.save(_shared_sizes(sets, rest.select("rid").distinct()), "common")
        # Of all buckets in which one class is the commonest, CENTRAL texts are chosen together: a text meets them once, in
        # however many of these buckets it is. Of each task only CENTRAL rows are moved.
        about = rest.select("main", "rid", "label", "size").distinct().join(common.select("rid", "shared"), "rid")
        place = F.row_number().over(W.partitionBy("main").orderBy(1 - F.col("shared") / F.col("size"), "rid"))
        central = about.withColumn("place", place).where(F.col("place") <= CENTRAL)
        central = scratch.save(central.select("main", F.col("rid").alias("b"), F.col("label").alias("cb"), F.col("size").alias("sb"), F.col("shared").alias("mb")), "central")

        def bounded(sa: str, sb: str, most) -> Column:
            """Can texts of these sizes be similar enough if they share at most so much?"""
            return most >= threshold * (F.col(sa) + F.col(sb) - most) - 1e-9

        possible = (F.col("label") != F.col("cb")) & bounded("size", "sb", F.least("shared", "mb"))
        to_center = about.join(central, "main").where(possible).select(F.greatest("rid", "b").alias("a"), F.least("rid", "b").alias("b")).distinct()
        joined(apart(to_center), "links3")

        def open_rows(name: str) -> DataFrame:
            """Rows of mixed buckets whose texts share enough of their shingles to be similar to any other."""
            return scratch.save(mixed().join(common, "rid").where(F.col("shared") >= threshold * F.col("size") - 1e-9), name)

        def either(of: DataFrame, n: str, *more) -> DataFrame:
            return of.select("bucket", F.col("rid").alias(n), F.col("size").alias(f"s{n}"), F.col("shared").alias(f"m{n}"), F.col("groups").alias(f"g{n}"), F.col("label").alias(f"c{n}"), (F.col("label") == F.col("main")).alias(f"in{n}"), *more)

        overlap = F.aggregate(F.zip_with("ga", "gb", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
        possible = (F.col("ca") != F.col("cb")) & bounded("sa", "sb", F.least("ma", "mb")) & bounded("sa", "sb", overlap)  # the cheaper bound first
        pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")

        def drawn(rest: DataFrame, name: str) -> DataFrame:
            """PICKS rows of each bucket's commonest class and PICKS others, by a hash that differs from bucket to bucket."""
            inner, picks = F.col("label") == F.col("main"), []
            for k in range(PICKS):
                place = F.xxhash64("rid", "bucket", F.lit(name), F.lit(k))
                picks += [F.min_by("rid", F.when(inner, place)), F.min_by("rid", F.when(~inner, place))]
            own = rest.groupBy("bucket").agg(F.array_distinct(F.array(*picks)).alias("rid"))
            return scratch.save(rest.join(own.select("bucket", F.explode_outer("rid").alias("rid")), ["bucket", "rid"]), name)

        # Where texts outside a bucket's commonest class have links to many texts, a few drawn at random find one of them. Rounds go
        # on as long as they settle a tenth of such rows, so they cost a multiple of the rows; what they leave is compared in full.
        rest, step, before = open_rows("rest2-0"), 0, math.inf
        while True:
            many = rest.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PICKS).select("bucket")
            many = scratch.save(rest.join(many, "bucket"), f"many-{step}")
            outer = many.where("label <> main").count()
            if not outer or outer > 0.9 * before:
                break
            met = either(many.where("label <> main"), "a").join(either(drawn(many, f"drawn-{step}"), "b"), "bucket").where(possible)
            joined(apart(met.select(*pair).distinct()), f"links4-{step}")
            scratch.drop(f"many-{step}", f"drawn-{step}")
            step, before = step + 1, outer
            rest = open_rows(f"rest2-{step}")
            scratch.drop(f"rest2-{step - 1}")
        scratch.drop(f"many-{step}")

        # A pair is compared in the first of the buckets that both texts are in, and only where the other's size fits.
        homes = rest.groupBy("rid").agg(F.collect_set("bucket").alias("homes"))
        homes = scratch.save(rest.join(homes, "rid"), "homes")
        scratch.drop(f"rest2-{step}")
        stride = math.log(1.01 / threshold) / 4
        most = F.least(F.col("size") / threshold, (1 + threshold) / threshold * F.col("shared") - F.col("size"))  # of a text that may be similar
        from_to = [F.floor(F.log(x) / stride) for x in (threshold * F.col("size") - 1e-6, most + 1e-6)]
        left = homes.where((F.col("label") != F.col("main")) & (most + 1e-6 >= threshold * F.col("size") - 1e-6))
        left = either(left, "a", F.col("homes").alias("ha"), F.explode(F.sequence(*from_to)).alias("step"))
        right = either(homes, "b", F.col("homes").alias("hb"), F.floor(F.log("size") / stride).alias("step"))
        first = F.array_min(F.array_intersect("ha", "hb")) == F.col("bucket")
        across = left.join(right, ["bucket", "step"]).where((F.col("inb") | (F.col("a") < F.col("b"))) & possible & first)
        joined(apart(across.select(*pair)), "links5")

    scratch.drop("full", "sets", "common", "central", "rest1", "homes")
    whole = member.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("rid", "doc_id", F.coalesce("label", "rep").alias("label"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    group = whole.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("class_size")).where("class_size > 1")
    out = whole.join(scratch.save(group, "groups"), "label", "left")
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("rid") == F.col("first.rid"))).alias("kept"), *([F.col("rid").alias(row)] if row else []),
    )


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
