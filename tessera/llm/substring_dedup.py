"""Substring dedup of repeated windows of words, with a count-min sketch before the exact pass.

1. Documents are gathered into chunks of some megabytes, written once as a table bucketed by chunk; from then on no text
   is shuffled but that of repeated windows.
2. Every chunk makes its part of a count-min sketch: for each of DEPTH rows, the cells its windows fall into, sorted and
   cut into shards of cells. Shards of one row are merged in one place; the merged counts can only be too high. Every
   chunk gets back one bit for each of its cells: does the merged count reach two?
3. Windows whose cells all reach two are exactly grouped. Neighbouring windows travel as one run of words, dealt by their
   least hash of GRAM words: equal windows have the same, and most neighbours too. Where the runs of one hash meet, windows
   with equal hashes are compared word by word. A window that occurs once but shared cells drops out here, and one that
   occurs twice can't have been missed. Of each chunk's equal windows only the first takes part, and where more than FAN
   chunks might meet they do so in groups of FAN, whose first windows meet again: a passage in every document is reduced
   before it is moved, and no group grows with the corpus.
4. Every window but the first of its kind is removed, and the words it covers with it.

The sketch's width follows the number of windows (WIDTH cells a window), while a shard's size is fixed: no part of it has
to fit a machine, and the share of false alarms is the same at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_space, col, mix, runs, salt, small_batches, span_hashes

WINDOW = 20
DEPTH = 2
WIDTH = 16  # cells of each row a window
SHARD_BITS = 24  # cells of a shard, as a power of two
GRAM = 4  # words whose least hash deals a window
GROUP = 1 << 18  # windows, at most, that one exact group is planned for
FAN = 4096  # chunks whose windows of one key may meet in one group
CHUNK = 6 << 20  # bytes of text in a chunk
BUCKET = 96 << 20  # bytes of text in a bucket of chunks
MOST_BUCKETS = 100_000  # that Spark allows


def words_of(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, start and end of each word, and its document; the documents stand one after another, line feeds between."""
    begins = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(blob, np.uint8)
    starts, ends = runs(~ascii_space()[buf])
    return buf, starts, ends, np.searchsorted(begins, starts, "right") - 1


def window_starts(owner: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the words at which a window of one document starts."""
    if len(owner) < window:
        return np.empty(0, np.int64)
    return np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 100_000):  # in parts that stay in the cache
        b = min(len(starts), a + 100_000)
        lo, hi = starts[a], ends[b - 1]
        out[a:b] = span_hashes(buf[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
    return out


def window_hashes(word: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A hash of each window, from those of its words."""
    if not len(at):
        return np.empty(0, np.uint64)
    n = len(word) - window + 1
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = out * np.uint64(0xA24BAED4963EE407) + word[k : k + n]
    return mix(out[at])


def deal_keys(word: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The least hash of GRAM (or, in shorter windows, all) neighbouring words of each window."""
    gram = min(GRAM, window)
    least = np.zeros(len(word) - gram + 1, np.uint64)
    for k in range(gram):
        least = mix(least + word[k : k + len(least)])
    width, wanted = 1, window - gram + 1
    while width < wanted:  # least of `width` neighbours, then of twice as many
        step = min(width, wanted - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least[at]


def first_equal(blob: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each of some spans of blob, the number of the first span of the same bytes. Hashes only say which to compare."""
    if not len(hashes):
        return np.empty(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(out != np.arange(len(out)))
    first = out[again]
    spans = zip(starts[again].tolist(), ends[again].tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)
    if all(blob[a:b] == blob[c:d] for a, b, c, d in spans):
        return out
    names: dict[bytes, int] = {}  # different bytes share a hash
    return np.array([names.setdefault(blob[a:b], i) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))], np.int64)


def runs_of(place: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places in which the other arrays don't change."""
    if not len(place):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.diff(place) != 1
    for other in same:
        step |= np.diff(other) != 0
    first = np.flatnonzero(np.concatenate([[True], step]))
    return first, np.concatenate([first[1:], [len(place)]]) - 1


def planes(values: np.ndarray) -> bytes:
    """Sorted numbers byte plane by byte plane, so that the high bytes compress away."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes + salt(row + 1, 0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def stretches(labels: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal labels; none of an empty array."""
    cut = np.flatnonzero(np.diff(labels, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(labels)], strict=True)) if cut else []


def _chunked(size: int):
    def gather(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, rows, total = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
            blob = b"\n".join([*(r[2] for r in rows), b""])
            return pd.DataFrame({"chunk": [(part << 32) + k], "ids": [[r[0] for r in rows]], "sizes": [[len(r[2]) + 1 for r in rows]], "blob": [blob], "words": [sum(r[3] for r in rows)]})

        n = 0
        for page in pages:
            for key, null, text in zip(page["doc_id"], page["null"], page["text"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                body = b" ".join(words)
                if rows and total + len(body) > size:
                    yield flush()
                    rows, total, k = [], 0, k + 1
                rows.append((None if null else int(key), n, body, len(words)))
                n, total = n + 1, total + len(body)
        if rows:
            yield flush()

    return gather


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True, width: int = WIDTH, shard_bits: int = SHARD_BITS, chunk_bytes: int = CHUNK, group: int = GROUP, fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if a window of `window` words covers it whose words also start
    earlier: in a smaller doc_id, or the same document before. Null texts have no words; ids are compared as long numbers,
    nulls and ids that are no such number come last (and are null in the result), and rows that share an id follow each
    other in the order of the chunks. No documents give no rows; other columns are ignored. The result is a table of
    `scratch`, which the caller may close when done.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    key = col(doc_id).try_cast("long")
    own = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("null"), col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    shape = "chunk long, ids array<long>, sizes array<int>, blob binary, words long"
    least = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, 1 + size // BUCKET))  # with fewer buckets than partitions Spark would shuffle the table to join it
    chunks = scratch.buckets(own.mapInPandas(_chunked(chunk_bytes), shape), "chunks", "chunk", buckets)
    total = chunks.agg(F.sum("words")).first()[0] or 0
    bits = max(shard_bits, int(max(1, total * width) - 1).bit_length())
    low = np.uint64((1 << shard_bits) - 1)

    def sketch(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for chunk, sizes, blob in zip(page["chunk"], page["sizes"], page["blob"], strict=True):
                buf, starts, ends, owner = words_of(blob, np.asarray(sizes))
                hashes = window_hashes(word_hashes(buf, starts, ends), window_starts(owner, window), window)
                for row in range(DEPTH):
                    cells, n = np.unique(cells_of(hashes, row, bits), return_counts=True)
                    shard = (cells >> np.uint64(shard_bits)).astype(np.int64)
                    out = [(row, int(shard[a]), chunk, planes(cells[a:b] & low), np.packbits(n[a:b] > 1).tobytes()) for a, b in stretches(shard)]
                    yield pd.DataFrame(out, columns=["row", "shard", "chunk", "cells", "many"])

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << shard_bits, np.uint8)
        lists = [unplanes(x) for x in page["cells"]]
        for cells, many in zip(lists, page["many"], strict=True):
            more = np.unpackbits(np.frombuffer(many, np.uint8), count=len(cells))
            count[cells] = np.minimum(count[cells] + 1 + more, 2)
        page = page[["row", "shard", "chunk"]].copy()
        page["bits"] = [np.packbits(count[cells] > 1).tobytes() for cells in lists]
        return page

    parts = chunks.select("chunk", "sizes", "blob").mapInPandas(sketch, "row int, shard int, chunk long, cells binary, many binary")
    merged = parts.groupBy("row", "shard").applyInPandas(merge, "row int, shard int, chunk long, bits binary")
    answers = merged.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("row", "shard", "bits"))).alias("answers"))

    def suspects(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of neighbouring windows with one key, and (without a key) the windows that repeat earlier ones of the chunk."""
        for page in pages:
            for chunk, ids, sizes, blob, answers in zip(page["chunk"], page["ids"], page["sizes"], page["blob"], page["answers"], strict=True):
                buf, starts, ends, owner = words_of(blob, np.asarray(sizes))
                word, at = word_hashes(buf, starts, ends), window_starts(owner, window)
                hashes = window_hashes(word, at, window)
                if not len(hashes):
                    continue
                told = {(a["row"], a["shard"]): a["bits"] for a in answers}
                hot = np.ones(len(hashes), bool)
                for row in range(DEPTH):
                    cells, back = np.unique(cells_of(hashes, row, bits), return_inverse=True)
                    shard = (cells >> np.uint64(shard_bits)).astype(np.int64)
                    flags = [np.unpackbits(np.frombuffer(told[row, int(shard[a])], np.uint8), count=b - a) for a, b in stretches(shard)]
                    hot &= np.concatenate(flags)[back].astype(bool)
                some = np.flatnonzero(hot)
                if not len(some):
                    continue
                begin, end = starts[at[some]], ends[at[some] + window - 1]
                first = first_equal(blob, begin, end, hashes[some]) == np.arange(len(some))
                mine = np.flatnonzero(first)
                keys, doc, place = deal_keys(word, at[some[mine]], window).view(np.int64), owner[at[some[mine]]], some[mine]
                cut, stop = runs_of(place, keys, doc)
                bodies = [blob[a:b] for a, b in zip(begin[mine[cut]].tolist(), end[mine[stop]].tolist(), strict=True)]
                names = np.array([np.iinfo(np.int64).max if x is None or x != x else int(x) for x in ids], np.int64)
                yield pd.DataFrame({"chunk": chunk, "key": keys[cut], "doc": names[doc[cut]], "at": place[cut], "n": stop - cut + 1, "body": bodies, "lost": None})
                yield pd.DataFrame({"chunk": [chunk], "key": [None], "doc": [None], "at": [None], "n": [0], "body": [None], "lost": [planes(some[~first])]})

    def meeting(again: bool):
        return lambda page: meet(page, again)

    def meet(page: pd.DataFrame, again: bool) -> pd.DataFrame:
        """Windows that aren't the first of their kind in a group, by chunk, and (if they meet again) the others as runs."""
        page = page.sort_values(["doc", "chunk", "at"], kind="stable")
        blob = b"\n".join([*page["body"], b""])
        sizes = np.array([len(x) + 1 for x in page["body"]], np.int64)
        buf, starts, ends, owner = words_of(blob, sizes)
        at = window_starts(owner, window)
        hashes = window_hashes(word_hashes(buf, starts, ends), at, window)
        begin, end, run = starts[at], ends[at + window - 1], owner[at]
        first = first_equal(blob, begin, end, hashes) == np.arange(len(at))
        before = np.concatenate([[0], np.cumsum(page["n"].to_numpy(np.int64))])
        chunk, place = page["chunk"].to_numpy(np.int64)[run], page["at"].to_numpy(np.int64)[run] + np.arange(len(at)) - before[run]
        lost = np.flatnonzero(~first)
        lost = lost[np.lexsort((place[lost], chunk[lost]))]
        cuts = stretches(chunk[lost])
        out = [pd.DataFrame({"chunk": [int(chunk[lost][a]) for a, _ in cuts], "key": None, "doc": None, "at": None, "n": 0, "body": None, "lost": [planes(place[lost][a:b]) for a, b in cuts]})]
        if again:
            kept = np.flatnonzero(first)
            a, b = runs_of(place[kept], run[kept])
            own = run[kept[a]]
            bodies = [blob[x:y] for x, y in zip(begin[kept[a]].tolist(), end[kept[b]].tolist(), strict=True)]
            out.append(pd.DataFrame({"chunk": chunk[kept[a]], "key": page["key"].to_numpy(np.int64)[own], "doc": page["doc"].to_numpy(np.int64)[own], "at": place[kept[a]], "n": b - a + 1, "body": bodies, "lost": None}))
        return pd.concat([x.astype(object) for x in out])[["chunk", "key", "doc", "at", "n", "body", "lost"]]

    kind = "chunk long, key long, doc long, at long, n long, body binary, lost binary"
    with small_batches(spark, 64):
        found = chunks.join(answers, "chunk").select("chunk", "ids", "sizes", "blob", "answers").mapInPandas(suspects, kind)
        left = found = scratch.save(found, "suspects")
        met, lost, level = chunks.count(), [found.where("lost is not null")], 0
        while True:
            slots = 1 + (met - 1) // fan if met else 1
            windows = left.agg(F.sum("n")).first()[0] or 0
            part, slot = F.pmod("key", F.lit(1 + windows // group)), F.pmod(F.xxhash64("chunk", F.lit(level)), F.lit(slots))
            again = slots > 1
            out = left.where("key is not null").withColumns({"part": part, "slot": slot}).groupBy("part", "slot").applyInPandas(meeting(again), kind)
            if not again:
                lost.append(out)
                break
            left, met, level = scratch.save(out, f"met{level}"), slots, level + 1
            lost.append(left.where("lost is not null"))
        gone = reduce(DataFrame.unionByName, lost).groupBy("chunk").agg(F.collect_list("lost").alias("gone"))

    def cut_out(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for ids, sizes, blob, gone in zip(page["ids"], page["sizes"], page["blob"], page["gone"], strict=True):
                _, starts, ends, owner = words_of(blob, np.asarray(sizes))
                covered = np.zeros(len(starts) + 1, np.int64)
                if gone is not None and len(gone):
                    at = window_starts(owner, window)[np.concatenate([unplanes(x) for x in gone])]
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
                out = np.cumsum(covered)[:-1] > 0
                n = len(ids)
                words, removed = np.bincount(owner, minlength=n), np.bincount(owner[out], minlength=n)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                first = np.searchsorted(owner, np.arange(n + 1))
                kept = []
                for i in range(n):
                    body = blob[begin[i] : begin[i + 1] - 1]
                    if removed[i]:
                        body = b" ".join(w for w, x in zip(body.split(), out[first[i] : first[i + 1]].tolist(), strict=True) if not x)
                    kept.append(body)
                frame = pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in ids], "Int64"), "n_words": words, "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})
                if texts:
                    frame["kept_text"] = [x.decode("utf-8", "surrogatepass") for x in kept]
                yield frame

    whole = chunks.join(gone, "chunk", "left").select("ids", "sizes", "blob", "gone")
    out = whole.mapInPandas(cut_out, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    out = scratch.save(out, "kept")
    scratch.drop("chunks", "suspects", *(f"met{k}" for k in range(level)))
    return out


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), texts=False)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS span FROM w),
l AS (SELECT doc_id, i, word, span IS NOT NULL AND row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1 AS lost FROM s),
k AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN lost THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM l),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
