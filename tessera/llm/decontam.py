"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits, k a fixed share of its length. Cut into k + 1 pieces, at least
one piece of such an occurrence is untouched. One Aho-Corasick automaton finds all exact piece hits of a document; each
hit says where the item would lie, and Myers' bit-parallel edit distance verifies that stretch. An item too short for an
edit is one piece and must stand between word boundaries, so that it isn't found inside other words. Items are a bounded
query set: they go to the executors in blocks of BLOCK_CHARS, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

RATE = 0.06  # edits allowed per character of an item
BLOCK_CHARS = 8_000_000  # of items in one block


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join(text.lower().split()) if isinstance(text, str) else ""


def cuts(length: int, rate: float = RATE) -> list[tuple[int, int]]:
    """Bounds of the error budget plus one pieces, as equal as can be."""
    n = int(length * rate) + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def stands_alone(text: str, start: int, stop: int) -> bool:
    """No letter or digit of text[start:stop] goes on beyond its ends."""
    before = start > 0 and text[start].isalnum() and text[start - 1].isalnum()
    return not (before or (stop < len(text) and text[stop - 1].isalnum() and text[stop].isalnum()))


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text (anchored: to a prefix), and the first end with it."""
    m, masks = len(pattern), _masks(pattern)
    full, top, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(xh | up), up & xh
        now += bool(more & top) - bool(less & top)
        more, less = (more << 1 | carry) & full, less << 1 & full
        up, down = (less | ~(xv | more)) & full, more & xv
        if now < best:
            best, end = now, j
    return best, end


def finder(items: list[tuple[int, str]], rate: float):
    """A function from a normalised text to its matches [(item number in the list, distance, start, stop)]."""
    import ahocorasick

    automaton, where = ahocorasick.Automaton(), {}
    for k, (_, item) in enumerate(items):
        for a, b in cuts(len(item), rate):
            where.setdefault(item[a:b], []).append((k, a))
    for piece, spots in where.items():
        automaton.add_word(piece, (len(piece), spots))
    automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int, int]]:
        stretches: dict[int, list[list[int]]] = {}
        short: dict[int, tuple[int, int, int]] = {}
        for end, (size, spots) in automaton.iter(text):
            for k, at in spots:
                n = len(items[k][1])
                budget = int(n * rate)
                begin = end + 1 - size - at
                if n * max(rate, RATE) < 1:
                    if k not in short and stands_alone(text, begin, begin + n):
                        short[k] = (0, begin, begin + n)
                    continue
                lo, hi = max(0, begin - budget), min(len(text), begin + n + budget)
                own = stretches.setdefault(k, [])
                if own and own[-1][0] <= hi and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        found = [(k, *hit) for k, hit in short.items()]
        for k, own in stretches.items():
            item = items[k][1]
            budget, best = int(len(item) * rate), None
            for lo, hi in own:
                if (at := text.find(item, lo, hi)) >= 0:
                    hit = (0, at, at + len(item))
                else:
                    distance, stop = myers(item, text[lo:hi])
                    if distance > budget:
                        continue
                    _, back = myers(item[::-1], text[lo : lo + stop][::-1], anchored=True)
                    hit = (distance, lo + stop - back, lo + stop)
                best = min(best or hit, hit)
            if best:
                found.append((k, *best))
        return found

    return find


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, stop: every item that occurs in a document within its error budget, at its best
    place (least distance, then first); start and stop are offsets in the normalised text.

    Null texts hold nothing. Items that are null or without a character when normalised are not looked for; those too short
    for an edit (below 17 characters at 6 %) are found exactly, as whole words; items with equal texts all match. Repeated documents match one by one; other columns are ignored. Whole texts are
    read. Without items or documents there are no rows.
    """
    wanted = items.select(col(item_id).alias("item_id"), col(item_text).alias("text")).where(F.col("text").isNotNull())
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, start long, stop long"
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).where(F.col("text").isNotNull())

    def pass_over(block: list[tuple]) -> DataFrame:
        def scan(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = finder(block, rate)
            for page in pages:
                out = []
                for key, body in zip(page["doc_id"], page["text"], strict=True):
                    out += [(key, block[k][0], d, a, b) for k, d, a, b in find(normal(body))]
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "start", "stop"])
                for name in ("doc_id", "item_id"):
                    frame[name] = frame[name].astype(object).where(frame[name].notna(), None)
                yield frame

        return own.mapInPandas(scan, schema)

    result, block, size = None, [], 0
    for row in wanted.toLocalIterator():
        body = normal(row["text"])
        if not body:
            continue
        block.append((row["item_id"], body))
        size += len(body)
        if size >= BLOCK_CHARS:
            part = pass_over(block)
            result = part if result is None else result.unionByName(part)
            block, size = [], 0
    if block or result is None:
        part = pass_over(block) if block else docs.sparkSession.createDataFrame([], schema)
        result = part if result is None else result.unionByName(part)
    return result


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
