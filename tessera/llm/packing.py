"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised and cut where they are; what packing needs is only how many pieces there are of each length, at
most `size` numbers. On these counts the driver plans the bins: a bin starts with the longest piece left and takes,
again and again, the longest that fits; if a gap is left, the bin's smallest piece is replaced by the two unpacked
pieces that fill the widened gap best. Bins that come out alike are planned at once, so the plan has a few thousand
entries whatever the corpus. Pieces of one length are numbered over all partitions (counts, then running sums), and
the number says which bin and place a piece gets. No document moves to be packed.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, col, once

SIZE = 1024
END = 2  # the id that ends each document


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def probes() -> list[str]:
    """Strings of all kinds of characters: words, numbers, white space, marks, and letters of many scripts."""
    rng = random.Random(1)
    blocks = [(32, 127), (9, 14), (48, 58), (160, 592), (768, 1536), (2304, 3584), (8192, 8448), (12352, 12544), (19968, 20224), (127744, 128512)]
    return ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(n)) for n in range(200)] + ["it's we'll 'S\n\n  x \r\n 12345 A1b2"]


def encoder(path: str):
    """A function from text to ids, equal to tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).

    For a byte-level BPE whose merges are in the order of its ids, the same merges run in tiktoken, four times as fast;
    a text that holds one of the special tokens, and any other kind of file, goes to the tokenizers library itself. So does
    everything if the two should differ on the probes. A process loads a file once.
    """
    return once(f"encoder {path}", lambda: _load(path))


def _load(path: str):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    special = [x["content"] for x in spec.get("added_tokens", [])]
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return slow
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids):
        return slow
    import public_tokenizers

    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if any(fast.encode_ordinary(text) != slow(text) for text in probes() if not any(s in text for s in special)):
        return slow
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def cut(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int | None = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the partition, and the number in it among its length.

    Documents longer than size are cut from the back, so only the first piece may be shorter. Null texts count as empty;
    without an end id, empty documents have no piece.
    """

    def pieces(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for page in pages:
            out = []
            for key, own in zip(page["doc_id"], page["text"], strict=True):
                ids = np.array([*encode(own if isinstance(own, str) else ""), *([] if end is None else [end])], "<u4")
                begin, k, stop = 0, 0, len(ids) % size or min(size, len(ids))
                while begin < len(ids):
                    n = stop - begin
                    out.append((key, k, begin, n, zlib.crc32(ids[begin:stop].tobytes()), part, seen[n]))
                    seen[n] += 1
                    begin, k, stop = stop, k + 1, stop + size
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            frame["doc_id"] = frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None)
            yield frame

    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return own.mapInPandas(pieces, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Rows (length, first number, first sequence, offset, how many) that place counts[n] pieces of each length n."""
    left, used, rows, sequence = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0

    def longest(most: int, taken: dict[int, int]) -> int:
        for n in available[: np.searchsorted(available, most, "right")][::-1].tolist():
            if left[n] > taken.get(n, 0):
                return n
        return 0

    while left.any():
        available = np.flatnonzero(left)
        bin_, taken, gap = [], {}, size
        while gap and (n := longest(gap, taken)):
            bin_.append(n)
            taken[n] = taken.get(n, 0) + 1
            gap -= n
        if gap and len(bin_) > 1:
            least, best = bin_[-1], (bin_[-1], 0, 0)
            for a in available[: np.searchsorted(available, least + gap - 1, "right")][::-1].tolist():
                if 2 * a <= best[0] or best[0] == least + gap:
                    break
                if left[a] <= taken.get(a, 0):
                    continue
                b = longest(min(a, least + gap - a), taken | {a: taken.get(a, 0) + 1})
                if b and a + b > best[0]:
                    best = (a + b, a, b)
            if best[1]:
                bin_[-1:] = best[1:]
        need = {n: bin_.count(n) for n in bin_}
        times = int(min(left[n] // k for n, k in need.items()))
        offset = 0
        for n in bin_:
            rows.append((n, used[n], sequence, offset, times))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int | None = END, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. No row is dropped; repeated and
    null ids are documents like others; no documents give no rows. The result reads tables of `scratch`, which the caller
    may close when done."""
    scratch = scratch or Scratch(docs.sparkSession)
    pieces = scratch.save(cut(docs, tokenizer or public_tokenizer(), size, end, doc_id, text), "pieces")
    share = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    share = scratch.save(share.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "share")
    counts = np.zeros(size + 1, np.int64)
    for row in share.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[row["length"]] = row["n"]
    rows = plan(counts, size)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 48) + rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        number = number.to_numpy(np.int64)
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 48) + number, "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 2] + number - rows[at, 1], "offset": rows[at, 3]})

    out = pieces.join(share.select("length", "part", "before"), ["length", "part"])
    out = out.withColumn("__at", place(F.col("length"), F.col("nth") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
