"""Language identification by hyperdimensional letter n-gram profiles.

Every letter owns a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first
permuted (rotated) twice, the second once. A document's vector bundles (adds) the vectors of its trigrams, a language's
prototype those of its training texts; the prediction is the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fold, mix, once, sampled, small_batches

DIM = 512
BUCKETS = 1 << 18  # of trigrams, in the profiles that likeness is measured by
PENDING = 1 << 20  # trigrams of a language that are gathered before their vectors are bound
SEED = 20_241
MAX_TRAIN = 20_000  # documents of a language, by expectation, that its prototype is learned from
FEW = 0.001  # share of the training texts and their beginnings that may lie below the bound of likeness before MARGIN
MARGIN = 0.5  # of that quantile: the bound, so that clean texts unlike the training ones stay
LONGEST = 4096  # words of the longest beginning; beyond it the whole text is taken


def letter_codes() -> np.ndarray:
    """Each code point that is a letter stands for itself, any other for 0."""
    return once("letter codes", lambda: np.array([point if unicodedata.category(chr(point))[0] == "L" else 0 for point in range(0x110000)], np.int64))


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The random vector of +1 and -1 that each letter owns, drawn from its code point; one row a letter."""
    blocks = np.arange(DIM // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix(mix(letters.astype(np.uint64) + np.uint64(SEED))[:, None] + blocks)
    return (2 * np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) - 1).reshape(len(letters), DIM)


def trigrams(text: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram numbers of a text and their counts; each run of other characters counts as one boundary."""
    points = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = points > 0
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.concatenate([[0], points[keep], [0]])
    grams = np.sort((line[:-2] << 42) | (line[1:-1] << 21) | line[2:])
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram numbers: the first letter's rotated twice, the second's once, and the third's, multiplied."""
    mask = (1 << 21) - 1
    letters, back = np.unique(np.concatenate([grams >> 42, (grams >> 21) & mask, grams & mask]), return_inverse=True)
    vectors, (a, b, c) = letter_vectors(letters), back.reshape(3, -1)
    return np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]


def buckets(grams: np.ndarray) -> np.ndarray:
    return (mix(grams.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _bundles(own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The bundled vector of each text's trigrams; those of one trigram are bound once for all texts."""
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(g for g, _ in own)]))
    bound = gram_vectors(known).astype(np.float32)
    for grams, n in own:
        yield n.astype(np.float32) @ bound[np.searchsorted(known, grams)]


def _sums(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each language the sums over its texts, each counting as 1: of vectors (at 0 to DIM - 1), of trigram buckets (beyond).

    A trigram's vector is bound once for all texts gathered so far, at most PENDING trigrams of a language."""
    codes, totals, pending = letter_codes(), {}, {}

    def flush(lang: str) -> None:
        grams, n = (np.concatenate(x) for x in zip(*pending.pop(lang), strict=True))
        known, back = np.unique(grams, return_inverse=True)
        shares, total = np.bincount(back, n, len(known)), totals.setdefault(lang, np.zeros(DIM + BUCKETS))
        for i in range(0, len(known), 20_000):
            total[:DIM] += shares[i : i + 20_000] @ gram_vectors(known[i : i + 20_000])
        np.add.at(total, DIM + buckets(known), shares)

    for page in pages:
        for lang, text in zip(page["lang"], page["text"], strict=True):
            grams, n = trigrams(text, codes)
            if len(grams):
                own = pending.setdefault(lang, [])
                own.append((grams, n / n.sum()))
                if len(own) % 256 == 0 and sum(len(g) for g, _ in own) > PENDING:
                    flush(lang)
    for lang in list(pending):
        flush(lang)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "at": at, "n": total[at]})


def training(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, lang, text) of at most about max_train rows of each language where `train` holds, so that rare languages are
    learned from all their rows; a null text or language teaches nothing."""
    rows = docs.where(train & col(text).isNotNull() & col(lang).isNotNull())
    rows = rows.select(col(doc_id).alias("doc_id"), col(lang).cast("string").alias("lang"), col(text).alias("text"))
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    few = {lang: max_train / n for lang, n in there.items() if n > max_train}
    if not few:
        return rows
    shares = F.create_map(*[F.lit(x) for pair in few.items() for x in pair])
    return rows.where(sampled(F.col("doc_id"), F.coalesce(shares[F.col("lang")], F.lit(1.0)), SEED))


def profiles(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their prototypes and their profiles over the trigram buckets, as unit rows.

    What reaches the driver is at most DIM + BUCKETS numbers a language."""
    sums = rows.select("lang", "text").mapInPandas(_sums, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):
        found = sums.toPandas()
    names = sorted(set(found["lang"]))
    out = np.zeros((len(names), DIM + BUCKETS))
    out[np.searchsorted(names, found["lang"].to_numpy(str)), found["at"].to_numpy(np.int64)] = found["n"]
    unit = lambda x: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return names, unit(out[:, :DIM]), unit(out[:, DIM:])


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit rows), learned from training()."""
    return profiles(training(docs, train, text, lang, doc_id, max_train))[:2]


def _likeness(grams: np.ndarray, n: np.ndarray, units: np.ndarray) -> float:
    """Cosine of trigram counts with the nearest profile: what the cosine of vectors tends to as they grow, without noise."""
    return float((units[:, buckets(grams)] @ n).max() / np.linalg.norm(n)) if len(grams) and len(units) else 0.0


def least_likeness(rows: DataFrame, units: np.ndarray) -> np.ndarray:
    """The likeness that a text needs to count as one of a known language, by the bits of its number of distinct trigrams.

    Training texts and their beginnings of 1, 2, 4, ... words say what texts of that many trigrams reach: the bound is MARGIN
    of their FEW quantile. Numbers that no beginning has take the bound of the next smaller one, else of the next larger.
    """

    def beginnings(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = letter_codes()
        for page in pages:
            out = []
            for text in page["text"]:
                size, words = 1, text.split(maxsplit=LONGEST)
                while True:
                    whole = size >= len(words)
                    grams, n = trigrams(text if whole else " ".join(words[:size]), codes)
                    if len(grams):
                        out.append((len(grams).bit_length(), _likeness(grams, n, units)))
                    if whole:
                        break
                    size *= 2
            yield pd.DataFrame(out, columns=["bits", "likeness"])

    found = rows.select("text").mapInPandas(beginnings, "bits int, likeness double").groupBy("bits").agg(F.percentile(F.round("likeness", 5), F.lit(FEW)).alias("least"))
    with small_batches(rows.sparkSession):
        own = {r["bits"]: MARGIN * r["least"] for r in found.collect()}
    out = np.full(64, np.nan)
    for bits, least in own.items():
        out[bits] = least
    return np.maximum(pd.Series(out).ffill().bfill().fillna(0).to_numpy(), 1e-9)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", like: tuple[np.ndarray, np.ndarray] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and two more called `names`: the language, and the cosine with its prototype, 0 where negative.

    A null text, one without a letter, or a model without languages gives `und` and 0. Equal cosines: the first name.
    With like = (unit profiles, least_likeness), so do texts that are not like any language. Texts are read whole. Columns of
    docs with these names are replaced.
    """
    languages, vectors_of = model

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = letter_codes()
        for batch in batches:
            found, scores = [], []
            for begin in range(0, len(batch), 128):
                own = [trigrams(t if isinstance(t, str) else "", codes) for t in batch.iloc[begin : begin + 128]]
                for (grams, n), bundle in zip(own, _bundles(own), strict=True):
                    if not len(grams) or not languages or (like and _likeness(grams, n, like[0]) < like[1][len(grams).bit_length()]):
                        found.append("und")
                        scores.append(0.0)
                        continue
                    cosines = vectors_of @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
                    best = int(np.argmax(cosines))
                    found.append(languages[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"lang": found, "score": scores})

    keep = [col(c) for c in docs.columns if c not in names]
    out = docs.select(*keep, of(col(text)).alias("__langid"))
    return out.select(*keep, F.col("__langid.lang").alias(names[0]), F.col("__langid.score").alias(names[1]))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held_out)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
