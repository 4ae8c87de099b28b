"""Scores of free text by word lists: counts, ranking signals, category hits, severity, filters, re-ranking, the review funnel.

All of it is expressions over the row: a text's words are read once and nothing is shuffled to score it. Word lists,
patterns and weights are parameters; the defaults are neutral ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "[A-Za-z]+(?:'[A-Za-z]+)?"


@dataclass(frozen=True)
class Lexicon:
    """Words of three tiers, and those that count as names where only their first letter is a capital."""

    strong: tuple[str, ...] = ("idiot", "moron", "scum")
    medium: tuple[str, ...] = ("stupid", "loser", "trash")
    mild: tuple[str, ...] = ("clown", "pathetic")
    names: tuple[str, ...] = ("trash", "clown")


@dataclass(frozen=True)
class Categories:
    """Words, censored spellings and weights of categories, and what their hits are filtered by.

    words: category to words, the first category settling ties; censored: (category, root, pattern), whose hits are called
    root*; traps: root to a pattern of names that hold it; blocked: group to words that are no hits there; ambiguous words
    count only beside a confident one or where `explicit` is found.
    """

    words: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"insult": ("idiot", "moron"), "scorn": ("scum", "loser"), "slight": ("stupid", "trash", "clown", "pathetic")})
    censored: Sequence[tuple[str, str, str]] = (("insult", "idiot", r"\bid[!1*]{1,3}t\b"), ("slight", "stupid", r"\bst[*@]{1,2}pid\b"))
    weights: Mapping[str, float] = field(default_factory=lambda: {"insult": 3.0, "scorn": 2.0, "slight": 1.0})
    traps: Mapping[str, str] = field(default_factory=lambda: {"clown": r"(?i)\bclown (?:fish|shoes)", "trash": r"(?i)\btrash can"})
    blocked: Mapping[str, Sequence[str]] = field(default_factory=lambda: {"src2": ("trash",)})
    ambiguous: Sequence[str] = ("stupid", "clown")
    confident: Sequence[str] = ("idiot", "moron", "scum")
    explicit: str = r"(?i)\b(?:hate|despise)"


MULTI_CENSOR = r"\b\w\*{3,}\s+\w\*{3,}"  # names that a text has censored itself
CAPITAL_CENSOR = r"\b[A-Z]\*{4,}"
CONTEXTS = {"quote": r"(?i)\b(?:he|she|they) (?:said|called)", "deploy": r"(?i)\byou(?: are|'re)?\b", "reclaim": r"(?i)\bproud\b"}
CONTEXT_WEIGHTS = {"deploy": 1.25, "quote_crit": 0.35, "reclaim": 0.25, "ambiguous": 0.85}


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _listed(text: Column, words: Sequence[str]) -> Column:
    """The listed words of a text, in lower case and as often as they occur."""
    return F.filter(F.transform(words_of(text), F.lower), lambda w: w.isin(*words))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def is_caps(word: Column) -> Column:
    return (F.length(word) >= 4) & (word == F.upper(word))


def with_word_stats(df: DataFrame, text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """df and words, strong, medium, mild, caps_ratio (share of words of four letters or more in capitals), exclam.

    A text without words has one, an empty or null text none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tiers = {"strong": lexicon.strong, "medium": lexicon.medium, "mild": lexicon.mild}
    every = [w for own in tiers.values() for w in own]

    def counted(words: Column) -> Column:
        listed = F.filter(F.transform(words, F.lower), lambda w: w.isin(*every))
        return F.struct(F.size(words).alias("n"), F.size(F.filter(words, is_caps)).alias("caps"), listed.alias("listed"))

    own = df.withColumn("__w", let(words_of(F.col(text)), counted))
    n, some = F.col("__w.n"), lambda own: F.size(F.filter("__w.listed", lambda w: w.isin(*own)))
    return own.withColumns({
        "words": F.when(t == "", 0).otherwise(F.greatest(n, F.lit(1))), **{name: some(words) for name, words in tiers.items()},
        "caps_ratio": F.col("__w.caps") / F.greatest(n, F.lit(1)).cast("double"), "exclam": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
    }).drop("__w")


def lexicon_score() -> Column:
    """Over the columns of with_word_stats()."""
    return F.round(F.expr("3D * strong + 1.5D * medium + 0.4D * mild + 6D * caps_ratio + 0.08D * least(exclam, 50)"), 3)


def signals(rating: str = "rating") -> dict[str, Column]:
    """Seven ranking signals over the columns of with_word_stats() and a rating of 1 to 5."""
    five = F.col(rating) >= 5
    return {
        "strong": F.expr("strong + 0.4D * medium"),
        "rant": F.when(F.col("words") >= 80, F.expr("least(words, 1500) / 80D + 2D * strong + 8D * caps_ratio + 0.1D * least(exclam, 80)")).otherwise(0.0),
        "screaming": F.col("caps_ratio") * F.sqrt("words"),
        "exclamation": F.col("exclam").cast("double"),
        "short": F.when(F.col("words") <= 30, F.expr("(4D * strong + 2D * medium + 0.5D * mild) / greatest(words, 1)")).otherwise(0.0),
        "five_star_obscene": F.when(five, F.expr("3D * strong + 1.2D * medium")).otherwise(0.0),
        "five_star_one_word": F.when(five & (F.col("words") == 0), 1.0).when(five & (F.col("words") <= 3), 1 / F.greatest(F.col("words"), F.lit(1)).cast("double")).otherwise(0.0),
    }


def topk_signals(df: DataFrame, group: str, key: str, of: Mapping[str, Column], k: int = 40, digits: int = 6) -> DataFrame:
    """group, signal, key, score: the k best rows with a positive score of each group and signal."""
    long = df.select(group, key, F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.round(x, digits).alias("score")) for n, x in of.items()])).alias("s"))
    long = long.select(group, "s.signal", key, "s.score").where("score > 0")
    place = F.row_number().over(W.partitionBy(group, "signal").orderBy(F.desc("score"), key))
    return long.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def category_hits(text: Column, rules: Categories = Categories()) -> Column:
    """array<struct<category,word,n>>: listed words that occur, and censored spellings as root*."""
    t = F.coalesce(text, F.lit(""))
    hit = lambda category, word, n: F.struct(F.lit(category).alias("category"), F.lit(word).alias("word"), n.cast("int").alias("n"))

    def counted(words: Column) -> Column:
        count = lambda w: F.size(F.filter(words, lambda x: x == w))
        return F.array(*[hit(c, w, count(w)) for c, own in rules.words.items() for w in own])

    exact = let(_listed(text, [w for own in rules.words.values() for w in own]), counted)
    censored = F.array(*[hit(c, f"{root}*", F.regexp_count(t, F.lit("(?i)" + p))) for c, root, p in rules.censored])
    return F.filter(F.concat(exact, censored), lambda h: h["n"] > 0)


def severity(hits: Column, rules: Categories = Categories(), caps: Column | None = None, exclam: Column | None = None) -> Column:
    """The weighted hits of each category, each further distinct word counting half, and energy from capitals and exclamations."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))

    def of(category: str, weight: float) -> Column:
        def step(acc, h):
            mine = (h["category"] == category).cast("int")
            return F.struct((acc["n"] + mine * h["n"]).alias("n"), (acc["words"] + mine).alias("words"))

        return F.aggregate(hits, none, step, lambda acc: F.when(acc["words"] > 0, weight * (acc["n"] + 0.5 * (acc["words"] - 1))).otherwise(0.0))

    out = reduce(Column.__add__, [of(c, w) for c, w in rules.weights.items()])
    if caps is not None:
        out = out + F.least(caps, F.lit(0.25)) * 8
    return out if exclam is None else out + F.least(exclam, F.lit(40)) * 0.05


def context(text: Column, patterns: Mapping[str, str] = CONTEXTS, most: int = 4000) -> Column:
    """deploy, quote_crit, reclaim or ambiguous, from the beginning of a text."""
    t = F.left(F.coalesce(text, F.lit("")), F.lit(most))
    quote, deploy, reclaim = (t.rlike(patterns[k]) for k in ("quote", "deploy", "reclaim"))
    return F.when(deploy, "deploy").when(quote, "quote_crit").when(reclaim, "reclaim").otherwise("ambiguous")


def by_context(context: Column, weights: Mapping[str, float]) -> Column:
    return reduce(lambda w, x: w.when(context == x[0], x[1]), weights.items(), F).otherwise(1.0)


def filter_hits(hits: Column, text: Column, group: Column, rules: Categories = Categories()) -> Column:
    """Hits without names, self-censored names, words blocked in the group, and ambiguous words without support, in this order."""
    t = F.coalesce(text, F.lit(""))
    root = lambda h: F.rtrim(h["word"], F.lit("*"))
    censored = t.rlike("(?i)" + MULTI_CENSOR) | (F.regexp_count(t, F.lit(CAPITAL_CENSOR)) >= 2)

    def stands(h: Column) -> Column:
        gone = [(root(h) == word) & t.rlike(pattern) for word, pattern in rules.traps.items()]
        gone += [h["word"].endswith("*") & censored, *[(group == name) & h["word"].isin(*words) for name, words in rules.blocked.items()]]
        return ~reduce(Column.__or__, gone)

    def supported(kept: Column) -> Column:
        sure = F.exists(kept, lambda h: h["word"].isin(*rules.confident)) | t.rlike(rules.explicit)
        return F.when(sure, kept).otherwise(F.filter(kept, lambda h: ~root(h).isin(*rules.ambiguous)))

    return let(F.filter(hits, stands), supported)


@dataclass(frozen=True)
class Rerank:
    """Weights and patterns of rerank(): hard words without which hits of the last category alone don't count, groups of
    fiction and of physical things, texts that only tell of the words, complaints."""

    weights: Mapping[str, float] = field(default_factory=lambda: {"insult": 25.0, "scorn": 8.0, "slight": 1.0})
    contexts: Mapping[str, float] = field(default_factory=lambda: {"deploy": 1.5, "quote_crit": 0.3, "reclaim": 0.15, "ambiguous": 0.85})
    plain: str = "slight"
    hard: Sequence[str] = ("stupid",)
    alone: str = "scorn"
    heavy: Sequence[str] = ("insult",)
    fiction: Sequence[str] = ("src1", "src3")
    physical: Sequence[str] = ("src2", "src4")
    stories: str = r"(?i)\b(?:novel|chapter)\b"
    songs: str = r"(?i)\b(?:lyrics|album)\b"
    complaints: str = r"(?i)\b(?:broken|refund|waste)\b"
    hard_complaints: str = r"(?i)\bnever again\b"


def rerank(hits: Column, text: Column, context: Column, group: Column, rating: Column, words: Column, caps: Column, exclam: Column, rules: Rerank = Rerank()) -> Column:
    """The severity of a scored text after all adjustments, whose order matters; 0 where no hit stands."""
    t = F.coalesce(text, F.lit(""))
    in_any = lambda names: F.exists(hits, lambda h: h["category"].isin(*names))
    hard = F.exists(hits, lambda h: (h["category"] == rules.plain) & h["word"].isin(*rules.hard))
    stands = hard | F.exists(hits, lambda h: h["category"] != rules.plain)
    only = (F.size(hits) > 0) & ~F.exists(hits, lambda h: h["category"] != rules.alone)
    fiction, physical = group.isin(*rules.fiction), group.isin(*rules.physical) & ~group.isin(*rules.fiction)
    # Each step uses the score once: a factor and a summand, 1 and 0 where the step doesn't hold.
    s = severity(hits, Categories(weights=rules.weights)) * by_context(context, rules.contexts)
    s = s * F.when(fiction, F.when(context == "deploy", 0.6).otherwise(0.25)).when(physical, 1.4).otherwise(1.0)
    s = s * F.when(fiction & only, 0.2).otherwise(1.0) + F.when(physical, 4.0).otherwise(0.0)
    s = s * F.when(t.rlike(rules.stories), 0.3).otherwise(1.0)
    s = s * F.when(t.rlike(rules.songs) & in_any(rules.heavy), 0.35).otherwise(1.0)
    s = s + F.regexp_count(t, F.lit(rules.complaints)) * 1.4 + F.when(t.rlike(rules.hard_complaints), 5.0).otherwise(0.0)
    s = s * F.when(rating == 1, 1.15).when(rating == 4, 0.55).when(rating == 5, 0.35).otherwise(1.0) + F.when(rating == 1, 8.0).when(rating == 2, 3.0).otherwise(0.0)
    s = s + caps * 10 + F.least(exclam, F.lit(20)) * 0.15
    s = s * F.when((words > 0) & (words < 10), 0.5).when(words > 600, 0.8).otherwise(1.0)
    return F.when(stands, F.round(s, 3)).otherwise(0.0)


def variety(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """struct<severity,variety,distinct>: words weigh 3, 2 and 1 by tier, names left out; variety grows with distinct strong ones."""
    t = F.coalesce(text, F.lit(""))
    shouting = t == F.upper(t)
    name = lambda w: (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (w != F.upper(w)) & ~shouting & F.lower(w).isin(*lexicon.names)
    every = [*lexicon.strong, *lexicon.medium, *lexicon.mild]

    def scored(words: Column) -> Column:
        some = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
        distinct = F.size(F.array_distinct(F.filter(words, lambda w: w.isin(*lexicon.strong))))
        total = (3 * some(lexicon.strong) + 2 * some(lexicon.medium) + some(lexicon.mild)).cast("double")
        return F.struct(total.alias("severity"), (total * (1 + 0.5 * distinct)).alias("variety"), distinct.alias("distinct"))

    own = F.transform(F.filter(words_of(text), lambda w: F.lower(w).isin(*every) & ~name(w)), F.lower)
    return let(own, scored)


def top_share(words: Column) -> Column:
    """struct<n,share>: the share of the commonest word of an array, counted along the sorted array."""
    none = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, w):
        run = F.when(acc["word"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    def shared(own: Column) -> Column:
        best = F.aggregate(own, none, step, lambda acc: acc["best"])
        return F.struct(F.size(own).alias("n"), F.coalesce(F.try_divide(best.cast("double"), F.size(own)), F.lit(0.0)).alias("share"))

    return let(F.sort_array(words), shared)  # array_sort() would compare by an interpreted function


def repeats_itself(text: Column, times: int = 4, upto: int = 600) -> Column:
    """Does a piece of 15, 20, 30 or 40 characters, from every tenth place on, occur `times` times in the text's beginning?"""

    def any_piece(s: Column) -> Column:
        def some(size: int) -> Column:
            last = F.least(F.length(s) - size, F.lit(200)) - 1
            piece = lambda i: F.substr(s, i + 1, F.lit(size))
            often = lambda i: (F.trim(piece(i)) != "") & ((F.length(s) - F.length(F.replace(s, piece(i), F.lit("")))) >= times * size)
            return F.when(last >= 0, F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(10)), often)).otherwise(False)

        return reduce(Column.__or__, [some(n) for n in (15, 20, 30, 40)])

    return let(F.left(F.coalesce(text, F.lit("")), F.lit(upto)), any_piece)


def repetitive(top: Column, long: int = 15, bar: float = 0.5) -> Column:
    """Is one word, by top_share(), over 0.7 of three words or more, or over a bar of a long text?"""
    return (top["n"] >= 3) & (((top["n"] >= long) & (top["share"] > bar)) | (top["share"] > 0.7))


def is_spam(text: Column, strict: bool = False) -> Column:
    """No text, or one word being most of it; strict: a lower bar for long texts, and pieces that repeat themselves."""
    long, bar = (20, 0.45) if strict else (15, 0.5)

    def judged(top: Column) -> Column:
        out = repetitive(top, long, bar)
        return out | (top["n"] >= 3) & repeats_itself(text) if strict else out

    return (F.coalesce(F.length(text), F.lit(0)) == 0) | let(top_share(F.transform(words_of(text), F.lower)), judged)


KEYWORDS = ("roach", "mouse", "ghost", "scary", "police", "fight", "leak", "smell", "alarm", "loud", "spider", "midnight")
REFUSALS = ("would not stay", "would not recommend", "do not stay")
ODD_FIVE = ("but ", "however ", "scary", "weird", "strange")


def tier1(text: Column, keywords: Sequence[str] = KEYWORDS, markers: str = r"(?i)\b(?:however|but)\b") -> Column:
    """The funnel's first score: 2 for each keyword that occurs, 1.5 for each marker, and bonuses for length and phrases."""
    t = F.coalesce(text, F.lit(""))

    def scored(low: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        any_of = lambda words: reduce(Column.__or__, [has(w) for w in words])
        hits = reduce(Column.__add__, [has(k).cast("int") for k in keywords])
        return 2.0 * hits + F.when(any_of(REFUSALS), 1.0).otherwise(0.0) + F.when(has("five stars") & any_of(ODD_FIVE), 2.0).otherwise(0.0)

    return let(F.lower(t), scored) + 1.5 * F.regexp_count(t, F.lit(markers)) + F.when(F.length(t).between(200, 1500), 0.5).otherwise(0.0)


def funnel(scored: DataFrame, vectors: DataFrame, key: str, vector: str, first: int = 250_000, clusters: int = 40, last: int = 12_000, seed: int = 42) -> DataFrame:
    """key, score, cluster, cluster_rank, combined: of the `first` best of scored(key, score) those with a vector are
    clustered; a cluster's place by mean score (the average place, cut to a whole number) costs a tenth each; the `last` best."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    best = scored.orderBy(F.desc("score"), key).limit(first).join(vectors, key).select(key, "score", array_to_vector(vector).alias("features"))
    best = best.persist(StorageLevel.DISK_ONLY)  # at most `first` rows, which the clustering reads again and again
    n = best.count()
    if not n:
        return best.select(key, "score", F.lit(0).alias("cluster"), F.lit(0).alias("cluster_rank"), "score").toDF(key, "score", "cluster", "cluster_rank", "combined")
    found = KMeans(k=min(clusters, n), seed=seed, maxIter=20).fit(best).transform(best).select(key, "score", F.col("prediction").alias("cluster"))
    mean = found.groupBy("cluster").agg(F.avg("score").alias("mean"))  # a row a cluster
    place = F.rank().over(W.orderBy(F.desc("mean"))) + (F.count("*").over(W.partitionBy("mean")) - 1) / 2
    ranked = mean.select("cluster", F.floor(place).cast("int").alias("cluster_rank"))
    out = found.join(F.broadcast(ranked), "cluster").withColumn("combined", F.col("score") - 0.1 * F.col("cluster_rank"))
    return out.orderBy(F.desc("combined"), key).limit(last).select(key, "score", "cluster", "cluster_rank", "combined")
