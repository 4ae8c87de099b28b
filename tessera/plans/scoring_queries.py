"""Scores of documents by word lists: every query calls tessera.operators.scoring; the SQL states the same rules apart.

The tables give no rating, so document n counts as rated 1 + n mod 5; a document's group is its source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import scoring as S



def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", (1 + F.col("doc_id") % 5).cast("int").alias("rating"))


def stats(spark, sf_dir):
    return S.with_word_stats(docs(spark, sf_dir))


# -- the second engine's side; fixed values: words, patterns and weights as in tessera.operators.scoring

_D = r"SELECT doc_id, source, coalesce(text, '') AS t, CAST(1 + doc_id % 5 AS INTEGER) AS rating, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:''[A-Za-z]+)?') AS w FROM documents"
_COUNT = "len(list_filter(w, lambda x: lower(x) IN ({})))"
_STATS = f"""SELECT *, CASE WHEN t = '' THEN 0 ELSE greatest(len(w), 1) END AS words, {_COUNT.format("'idiot', 'moron', 'scum'")} AS strong,
{_COUNT.format("'stupid', 'loser', 'trash'")} AS medium, {_COUNT.format("'clown', 'pathetic'")} AS mild,
CAST(len(list_filter(w, lambda x: length(x) >= 4 AND x = upper(x))) AS DOUBLE) / greatest(len(w), 1) AS caps_ratio, length(t) - length(replace(t, '!', '')) AS exclam FROM ({_D})"""


def _hit(category: str, word: str, n: str) -> str:
    return f"struct_pack(category := '{category}', word := '{word}', n := CAST({n} AS INTEGER))"


_WORD = "len(list_filter(w, lambda x: lower(x) = '{}'))"
_FOUND = "list_filter([" + ", ".join(
    [_hit(c, w, _WORD.format(w)) for c, w in (("insult", "idiot"), ("insult", "moron"), ("scorn", "scum"), ("scorn", "loser"), ("slight", "stupid"), ("slight", "trash"), ("slight", "clown"), ("slight", "pathetic"))]
    + [_hit("insult", "idiot*", r"len(regexp_extract_all(t, '(?i)\bid[!1*]{1,3}t\b'))"), _hit("slight", "stupid*", r"len(regexp_extract_all(t, '(?i)\bst[*@]{1,2}pid\b'))")]
) + "], lambda h: h.n > 0)"
_HITS = f"SELECT *, {_FOUND} AS hits FROM ({_STATS})"


def _severity(hits: str, weights: dict[str, float]) -> str:
    own = "list_filter({}, lambda z: z.category = '{}')"
    parts = []
    for c, x in weights.items():
        some = own.format(hits, c)
        parts.append(f"CASE WHEN len({some}) > 0 THEN CAST({x} AS DOUBLE) * (list_sum(list_transform({some}, lambda z: z.n)) + CAST(0.5 AS DOUBLE) * (len({some}) - 1)) ELSE CAST(0 AS DOUBLE) END")
    return "(" + " + ".join(parts) + ")"


_CONTEXT = r"CASE WHEN regexp_matches(left(t, 4000), '(?i)\byou(?: are|''re)?\b') THEN 'deploy' WHEN regexp_matches(left(t, 4000), '(?i)\b(?:he|she|they) (?:said|called)') THEN 'quote_crit' WHEN regexp_matches(left(t, 4000), '(?i)\bproud\b') THEN 'reclaim' ELSE 'ambiguous' END"
_SEVERE = f"SELECT doc_id, source, hits, {_CONTEXT} AS context, {_severity('hits', {'insult': 3, 'scorn': 2, 'slight': 1})} + least(caps_ratio, CAST(0.25 AS DOUBLE)) * 8 + least(exclam, 40) * CAST(0.05 AS DOUBLE) AS s FROM ({_HITS}) WHERE len(hits) > 0"
_STEPS = [
    r"CASE WHEN regexp_matches(t, '(?i)\bclown (?:fish|shoes)') THEN list_filter(h, lambda x: rtrim(x.word, '*') <> 'clown') ELSE h END",
    r"CASE WHEN regexp_matches(t, '(?i)\btrash can') THEN list_filter(h, lambda x: rtrim(x.word, '*') <> 'trash') ELSE h END",
    r"CASE WHEN regexp_matches(t, '(?i)\b\w\*{3,}\s+\w\*{3,}') OR len(regexp_extract_all(t, '\b[A-Z]\*{4,}')) >= 2 THEN list_filter(h, lambda x: NOT ends_with(x.word, '*')) ELSE h END",
    "CASE WHEN source = 'src2' THEN list_filter(h, lambda x: x.word <> 'trash') ELSE h END",
    r"CASE WHEN len(list_filter(h, lambda x: x.word IN ('idiot', 'moron', 'scum'))) > 0 OR regexp_matches(t, '(?i)\b(?:hate|despise)') THEN h ELSE list_filter(h, lambda x: rtrim(x.word, '*') NOT IN ('stupid', 'clown')) END",
]
_KEPT = f"SELECT *, hits AS h FROM ({_HITS})"
for _step in _STEPS:
    _KEPT = f"SELECT * REPLACE ({_step} AS h) FROM ({_KEPT})"


@query(f"SELECT doc_id, round(3 * strong + 1.5 * medium + 0.4 * mild + 6 * caps_ratio + 0.08 * least(exclam, 50), 3) AS score FROM ({_STATS})")
def lexicon_score(spark, sf_dir):
    return stats(spark, sf_dir).select("doc_id", S.lexicon_score().alias("score"))


_SIGNALS = f"""SELECT doc_id, source, unnest([
struct_pack(signal := 'strong', score := CAST(strong + 0.4 * medium AS DOUBLE)),
struct_pack(signal := 'rant', score := CASE WHEN words >= 80 THEN least(words, 1500) / CAST(80 AS DOUBLE) + 2 * strong + 8 * caps_ratio + CAST(0.1 AS DOUBLE) * least(exclam, 80) ELSE 0 END),
struct_pack(signal := 'screaming', score := caps_ratio * sqrt(words)),
struct_pack(signal := 'exclamation', score := CAST(exclam AS DOUBLE)),
struct_pack(signal := 'short', score := CASE WHEN words <= 30 THEN CAST(4 * strong + 2 * medium + 0.5 * mild AS DOUBLE) / greatest(words, 1) ELSE 0 END),
struct_pack(signal := 'five_star_obscene', score := CASE WHEN rating >= 5 THEN CAST(3 * strong + 1.2 * medium AS DOUBLE) ELSE 0 END),
struct_pack(signal := 'five_star_one_word', score := CASE WHEN rating >= 5 AND words = 0 THEN 1 WHEN rating >= 5 AND words <= 3 THEN CAST(1 AS DOUBLE) / words ELSE 0 END)], recursive := true) FROM ({_STATS})"""


@query(f"SELECT source, signal, doc_id, round(score, 6) AS score FROM ({_SIGNALS}) WHERE round(score, 6) > 0 QUALIFY row_number() OVER (PARTITION BY source, signal ORDER BY round(score, 6) DESC, doc_id) <= 40")
def topk_multi_signal(spark, sf_dir):
    """The 40 best documents of each source along each of the seven signals."""
    return S.topk_signals(stats(spark, sf_dir), "source", "doc_id", S.signals())


def _hits(spark, sf_dir):
    return stats(spark, sf_dir).withColumn("hits", S.category_hits(F.col("text")))


@query(f"SELECT doc_id, unnest(hits, recursive := true) FROM ({_HITS})")
def category_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.inline("hits"))


@query(f"SELECT doc_id, context, CAST(list_sum(list_transform(hits, lambda h: h.n)) AS BIGINT) AS hits, round(s * CASE context WHEN 'deploy' THEN CAST(1.25 AS DOUBLE) WHEN 'quote_crit' THEN 0.35 WHEN 'reclaim' THEN 0.25 ELSE 0.85 END, 3) AS severity FROM ({_SEVERE})")
def category_severity(spark, sf_dir):
    """Documents with hits: their context and the severity that it scales."""
    own = _hits(spark, sf_dir).where(F.size("hits") > 0).withColumn("context", S.context(F.col("text")))
    n = F.aggregate("hits", F.lit(0), lambda s, h: s + h["n"]).cast("long")
    score = S.severity(F.col("hits"), caps=F.col("caps_ratio"), exclam=F.col("exclam")) * S.by_context(F.col("context"), S.CONTEXT_WEIGHTS)
    return own.select("doc_id", "context", n.alias("hits"), F.round(score, 3).alias("severity"))


@query(f"""SELECT source, count(*) AS n, count(*) FILTER (strong + medium + mild > 0) AS n_profane, round(CAST(count(*) FILTER (strong + medium + mild > 0) AS DOUBLE) / count(*), 4) AS rate, round(avg(length(t)), 1) AS mean_length,
{", ".join(f"count(*) FILTER (rating = {k}) AS rated_{k}" for k in range(1, 6))} FROM ({_STATS}) GROUP BY source""")
def category_report(spark, sf_dir):
    """Each source's documents, those with listed words, mean length and ratings; its best documents are in topk_multi_signal."""
    profane = F.count_if(F.expr("strong + medium + mild > 0"))
    rated = [F.count_if(F.col("rating") == k).alias(f"rated_{k}") for k in range(1, 6)]
    length = F.avg(F.length(F.coalesce("text", F.lit(""))))
    return stats(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), profane.alias("n_profane"), F.round(profane.cast("double") / F.count("*"), 4).alias("rate"), F.round(length, 1).alias("mean_length"), *rated)


@query("SELECT doc_id, unnest(h, recursive := true) FROM (" + _KEPT + ")")
def trap_filter(spark, sf_dir):
    """Hits that stand after names, self-censored names, words blocked in a source and unsupported ambiguous ones are gone."""
    kept = S.filter_hits(F.col("hits"), F.col("text"), F.col("source"))
    return _hits(spark, sf_dir).where(F.size("hits") > 0).select("doc_id", F.inline(kept))


@query(f"SELECT doc_id, {_CONTEXT} AS class FROM ({_D})")
def context_class(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.context(F.col("text")).alias("class"))


_CHAIN = [
    f"{_severity('h', {'insult': 25, 'scorn': 8, 'slight': 1})} * CASE context WHEN 'deploy' THEN CAST(1.5 AS DOUBLE) WHEN 'quote_crit' THEN 0.3 WHEN 'reclaim' THEN 0.15 ELSE 0.85 END",
    "CASE WHEN source IN ('src1', 'src3') THEN s * CASE WHEN context = 'deploy' THEN CAST(0.6 AS DOUBLE) ELSE 0.25 END * CASE WHEN len(list_filter(h, lambda x: x.category <> 'scorn')) = 0 THEN CAST(0.2 AS DOUBLE) ELSE 1 END WHEN source IN ('src2', 'src4') THEN s * CAST(1.4 AS DOUBLE) + 4 ELSE s END",
    r"s * CASE WHEN regexp_matches(t, '(?i)\b(?:novel|chapter)\b') THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN regexp_matches(t, '(?i)\b(?:lyrics|album)\b') AND len(list_filter(h, lambda x: x.category = 'insult')) > 0 THEN CAST(0.35 AS DOUBLE) ELSE 1 END",
    r"s + len(regexp_extract_all(t, '(?i)\b(?:broken|refund|waste)\b')) * CAST(1.4 AS DOUBLE) + CASE WHEN regexp_matches(t, '(?i)\bnever again\b') THEN 5 ELSE 0 END",
    "CASE rating WHEN 1 THEN s * CAST(1.15 AS DOUBLE) + 8 WHEN 2 THEN s + 3 WHEN 4 THEN s * CAST(0.55 AS DOUBLE) WHEN 5 THEN s * CAST(0.35 AS DOUBLE) ELSE s END",
    "s + caps_ratio * 10 + least(exclam, 20) * CAST(0.15 AS DOUBLE)",
    "s * CASE WHEN words BETWEEN 1 AND 9 THEN CAST(0.5 AS DOUBLE) WHEN words > 600 THEN 0.8 ELSE 1 END",
]
_RERANKED = f"SELECT *, CAST(0 AS DOUBLE) AS s FROM (SELECT *, {_CONTEXT} AS context FROM ({_KEPT})) WHERE len(list_filter(h, lambda x: x.category <> 'slight' OR x.word = 'stupid')) > 0"
for _step in _CHAIN:
    _RERANKED = f"SELECT * REPLACE ({_step} AS s) FROM ({_RERANKED})"


@query(f"SELECT doc_id, round(s, 3) AS score FROM ({_RERANKED}) WHERE round(s, 3) > 0")
def rerank_score(spark, sf_dir):
    """Documents whose hits stand, by their severity after the whole chain of adjustments."""
    own = _hits(spark, sf_dir).where(F.size("hits") > 0).withColumn("context", S.context(F.col("text")))
    own = own.withColumn("hits", S.filter_hits(F.col("hits"), F.col("text"), F.col("source")))
    score = S.rerank(F.col("hits"), F.col("text"), F.col("context"), F.col("source"), F.col("rating"), F.col("words"), F.col("caps_ratio"), F.col("exclam"))
    return own.select("doc_id", score.alias("score")).where("score > 0")


_NAMED = "list_transform(list_filter(w, lambda x: NOT (upper(x[1]) = x[1] AND x <> upper(x) AND t <> upper(t) AND lower(x) IN ('trash', 'clown'))), lambda x: lower(x))"
_IN = "len(list_filter(v, lambda x: x IN ({})))"


@query(f"""SELECT doc_id, severity, severity * (1 + CAST(0.5 AS DOUBLE) * "distinct") AS variety, "distinct" FROM (SELECT doc_id, CAST(3 * {_IN.format("'idiot', 'moron', 'scum'")} + 2 * {_IN.format("'stupid', 'loser', 'trash'")} + {_IN.format("'clown', 'pathetic'")} AS DOUBLE) AS severity,
len(list_distinct(list_filter(v, lambda x: x IN ('idiot', 'moron', 'scum')))) AS "distinct" FROM (SELECT *, {_NAMED} AS v FROM ({_D}))) WHERE "distinct" >= 2 OR severity >= 6""")
def variety_score(spark, sf_dir):
    """Documents with two distinct strong words or a severity of 6."""
    own = docs(spark, sf_dir).select("doc_id", S.variety(F.col("text")).alias("v")).select("doc_id", "v.*")
    return own.where("distinct >= 2 or severity >= 6")


_TOP = "(SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(l) AS x) GROUP BY x))"
_SHARES = f"SELECT doc_id, t, len(l) AS n, coalesce(CAST({_TOP} AS DOUBLE) / nullif(len(l), 0), 0) AS share FROM (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM ({_D}))"


@query(f"SELECT doc_id, t = '' OR (n >= 3 AND ((n >= 15 AND share > 0.5) OR share > 0.7)) AS spam, round(share, 6) AS share FROM ({_SHARES})")
def spam_flag(spark, sf_dir):
    """Is most of a document one word? Counted inside the row."""
    own = docs(spark, sf_dir).select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("none"), S.top_share(F.transform(S.words_of(F.col("text")), F.lower)).alias("top"))
    return own.select("doc_id", (F.col("none") | S.repetitive(F.col("top"))).alias("spam"), F.round("top.share", 6).alias("share"))


_PIECES = " OR ".join(f"len(list_filter(range(0, CAST(least(length(s) - {n}, 200) AS BIGINT), 10), lambda i: trim(s[i + 1:i + {n}]) <> '' AND length(s) - length(replace(s, s[i + 1:i + {n}], '')) >= 4 * {n})) > 0" for n in (15, 20, 30, 40))


@query(f"SELECT doc_id, t = '' OR (n >= 3 AND ((n >= 20 AND share > 0.45) OR share > 0.7 OR {_PIECES})) AS spam FROM (SELECT *, left(t, 600) AS s FROM ({_SHARES}))")
def spam_strict(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", S.is_spam(F.col("text"), strict=True).alias("spam"))


_KEYS = ("roach", "mouse", "ghost", "scary", "police", "fight", "leak", "smell", "alarm", "loud", "spider", "midnight")
_TIER1 = f"""SELECT doc_id, {" + ".join(f"CASE WHEN contains(lower(t), '{k}') THEN CAST(2 AS DOUBLE) ELSE 0 END" for k in _KEYS)} + CAST(1.5 AS DOUBLE) * len(regexp_extract_all(t, '(?i)\\b(?:however|but)\\b')) + CASE WHEN length(t) BETWEEN 200 AND 1500 THEN CAST(0.5 AS DOUBLE) ELSE 0 END
+ CASE WHEN regexp_matches(lower(t), 'would not stay|would not recommend|do not stay') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'five stars') AND regexp_matches(lower(t), 'but |however |scary|weird|strange') THEN 2 ELSE 0 END AS score FROM ({_D})"""


@query(f"{_TIER1} ORDER BY score DESC, doc_id LIMIT 200")
def heuristic_tier1(spark, sf_dir):
    """The 200 best documents of the funnel's first tier."""
    return docs(spark, sf_dir).select("doc_id", S.tier1(F.col("text")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)


@query()
def funnel(spark, sf_dir):
    """First tier, vectors (of the same number as the document), clusters and their ranks, combined score."""
    scored = docs(spark, sf_dir).select("doc_id", S.tier1(F.col("text")).alias("score"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return S.funnel(scored, vectors, "doc_id", "embedding", first=250_000, clusters=40, last=12_000)
