"""Chat formatting by prefix-target expansion, with built-in DataFrame functions only.

Every assistant turn becomes a training text of its own: all turns before it as context, and only its reply trainable. A
conversation that doesn't end with an assistant turn also gives a last text without a target, so that no turn is
lost. A turn is rendered as

    ### role: text</turn>

and a line feed. Inside roles and texts, a backslash becomes two, ### becomes \\h and </turn> becomes \\t (and in roles a
colon \\c), so the marks can't occur there and the escaping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
MARKS = {"###": "\\h", "</turn>": "\\t"}
ROLE_MARKS = MARKS | {":": "\\c"}


def escape(text: Column, marks: dict[str, str] = MARKS) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, code in marks.items():
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column, marks: dict[str, str] = MARKS) -> Column:
    """Undoes escape: parts between double backslashes hold single ones only as the start of a code."""

    def plain(part: Column) -> Column:
        for mark, code in marks.items():
            part = F.replace(part, F.lit(code), F.lit(mark))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, target (number of the trained turn from 0, null for a rest without one), n_turns, formatted, loss_start and
    loss_stop (code point offsets of the trained text in formatted).

    Turns go by turn number (nulls first), then role and text; repeated rows are turns of their own. Null roles and texts
    count as empty. Rows with a null conv_id form one conversation. Other columns are ignored; no rows give no formatted texts.
    """
    turns = conversations.select(
        col(conv_id).alias("conv_id"), col(turn).alias("turn"),
        F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_MARKS), F.lit(AFTER_ROLE))
    ready = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == "assistant").alias("answers"),
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"))).alias("lines"),
    )
    last = F.size("answers") - 1
    picks = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("answers", i) | (i == last))
    one = ready.select("conv_id", "lines", F.explode_outer(picks).alias("at"), "answers")
    line = F.get("lines", F.col("at"))
    before = F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("at")), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    trained = F.get("answers", F.col("at"))
    out = one.select("conv_id", "at", trained.alias("trained"), F.concat(before, line["head"]).alias("prompt"), line["body"].alias("body"))
    begin = F.length("prompt").cast("long")
    return out.select(
        "conv_id", F.when(F.col("trained"), F.col("at")).alias("target"), (F.col("at") + 1).alias("n_turns"),
        F.concat("prompt", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trained"), begin).alias("loss_start"), F.when(F.col("trained"), begin + F.length("body")).alias("loss_stop"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role,text>>."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), ":", 1)
        body = F.substr(piece, F.length(role) + F.lit(len(OPEN) + len(AFTER_ROLE) + 1))
        return F.struct(unescape(role, ROLE_MARKS).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted texts."""
    loss = F.when(F.col("target").isNotNull(), unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int"))))
    own = formatted.select("conv_id", "n_turns", "formatted", F.col("target"), loss.alias("loss"))
    by = own.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    by = by.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(expand(own.unionByName(more)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') || ': '
                || replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10)) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
