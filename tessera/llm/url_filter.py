"""URL filters by a temporal list join, with built-in DataFrame functions only.

Dated list entries (block, allow or remove a domain, host or path prefix) become validity intervals: an entry holds from
its date until the next entry of the same kind and value. Every capture is joined, as of its fetch time, with the
intervals of its host, its parent domains and its path prefixes; the most specific entry that holds decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]*?)\.?(?:[/:?#]|$)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
RANK = {"prefix": 3, "host": 2, "domain": 1}


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, action, since, until (null: still holds) from entries(kind, value, action, dated).

    Entries with a null in any column are no entries. Of several at one time, remove goes before allow before block, so
    the last holds; the others hold for no time. Hosts, those of prefixes too, and domains are compared in lower case.
    """
    own = entries.select(*[col(c).alias(c) for c in ("kind", "value", "action", "dated")]).dropna()
    own = own.where(F.col("kind").isin(*RANK) & F.col("action").isin("block", "allow", "remove"))
    prefix = F.concat(F.lower(F.regexp_extract("value", "^[^/]*", 0)), F.regexp_extract("value", "(?s)^[^/]*(.*)$", 1))
    own = own.withColumn("value", F.when(F.col("kind") == "prefix", F.rtrim(prefix, F.lit("/"))).otherwise(F.lower("value")))
    order = F.when(F.col("action") == "remove", 0).when(F.col("action") == "allow", 1).otherwise(2)
    until = F.lead("dated").over(W.partitionBy("kind", "value").orderBy("dated", order))
    held = own.withColumn("until", until).where((F.col("action") != "remove") & (F.col("until").isNull() | (F.col("until") > F.col("dated"))))
    return held.select("kind", "value", "action", F.col("dated").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: key, host, fetched_at, decision (block, allow or none), kind, value, since.

    A null or unreadable URL has no host and matches nothing, as does a null fetch time. Prefix beats host beats domain,
    then the longer value; a prefix without a path holds for its whole host. Captures with equal keys are told apart; other columns of captures are ignored. The path
    prefixes tried are as deep as the deepest listed one, so very long URLs don't multiply.
    """
    held = intervals(entries)
    deep = held.where("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    base = captures.select(
        F.monotonically_increasing_id().alias("rid"), col(key).alias("key"), col(fetched).alias("fetched_at"),
        F.regexp_extract(F.lower(F.coalesce(col(url), F.lit(""))), HOST, 1).alias("host"),
        F.regexp_extract(F.coalesce(col(url), F.lit("")), PATH, 1).alias("path"),
    )
    labels, parts = F.split("host", r"\."), F.split("path", "/", -1)
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: entry("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    depth = F.least(F.size(parts) - 1, F.lit(deep))
    prefixes = F.when(depth < 1, F.array().cast("array<struct<kind:string,value:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: entry("prefix", F.concat("host", F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))
    )
    keys = F.concat(F.array(entry("host", F.col("host")), entry("prefix", F.col("host"))), domains, prefixes)
    tried = base.select("rid", "key", "fetched_at", "host", F.explode_outer(F.array_distinct(keys)).alias("k")).select("rid", "key", "fetched_at", "host", "k.kind", "k.value")
    met = tried.alias("t").join(held.alias("h"), (F.col("t.kind") == F.col("h.kind")) & (F.col("t.value") == F.col("h.value")) & (F.col("t.fetched_at") >= F.col("h.since")) & (F.col("h.until").isNull() | (F.col("t.fetched_at") < F.col("h.until"))), "left")
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("h.kind")]
    best = F.max(F.when(F.col("h.action").isNotNull(), F.struct(rank.alias("rank"), F.length("h.value").alias("size"), F.col("h.kind").alias("kind"), F.col("h.value").alias("value"), F.col("h.action").alias("action"), F.col("h.since").alias("since"))))
    out = met.groupBy("t.rid").agg(F.first("t.key").alias(key), F.first("t.host").alias("host"), F.first("t.fetched_at").alias("fetched_at"), best.alias("best"))
    return out.select(col(key), "host", "fetched_at", F.coalesce("best.action", F.lit("none")).alias("decision"), F.col("best.kind").alias("kind"), F.col("best.value").alias("value"), F.col("best.since").alias("since"))


#: An example list: kind, value, action, date.
ENTRIES = [
    ("domain", "cheap-pills.example.com", "block", "2024-01-01"),
    ("domain", "cheap-pills.example.com", "remove", "2024-07-01"),
    ("domain", "cheap-pills.example.com", "block", "2024-09-15"),
    ("domain", "example.net", "block", "2024-05-01"),
    ("domain", "example.net", "remove", "2024-06-01"),
    ("domain", "theres.example.com", "block", "2024-03-01"),
    ("host", "blog.theres.example.com", "allow", "2024-04-01"),
    ("host", "m.ththth.example.net", "block", "2024-02-10"),
    ("host", "m.ththth.example.net", "allow", "2024-05-15"),
    ("host", "www.ththhe.example.com", "block", "2024-08-01"),
    ("host", "thther.example.org", "block", "2024-01-15"),
    ("prefix", "thther.example.org/en", "allow", "2024-06-15"),
    ("prefix", "blog.tionsh.example.net/fr", "block", "2024-02-01"),
    ("prefix", "blog.tionsh.example.net/fr", "remove", "2024-11-01"),
    ("prefix", "therha.example.com/en/", "block", "2024-10-01"),
]


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page as of its fetch time: the tables give none, so page n counts as fetched on day n mod 366 of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")))
    names = ("kind", "value", "action", "dated")
    entries = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, e, strict=True)]) for e in ENTRIES]))).withColumn("dated", F.to_date("dated"))
    out = evaluate(pages, entries)
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd")).withColumn("since", F.date_format("since", "yyyy-MM-dd"))


_ROWS = ", ".join(f"('{a}', '{b.rstrip('/')}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)
OP10_SQL = rf"""
WITH e AS (SELECT * FROM (VALUES {_ROWS}) v(kind, value, action, since)),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM e),
p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT p.*, i.kind, i.value, i.action, i.since,
         row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 WHEN 'domain' THEN 1 ELSE 0 END DESC, length(value) DESC) AS rn
  FROM p LEFT JOIN i ON action <> 'remove' AND fetched >= since AND (until IS NULL OR fetched < until)
    AND CASE kind WHEN 'host' THEN host = value
                  WHEN 'domain' THEN host = value OR ends_with(host, '.' || value)
                  ELSE host || path = value OR starts_with(host || path, value || '/') END
)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched_at, coalesce(action, 'none') AS decision, kind, value, CAST(since AS VARCHAR) AS since
FROM m WHERE rn = 1
"""
