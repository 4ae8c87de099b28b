"""Queries over the driver's tables, in the order scans, filters, joins, aggregates, windows, top-k, sets, expressions.

Each is an operator of tessera.operators or a few DataFrame calls; what it must return is stated as SQL in relational_oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import relational as R
from ..operators import series as S
from .relational_oracle import SQL

c, lit = F.col, F.lit


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def over(function):
    """Register a function of the tables under its name."""
    run = lambda spark, sf_dir: function(Tables(spark, sf_dir))
    run.__name__, run.__doc__ = function.__name__, function.__doc__
    query(SQL[function.__name__])(run)
    return run


def double(x) -> Column:
    return (c(x) if isinstance(x, str) else x).cast("double")


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def month_of(name: str) -> Column:
    return (F.year(name) * 100 + F.month(name)).cast("long")


# -- scans


@over
def scan_parquet(t):
    return t.nation


@over
def scan_pruned(t):
    return t.lineitem.select("l_suppkey", "l_shipdate")


@over
def scan_isin(t):
    return t.events.where(c("user_id").isin(3, 5, 8, 13, 21, 34)).select("user_id", "event_type", "value")


@over
def semi_join_ids(t):
    return t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left_semi")


@over
def table_counts(t):
    """Counts need no column, so only the footers of the files are read."""
    return reduce(DataFrame.unionByName, [getattr(t, n).agg(F.count("*").alias("n")).select(lit(n).alias("name"), "n") for n in ("orders", "lineitem", "events", "documents")])


@over
def broadcast_lookup(t):
    own = t.customer.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey"), "left")
    return own.select("c_custkey", "c_mktsegment", F.coalesce("n_name", lit("unknown")).alias("nation"))


@over
def latest_k_per_key(t):
    return R.latest_per_key(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey", "o_orderdate")


# -- filters


@over
def etl_project(t):
    own = t.events.where(c("event_type").isin("purchase", "signup"))
    return own.select("event_id", "user_id", F.upper("event_type").alias("event_type"), F.coalesce("value", lit(0)).alias("amount"))


@over
def nonempty_text(t):
    return t.documents.where(F.length(F.coalesce("text", lit(""))) > 0).select("doc_id", "source")


@over
def bool_filter(t):
    return t.labels.where((c("quality") == 1) & (c("toxic") == 0)).select("doc_id")


@over
def greatest_cols(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest("l_quantity", c("l_discount") * 100, c("l_tax") * 100).alias("top"))


@over
def month_valid_rows(t):
    inside = (F.year("ts") == 2024) & (F.month("ts") == 1)
    return t.events.where(inside & (c("user_id") > 0) & (c("user_id") < 1000)).select("event_id", "user_id")


@over
def exclude_keys(t):
    return t.supplier.where(~c("s_nationkey").isin(1, 5, 9)).select("s_suppkey", "s_name")


@over
def length_between(t):
    return t.documents.where(c("text").isNotNull() & F.length("text").between(200, 2000) & (c("lang") == "en")).select("doc_id", "n_chars")


@over
def case_rank(t):
    rank = reduce(lambda w, x: w.when(c("o_orderpriority") == x[1], x[0]), enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM")), F).otherwise(3)
    return t.orders.select("o_orderkey", rank.alias("priority_rank"))


@over
def prefilter_terms(t):
    return t.documents.where(reduce(Column.__or__, [F.contains(F.lower("text"), lit(w)) for w in ("idiot", "scum", "clown")])).select("doc_id")


@over
def search_all_terms(t):
    """The first page of the documents that hold every term."""
    hay = F.lower(F.concat("text", lit(" "), "source"))
    return t.documents.where(F.contains(hay, lit("the")) & F.contains(hay, lit("src1")) & (c("lang") == "en")).select("doc_id", "source").orderBy("doc_id").limit(60)


@over
def blocklist_anti(t):
    return R.blocklist(t.customer, t.supplier.where("s_acctbal > 5000"), [("c_nationkey", "s_nationkey")]).select("c_custkey", "c_name")


@over
def pin_top(t):
    return R.pin_first(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey", [7, 3], [F.desc("s_acctbal"), "s_suppkey"]).select("s_suppkey", "place")


# -- joins


@over
def join_inner(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@over
def join_inner_sql(t):
    both = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return both.select("s_name", "n_name", "r_name")


@over
def join_left_dropna(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").dropna(subset=["quality"])


@over
def join_multi_left(t):
    return R.with_counts(t.customer.select("c_custkey"), [(t.orders, "o_custkey", "n_orders"), (t.events, "user_id", "n_events")], "c_custkey")


@over
def join_left(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")


@over
def join_semi(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@over
def exists_flag(t):
    users = t.events.select("user_id").distinct()
    return t.customer.join(users, c("c_custkey") == c("user_id"), "left").select("c_custkey", c("user_id").isNotNull().alias("has_events"))


@over
def join_anti(t):
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@over
def join_broadcast_default(t):
    few = F.broadcast(t.nation.where("n_regionkey < 3"))
    return t.supplier.join(few, c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", lit("none")).alias("nation"))


@over
def join_prefix(t):
    """Keys 'lang|source' are split into columns, so that the prefix join is an equi-join."""
    keys = t.documents.where("n_chars > 5000").select(F.concat_ws("|", "lang", "source").alias("k")).distinct()
    keys = keys.select(F.split_part("k", lit("|"), lit(1)).alias("lang"), F.split_part("k", lit("|"), lit(2)).alias("source"))
    return t.documents.join(keys, ["lang", "source"], "left_semi").groupBy("source", "lang").agg(F.count("*").alias("n"))


@over
def ci_overlap(t):
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))
    own = t.events.groupBy("event_type").agg((F.avg("value") - half).alias("lo"), (F.avg("value") + half).alias("hi"))
    a, b = own.alias("a"), own.alias("b")
    apart = (c("a.hi") < c("b.lo")) | (c("b.hi") < c("a.lo"))
    return a.join(b, c("a.event_type") < c("b.event_type")).select(c("a.event_type").alias("left_bucket"), c("b.event_type").alias("right_bucket"), (~apart).alias("overlaps"))


@over
def densify_calendar(t):
    n = t.lineitem.groupBy(c("l_suppkey").alias("s_suppkey"), month_of("l_shipdate").alias("ym")).agg(F.count("*").alias("n"))
    return R.densify(n, t.supplier.select("s_suppkey"), n.select("ym").distinct(), {"n": 0}).select("s_suppkey", "ym", "n")


# -- aggregates


@over
def agg_named(t):
    """The median of a few keys' many rows is found along sorted ranges; the rest is combined before it moves."""
    price, keys = "l_extendedprice", ["l_returnflag", "l_linestatus"]
    rest = t.lineitem.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg(price), 4).alias("mean_price"),
        F.round(F.stddev_samp("l_quantity"), 4).alias("std_qty"), F.min("l_tax").alias("min_tax"), F.max("l_discount").alias("max_discount"),
    )
    mid = R.quantiles(t.lineitem, keys, price, [0.5], ["median_price"]).withColumn("median_price", F.round("median_price", 4))
    return rest.join(mid, keys).select(*keys, "n", "sum_qty", "mean_price", "median_price", "std_qty", "min_tax", "max_discount")


@over
def agg_conditional(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), count_when((c("event_type") == "click") & (c("value") > 50)).alias("big_clicks"))


@over
def agg_filtered_min(t):
    return t.events.groupBy("user_id").agg(F.min(F.when(c("event_type") == "purchase", c("ts"))).alias("first_purchase"))


@over
def agg_bool_or(t):
    return t.documents.groupBy("source").agg(F.bool_or(c("n_chars") > 10000).alias("has_long"), F.max("n_chars").alias("longest"))


@over
def qa_stats(t):
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"),
        F.round(F.avg(double(c("value").isNull())), 6).alias("null_rate"),
    )


@over
def zone_month_counts(t):
    return S.monthly_counts(t.lineitem, "l_suppkey", "l_shipdate")


@over
def moments_merge(t):
    var = F.sum(c("value") * c("value")) / F.count("*") - F.avg("value") * F.avg("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(var, 3).alias("var"), F.round(F.sqrt(var / F.count("*")), 4).alias("stderr"))


@over
def histogram_desc(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@over
def pct_of_total(t):
    return R.share_of_total(t.documents, "lang")


@over
def rate_per_million(t):
    return R.share_of_total(t.events, "event_type", 1_000_000, 3, "per_million").drop("n")


@over
def rating_pivot(t):
    pct = [F.round(100 * F.avg(double(c("doc_id") % 5 == k)), 2).alias(f"pct_{k + 1}") for k in range(5)]
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), *pct)


@over
def monopoly_share(t):
    best = R.dominant(t.customer, "c_mktsegment", "c_nationkey").where("total >= 10")
    return best.select("c_mktsegment", "c_nationkey", "n", F.round(double("n") / c("total"), 6).alias("share"))


@over
def mode_with_support(t):
    return R.dominant(t.events, "user_id", "event_type").where("n >= 10").drop("total")


@over
def primary_by_weight(t):
    w = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("w"))
    return w.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-c("w"), "o_orderpriority")).alias("main_priority"))


@over
def cluster_rank_score(t):
    mean = R.rank_average(t.documents.groupBy("source").agg(F.avg("n_chars").alias("mean")), "mean")
    both = t.documents.select("doc_id", "source", "n_chars").join(F.broadcast(mean), "source")
    return both.select("doc_id", F.round(c("n_chars") / lit(1000.0) - lit(0.1) * F.floor("pos"), 6).alias("combined"))


@over
def rate_by_key(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(100 * F.avg(double(c("o_orderstatus") == "F")), 4).alias("pct_f"))


@over
def entity_stats(t):
    won = c("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("starts"), count_when(won).alias("wins"), F.round(100 * double(count_when(won)) / F.count("*"), 3).alias("win_pct"))


@over
def tail_prob(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg(F.when(c("value") >= 100, 1.0).otherwise(0.0)), 6).alias("p_tail"))


@over
def latest_per_key(t):
    return R.latest_per_key(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@over
def distinct_subset(t):
    """The first event of each user and type: an aggregate, so rows are combined before they move."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@over
def fold_small_groups(t):
    return R.fold_small(t.documents.select("doc_id", "source"), "source", 50).select("doc_id", "grp")


@over
def having_min_total(t):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.sum("l_quantity").alias("all")).where("all >= 700").drop("all")


@over
def run_report(t):
    failed = c("event_type") == "error"
    return t.events.agg(F.count("*").alias("tasks"), count_when(~failed).alias("succeeded"), count_when(failed).alias("failed"), F.round(F.sum("value"), 2).alias("total"))


@over
def geo_grouping_sets(t):
    return R.grouping_sets(t.documents, [["lang"], ["lang", "source"], []], F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@over
def cube_counts(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@over
def rollup_counts(t):
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@over
def bucket_median(t):
    n = t.documents.groupBy(c("source").alias("bucket")).agg(F.count("*").alias("n"))
    med = R.quantiles(t.documents.withColumnRenamed("source", "bucket"), "bucket", "n_chars", [0.5], ["med"])
    return n.join(med, "bucket").select("bucket", "n", F.round("med", 4).alias("med"))


# -- windows


@over
def rownum_first(t):
    status = F.when(c("o_orderstatus") == "F", 0).when(c("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.groupBy("o_custkey").agg(F.min(F.struct(status, "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey")


POINTS = {0: 10, 1: 5, 2: 2, 3: 1}


def points(place: Column) -> Column:
    return reduce(lambda w, x: w.when(place == x[0], x[1]), POINTS.items(), F).otherwise(0).cast("long")


@over
def winner_rank_points(t):
    """How many orders of its year cost more than the year's first order, and the points for that; no window over a year."""
    own = t.orders.select(F.year("o_orderdate").cast("long").alias("y"), "o_orderkey", "o_totalprice")
    first = own.groupBy("y").agg(F.min_by("o_totalprice", "o_orderkey").alias("price"))
    above = own.join(F.broadcast(first), "y").groupBy("y").agg(count_when(c("o_totalprice") > c("price")).alias("above"))
    return above.select("y", "above", points(c("above")).alias("points"))


@over
def topk_per_group(t):
    return R.topk_per_group(t.documents.select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3)


@over
def runner_up_fallback(t):
    return R.dominant(t.customer.where(~c("c_nationkey").isin(0, 1, 2, 3)), "c_mktsegment", "c_nationkey").drop("total")


@over
def cumulative_share(t):
    return R.cumulative_share(t.lineitem, "l_returnflag", "l_linenumber").select("l_returnflag", c("l_linenumber").cast("long").alias("pos"), "cum_pct")


@over
def minmax_norm(t):
    return R.min_max(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", "norm")


@over
def softmax(t):
    return R.softmax(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 5000).select("s_suppkey", "p")


@over
def lag_lead(t):
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("value").over(by).alias("before_value"), F.lead("event_type").over(by).alias("next_type"))


@over
def ntile_range(t):
    own = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.ntile(own, "o_orderstatus", ["o_totalprice", "o_orderkey"], 4, "quarter").select("o_orderkey", "quarter")


# -- top-k


@over
def topk_global(t):
    return R.topk_global(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@over
def topk_axes_union(t):
    key = ["l_orderkey", "l_linenumber"]
    return R.topk_union(t.lineitem, key, [[F.desc(a), *key] for a in ("l_extendedprice", "l_quantity", "l_discount")], 40)


@over
def best_per_key_topk(t):
    own = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.desc("l_extendedprice")
    return R.best_per_key_topk(own, "l_orderkey", [price, "l_linenumber"], [price, "l_orderkey"], 50, "cand_id", 1000).drop("l_extendedprice")


@over
def sort_mixed(t):
    return t.part.select("p_partkey", "p_size", "p_retailprice").orderBy("p_size", F.desc("p_retailprice"), "p_partkey")


@over
def head_rows(t):
    return R.head_per_file(t.nation, 5).select("n_nationkey", "n_name")


@over
def topk_plus_forced(t):
    return R.topk_or_forced(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2, c("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey")


@over
def samples_per_key(t):
    return R.topk_per_group(t.documents.select("source", "doc_id"), "source", ["doc_id"], 8)


@over
def hash_sample(t):
    return R.hash_sample(t.documents.select("doc_id", "source"), "doc_id", 100)


# -- sets


@over
def union_all(t):
    return t.customer.select(c("c_nationkey").alias("nation"), lit("customer").alias("kind")).unionByName(t.supplier.select(c("s_nationkey").alias("nation"), lit("supplier").alias("kind")))


@over
def union_sentinel_dedupe(t):
    key = lambda name: F.concat(lit("k"), c(name).cast("string")).alias("url_key")
    both = t.orders.select(key("o_custkey"), c("o_orderkey").alias("idx")).unionByName(t.customer.select(key("c_custkey")), allowMissingColumns=True)
    return both.groupBy("url_key").agg(F.min(F.coalesce("idx", lit(-1))).alias("idx"))


@over
def merge_keep_best(t):
    own = lambda df, k, name, x: df.groupBy(c(k).alias("k")).agg(F.max(x).alias("norm")).withColumn("origin", lit(name))
    return R.merge_keep_best([own(t.customer, "c_nationkey", "c", "c_acctbal"), own(t.supplier, "s_nationkey", "s", "s_acctbal")], "k", "norm")


@over
def except_terms(t):
    return t.nation.select("n_nationkey").subtract(t.supplier.where("s_acctbal > 9000").select("s_nationkey"))


@over
def intersect_terms(t):
    return t.customer.where("c_acctbal > 9000").select("c_nationkey").intersect(t.supplier.select("s_nationkey"))


@over
def priority_source_merge(t):
    live = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return R.priority_merge([live, t.customer.select(c("c_custkey").alias("k"), c("c_acctbal").alias("v"))], "k")


@over
def insert_ignore(t):
    from ..sources.io import insert_ignore as ignore

    old = t.orders.where("o_custkey % 3 = 0").select(c("o_custkey").alias("id")).distinct().withColumn("origin", lit("old"))
    return ignore(old, t.customer.select(c("c_custkey").alias("id"), lit("new").alias("origin")), "id")


# -- domain expressions


@over
def century(t):
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", (F.floor(y / lit(100.0)) + F.when(y > 0, 1).otherwise(0)).cast("long").alias("century"))


@over
def safe_ratio(t):
    ratio = c("o_totalprice") / F.nullif(c("o_custkey") % 7, lit(0).cast("long"))
    return t.orders.select("o_orderkey", F.round(F.least(F.greatest(ratio, lit(0.0)), lit(50000.0)), 4).alias("ratio"))


@over
def fixed_bucket(t):
    n = c("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(n <= 0, "0").when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+").alias("bucket"))


@over
def enrich_rowwise(t):
    size = F.when(F.length("html") > 4000, "large").when(F.length("html") > 1500, "medium").otherwise("small")
    return t.pages.select("page_id", F.contains("url", lit("ref=")).alias("has_ref"), F.length("url").alias("url_len"), size.alias("size_class"))


@over
def exclaim_count(t):
    return t.documents.select("doc_id", (F.length("text") - F.length(F.replace("text", lit("!"), lit("")))).cast("long").alias("exclaims"))


@over
def shorten(t):
    from ..functions import text as T

    return t.documents.select("doc_id", T.ellipsis(c("text"), 80).alias("short"), ((c("text") == "") | (F.length("text") < 140)).alias("placeholder"))


@over
def kelly(t):
    from ..functions import text as T

    odds = 1 + c("o_custkey") % 9
    return t.orders.select("o_orderkey", F.round(T.kelly(lit(0.3), odds), 6).alias("kelly"))


@over
def piecewise_score(t):
    place = c("s_suppkey") % 15
    return t.supplier.select("s_suppkey", F.greatest(lit(75), 105 - 3 * place).alias("beyer"), F.least(lit(6.0), 2 + 0.3 * place).alias("pace"))


@over
def vocab_map(t):
    has = lambda w: F.contains(F.lower("p_type"), lit(w))
    return t.part.select("p_partkey", F.when(has("steel"), "steel").when(has("brass"), "brass").when(has("tin"), "tin").otherwise("other").alias("metal"))


@over
def log_loss(t):
    from ..operators import stats as X

    p = c("o_custkey") % 100 / lit(100.0)
    return t.orders.groupBy("o_orderpriority").agg(F.round(X.log_loss(c("o_orderstatus") == "F", p), 6).alias("log_loss"))


@over
def occupancy(t):
    day = t.events.groupBy("user_id", c("ts").cast("date").alias("day")).agg(F.max(double(c("event_type") == "purchase")).alias("booked"), F.max("value").alias("price"))
    return day.groupBy("user_id").agg(F.count("*").alias("n_days"), F.round(F.avg("booked"), 6).alias("occupancy"), F.round(F.stddev_samp("price") / F.avg("price"), 5).alias("volatility"))


@over
def section_topk(t):
    order = [F.desc("o_totalprice"), "o_orderkey"]
    best = R.topk_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", order, 1)
    both = t.customer.select("c_custkey", "c_mktsegment").join(best, c("c_custkey") == c("o_custkey"))
    return R.topk_per_group(both, "c_mktsegment", order, 40).select("c_mktsegment", "c_custkey", "o_orderkey", "o_totalprice")


@over
def map_points(t):
    rich = t.customer.where("c_acctbal > 9500")
    big = t.customer.join(t.orders.where("o_totalprice > 400000"), c("c_custkey") == c("o_custkey"), "left_semi")
    return rich.unionByName(big).select("c_custkey", "c_nationkey").where("c_nationkey is not null").distinct()


@over
def top_member_share(t):
    both = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return R.dominant(both, "r_name", "n_name").select("r_name", "n_name", F.round(double("n") / c("total"), 6).alias("share"))


@over
def per_capita(t):
    both = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.max("n_nationkey").alias("k"))
    return both.where("n >= 3").select("n_name", F.round(double("n") * 1000000 / (1000 + 37 * c("k")), 1).alias("per_million"))


@over
def dominant_attr_per_group(t):
    return R.dominant(t.documents, "source", "lang").select("source", "lang", F.round(100 * double("n") / c("total"), 2).alias("pct"))


@over
def longest_docs(t):
    return R.topk_global(t.documents.select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 30)


@over
def topic_extinct(t):
    y = t.orders.groupBy(c("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    peak = F.min_by(F.struct("y", "n"), F.struct(-c("n"), c("y")))
    own = y.groupBy("k").agg(peak.alias("p"), F.sum(F.when(c("y") > 1996, c("n")).otherwise(0)).alias("recent"))
    return own.where("p.n >= 10").select("k", c("p.y").cast("long").alias("peak_year"), c("p.n").alias("peak"), F.round(double("recent") / (c("p.n") * 5), 6).alias("decline"))


@over
def topic_emergent(t):
    own = t.orders.groupBy(c("o_orderpriority").alias("k")).agg(
        F.count("*").alias("n"), count_when(c("o_orderdate") >= lit("1999-08-01").cast("timestamp")).alias("late"), F.count_distinct(F.year("o_orderdate")).alias("years"),
    )
    return own.where("n >= 50 and years >= 3").select("k", "n", F.round(double("late") / c("n"), 6).alias("burst"))


@over
def backtest_points(t):
    """Points of three weightings: what the first to fourth order of each year, by the weighted score, are worth."""
    weights = F.explode(F.array(*[F.struct(lit(i).cast("long").alias("wid"), lit(a).alias("a"), lit(b).alias("b")) for i, (a, b) in enumerate(((0.6, 0.4), (0.2, 0.8), (0.5, 0.5)), 1)]))
    own = t.orders.select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice", "o_custkey", weights.alias("w"))
    score = c("w.a") * (c("o_totalprice") / 1000) + c("w.b") * (c("o_custkey") % 100)
    best = R.topk_per_group(own.select(c("w.wid").alias("wid"), "y", "o_orderkey", score.alias("score")), ["wid", "y"], [F.desc("score"), "o_orderkey"], 4, "pos")
    return best.groupBy("wid").agg(F.sum(points(c("pos") - 1)).alias("points"))


@over
def baseline_points(t):
    n = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.sum(lit(18.0) / c("n")), 6).alias("expected"))


@over
def tumbling_hour(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@over
def session_gap(t):
    return R.sessions(t.events, "user_id", "ts", "event_id", "30 minutes")


missing = set(SQL) - set(globals())
if missing:
    raise NotImplementedError(f"no query for {sorted(missing)}")
