"""Reports over counts and summaries: owners of phrases, trends of clusters, calendar demand, blended chances, findings, sections.

Each takes tables of any name with the columns it says, and gives the rows of the report; thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import relational as R


def _shares(counts: DataFrame, key: str, by: str, n: str = "n") -> DataFrame:
    """counts(key, by, n) with total (of the key), share, and place by falling n, then by name."""
    whole = W.partitionBy(key)
    out = counts.withColumn("total", F.sum(n).over(whole)).withColumn("share", F.col(n) / F.col("total"))
    return out.withColumn("place", F.row_number().over(whole.orderBy(F.desc(n), by)))


def monopolies(counts: DataFrame, phrase: str, owner: str, n: str = "n", least_total: int = 1500, least_share: float = 0.85, letters: tuple[int, int] = (4, 30)) -> DataFrame:
    """Phrases of such a length and total whose first owner has at least such a share: phrase, owner, n, total, share."""
    found = _shares(counts.where(F.length(phrase).between(*letters)), phrase, owner, n)
    return found.where((F.col("place") == 1) & (F.col("total") >= least_total) & (F.col("share") >= least_share)).drop("place")


def concept_owners(counts: DataFrame, phrase: str, owner: str, big: Sequence[str], n: str = "n", least_total: int = 2500, shares: tuple[float, float] = (0.35, 0.84), least_second: float = 0.15, letters: tuple[int, int] = (4, 24)) -> DataFrame:
    """Phrases whose first owner has a share within bounds. Where that is a big one, the first other owner stands if its
    share is large enough, else the phrase is left out."""
    found = _shares(counts.where(F.length(phrase).between(*letters)), phrase, owner, n).where(F.col("total") >= least_total)
    first = found.where((F.col("place") == 1) & F.col("share").between(*shares))
    small = first.where(~F.col(owner).isin(*big))
    rest = found.where(~F.col(owner).isin(*big)).join(first.where(F.col(owner).isin(*big)).select(phrase), phrase, "left_semi")
    second = R.topk_per_group(rest, phrase, ["place"], 1).where(F.col("share") >= least_second)
    return small.unionByName(second).drop("place")


def monocultures(counts: DataFrame, city: str, phrase: str, n: str = "n", least_total: int = 1500, least_global: int = 200, least_share: float = 0.1, places: DataFrame | None = None, k: int = 80) -> DataFrame:
    """The k cities of enough rows whose commonest phrase, being no place's name and common enough everywhere, has the largest share."""
    total = counts.groupBy(city).agg(F.sum(n).alias("total"))
    own = counts.join(places.select(F.col("name").alias(phrase)), phrase, "left_anti") if places is not None else counts
    everywhere = own.groupBy(phrase).agg(F.sum(n).alias("__all")).where(F.col("__all") >= least_global).drop("__all")
    best = R.topk_per_group(own.join(everywhere, phrase, "left_semi"), city, [F.desc(n), phrase], 1)
    out = best.join(total.where(F.col("total") >= least_total), city).withColumn("share", F.col(n) / F.col("total")).where(F.col("share") >= least_share)
    return out.orderBy(F.desc("share"), city).limit(k)


def theme_shares(counts: DataFrame, owner: str, phrase: str, vocabulary: Sequence[str], n: str = "n", least: float = 0.02) -> DataFrame:
    """owner, share of its rows whose phrase is in a vocabulary or has a word that is, where at least `least`."""
    inside = F.col(phrase).isin(*vocabulary) | F.exists(F.split(phrase, " "), lambda w: w.isin(*vocabulary))
    share = F.sum(F.when(inside, F.col(n)).otherwise(0)) / F.sum(n)
    return counts.groupBy(owner).agg(share.alias("share")).where(F.col("share") >= least)


def capital_dominance(counts: DataFrame, country: str, city: str, n: str = "n", least: int = 3000) -> DataFrame:
    """country, city, share: of countries with enough rows, the first city's part of them."""
    found = _shares(counts, country, city, n)
    return found.where((F.col("place") == 1) & (F.col("total") >= least)).select(country, city, "share")


def trends(rows: DataFrame, cluster: str, date: str, as_of: str, least: int = 50, years: int = 3, least_peak: int = 10, peak_age: int = 5, least_recent: int = 30) -> DataFrame:
    """cluster, n, peak_year, peak, recent5, decline, recent24, burst of clusters with enough rows and years, at a given day.

    decline: rows of the last five years against five peak years, null unless the peak (the first year of the most rows) is
    old and large enough; burst: the share of rows of the last 24 months, null below least_recent rows.
    """
    now = F.to_date(F.lit(as_of))
    months = (F.year(date) * 12 + F.month(date)) >= (F.year(now) * 12 + F.month(now) - 24)
    year = rows.groupBy(cluster, F.year(date).alias("y")).agg(F.count("*").alias("n"), F.count_if(months).alias("late"))
    own = year.groupBy(cluster).agg(
        F.sum("n").alias("n"), F.count("*").alias("years"), F.min_by(F.struct("y", "n"), F.struct(-F.col("n"), F.col("y"))).alias("p"),
        F.sum(F.when(F.col("y") >= F.year(now) - 4, F.col("n")).otherwise(0)).alias("recent5"), F.sum("late").alias("recent24"),
    )
    own = own.where((F.col("n") >= least) & (F.col("years") >= years))
    old = (F.year(now) - F.col("p.y") >= peak_age) & (F.col("p.n") >= least_peak)
    decline = F.when(old, F.round(F.col("recent5") / (F.col("p.n") * 5), 3))
    burst = F.when(F.col("recent24") >= least_recent, F.round(F.col("recent24") / F.col("n"), 3))
    return own.select(cluster, "n", F.col("p.y").cast("long").alias("peak_year"), F.col("p.n").alias("peak"), "recent5", decline.alias("decline"), "recent24", burst.alias("burst"))


def calendar_summary(days: DataFrame, key: Sequence[str], date: str, free: str, price: str) -> DataFrame:
    """key, days, free days, weekend days, free weekend days, mean, median and standard deviation of the price; Friday and
    Saturday are the weekend."""
    weekend = F.weekday(date).isin(4, 5)
    rest = days.groupBy(*key).agg(
        F.count("*").alias("n_days"), F.count_if(free).alias("n_free"), F.count_if(weekend).alias("n_weekend"), F.count_if(weekend & F.col(free)).alias("n_weekend_free"),
        F.avg(price).alias("mean_price"), F.stddev_samp(price).alias("std_price"),
    )
    return rest.join(R.quantiles(days, list(key), price, [0.5], ["median_price"]), list(key), "left")


def with_demand(summary: DataFrame) -> DataFrame:
    """calendar_summary() with occupancy, weekend occupancy, their ratio and volatility; nothing divided by 0 is null."""
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = summary.withColumns({"occupancy": 1 - ratio("n_free", "n_days"), "occupancy_weekend": 1 - ratio("n_weekend_free", "n_weekend"), "volatility": ratio("std_price", "mean_price")})
    return out.withColumn("weekend_premium", F.try_divide("occupancy_weekend", "occupancy"))


def demand(listings: DataFrame, demand: DataFrame, key: str, snapshot: str, proxy: str) -> tuple[DataFrame, DataFrame]:
    """The listings with their latest demand, the old proxy filling in where there is none; and every snapshot's demand."""
    trajectory = demand.select(key, snapshot, "occupancy", "occupancy_weekend", "mean_price", "median_price", "volatility")
    latest = R.latest_per_key(demand, key, [snapshot]).select(key, "occupancy", "occupancy_weekend", "weekend_premium", "mean_price", "median_price", "std_price", "volatility")
    return listings.join(latest, key, "left").withColumn(proxy, F.coalesce("occupancy", proxy)), trajectory


def blended(field: DataFrame, factors: Mapping[str, float], model: str, adjustment: str, odds: str, temperature: float = 15.0) -> DataFrame:
    """A field's rows with score, chance, implied, value and stake: 0.7 x the weighted factors (0 to 10 each) x 10 + 0.3 x the
    model's chance x 100 (an equal share where null) + 3 x an adjustment; a softmax over the field; + or - where the chance
    is over 1.15 or under 0.85 of what the odds imply; the Kelly stake."""
    n = field.agg(F.count("*").alias("__n"))
    weighted = sum((weight * F.col(name) * 10 for name, weight in factors.items()), F.lit(0.0))
    own = field.crossJoin(F.broadcast(n)).withColumn("score", 0.7 * weighted + 0.3 * 100 * F.coalesce(F.col(model), 1 / F.col("__n")) + 3 * F.coalesce(F.col(adjustment), F.lit(0.0))).drop("__n")
    own = R.softmax(own, "score", temperature, 9, "chance").withColumn("implied", 1 / (F.col(odds) + 1))
    flag = F.when(F.col("chance") > 1.15 * F.col("implied"), "+").when(F.col("chance") < 0.85 * F.col("implied"), "-").otherwise("=")
    return own.withColumn("value", flag).withColumn("stake", F.round(T.kelly(F.col("chance"), F.col(odds)), 3))


def landscape(summaries: DataFrame, category: str) -> DataFrame:
    return R.share_of_total(summaries, category, 100, 1)


def top_values(summaries: DataFrame, category: str, value: str, k: int, unknown: str) -> DataFrame:
    """category, value, n, pct: the k commonest values of each category, nulls under a name."""
    n = summaries.groupBy(category, F.coalesce(value, F.lit(unknown)).alias(value)).agg(F.count("*").alias("n"))
    found = _shares(n, category, value).where(F.col("place") <= k)
    return found.select(category, value, "n", F.round(100 * F.col("share"), 1).alias("pct"))


def best_distinct(summaries: DataFrame, key: str, score: Column, k: int, ascending: bool = False) -> DataFrame:
    """The k best rows by a score, one a key; ties by key. With the score of badges * 3 + code blocks: the most curated; of the
    length: the longest; of placeholders by rising length: the forgotten ones."""
    own = summaries.withColumn("score", score)
    order = [F.asc("score") if ascending else F.desc("score"), key]
    return R.topk_per_group(own, key, [order[0]], 1).orderBy(*order).limit(k)


def is_placeholder(summary: Column, length: Column, least: int = 140, words: str = r"(?i)\b(?:todo|wip|coming soon|placeholder|work in progress)\b") -> Column:
    return (F.coalesce(summary, F.lit("")) == "") | (length < least) | summary.rlike(words)


def section(scored: DataFrame, listing: str, image: str, score: str, k: int, about: DataFrame | None = None) -> DataFrame:
    """The k best images, at most one a listing and one an image file; rows of listings that `about` lacks go."""
    best = R.topk_per_group(scored, listing, [F.desc(score), image], 1)
    best = best.join(about, listing) if about is not None else best
    return R.topk_per_group(best, image, [F.desc(score), listing], 1).orderBy(F.desc(score), listing).limit(k)


def map_points(sections: Sequence[DataFrame], key: str, place: Sequence[str]) -> DataFrame:
    """Distinct listings of all sections that have a place."""
    points = sections[0].select(key, *place)
    for other in sections[1:]:
        points = points.unionByName(other.select(key, *place))
    return points.dropna(subset=list(place)).distinct()


def name_rollup(people: DataFrame, name: str, value: str) -> DataFrame:
    """last_name, total: values of all people with one last name."""
    return people.groupBy(T.last_name(F.col(name)).alias("last_name")).agg(F.sum(value).alias("total"))


def score_histogram(scores: DataFrame, score: str, width: float = 1.0) -> DataFrame:
    """low, n: how many scores lie in each interval of a width."""
    return scores.groupBy((F.floor(F.col(score) / width) * width).alias("low")).agg(F.count("*").alias("n")).orderBy("low")


def vocabulary(frames: Sequence[DataFrame], word: str) -> DataFrame:
    """The words of all tables, once each."""
    out = frames[0].select(word)
    for other in frames[1:]:
        out = out.unionByName(other.select(word))
    return out.distinct()
