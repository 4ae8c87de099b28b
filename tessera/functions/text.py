"""Text functions as Column expressions; all stay in the JVM but casefold_norm."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"^[+-]?[0-9]*\.?[0-9]+$"


def parse_price(text: Column) -> Column:
    """'$1,250.00' to 1250.0; null for null, empty, 'null', 'None', 'nan' and anything that isn't a number after stripping."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[$€£¥]+", ""), r"[, ]", "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def parse_odds(text: Column) -> Column:
    """'5-1', '5/1', '5:1' or '5–1' to 5.0; a bare number to itself; null otherwise or with a zero divisor."""
    clean = F.regexp_replace(F.trim(text), r"[*m]", "")
    top = F.regexp_extract(clean, r"^([0-9]+\.?[0-9]*)[-/:–—]([0-9]+\.?[0-9]*)$", 1)
    low = F.regexp_extract(clean, r"^([0-9]+\.?[0-9]*)[-/:–—]([0-9]+\.?[0-9]*)$", 2)
    ratio = F.try_divide(F.nullif(top, F.lit("")).try_cast("double"), F.nullif(low, F.lit("")).try_cast("double"))
    return F.when(top != "", ratio).when(clean.rlike(NUMBER), clean.try_cast("double"))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def humanize(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), " ")


def norm_label(text: Column, most: int = 60) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(most))


def fingerprint(text: Column, most: int = 150) -> Column:
    return F.left(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(most))


def query_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"{name}=([^&#]+)", 1), F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def caps_ratio(text: Column) -> Column:
    """Share of the words of four ASCII letters or more that are all upper case; 0 without such words."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0))
    upper = F.filter(words, lambda w: w.rlike("^[A-Z]+$"))
    return F.coalesce(F.try_divide(F.size(upper).cast("double"), F.size(words)), F.lit(0.0))


def tokens(text: Column, stop: tuple[str, ...] = (), least: int = 3, most: int = 24) -> Column:
    """Lower-case letter runs without stop words, within a length and with a vowel."""
    vowel = lambda w: reduce(Column.__or__, [F.contains(w, F.lit(v)) for v in "eaiou"])  # noqa: E731  a pattern would be matched anew for each word
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.length(w) >= least) & (F.length(w) <= most) & vowel(w))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def first_sentence(text: Column, most: int = 140) -> Column:
    return F.left(F.get(F.split(text, r"(?<=[.!?])\s+", 2), F.lit(0)), F.lit(most))


def json_array(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def strip_annotations(text: Column) -> Column:
    """Without footnotes [a], -DQ and (ABC) suffixes."""
    out = F.regexp_replace(text, r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"-DQ$", ""), r"\([A-Z]{2,3}\)$", ""))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def person_key(name: Column) -> Column:
    """Last name and first initial, lower-cased: suffixes (Jr, Sr, II, III, IV) go, 'Last, First' is flipped."""
    bare = F.trim(F.regexp_replace(name, r"(?i)[ ,]+(jr|sr|ii|iii|iv)\.?$", ""))
    comma = F.instr(bare, ",") > 0
    first = F.when(comma, F.trim(F.substring_index(bare, ",", -1))).otherwise(bare)
    last = F.when(comma, F.trim(F.substring_index(bare, ",", 1))).otherwise(F.substring_index(bare, " ", -1))
    return F.lower(F.concat(last, F.lit("|"), F.left(first, F.lit(1))))


def haversine(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Kilometres along a great circle."""
    square = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2))
    return 12742 * F.asin(F.sqrt(F.least(F.lit(1.0), square(to_lat - lat) + F.cos(F.radians(to_lat)) * F.cos(F.radians(lat)) * square(to_lon - lon))))


def rfc_date(text: Column) -> Column:
    """The date of 'Wed, 4 Jan 1995 00:00:00 GMT', the weekday being optional; null for anything else."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^(?:[A-Za-z]{3}, )?([0-9]{1,2} [A-Za-z]{3} [0-9]{4})\b", 1), F.lit("")), "d MMM yyyy")


def short_number(value: Column) -> Column:
    """1234567 to 1.23M and 1234 to 1.23K, halves up; below 1000 as it is."""
    part = lambda unit: (value + unit // 200).cast("long")
    two = lambda unit: F.concat(F.floor(part(unit) / unit).cast("string"), F.lit("."), F.lpad((F.floor(part(unit) / (unit // 100)) % 100).cast("string"), 2, "0"))
    return F.when(value >= 999_995, F.concat(two(1_000_000), F.lit("M"))).when(value >= 1000, F.concat(two(1000), F.lit("K"))).otherwise(value.cast("string"))


def kelly(win: Column, odds: Column, most: float = 0.25) -> Column:
    """The Kelly stake (win * odds - loss) / odds between 0 and `most`; 0 for odds of 0 or less."""
    return F.when(odds <= 0, F.lit(0.0)).otherwise(F.least(F.greatest((win * odds - (1 - win)) / odds, F.lit(0.0)), F.lit(most)))


VOWEL = "[aeiou]"


def whole_number(text: Column) -> Column:
    """'*12' or 'm7' to a whole number; null for anything else."""
    return F.regexp_replace(F.trim(text), r"^\**m*", "").try_cast("long")


def decimal_number(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"^\**m*", "")
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def good_token(word: Column, stop: tuple[str, ...] = ()) -> Column:
    """Is a lower-case word of three characters or more, with a vowel (so no number and no hex id without one), no stop word?"""
    good = (F.length(word) >= 3) & ~word.rlike("^[0-9]+$") & word.rlike(VOWEL)
    return good & ~word.isin(*stop) if stop else good


def tag_phrases(tags: Column, stop: tuple[str, ...] = (), most: int = 48) -> Column:
    """The phrases of 'new+york, 2009,a1b2': plus signs are spaces; numbers, hex ids and bad words go; cut at `most`."""
    raw = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda p: F.lower(F.trim(F.replace(F.trim(p), F.lit("+"), F.lit(" ")))))
    raw = F.filter(raw, lambda p: (F.length(p) >= 3) & ~p.rlike(r"^[0-9\s]+$") & ~p.rlike(r"^(?:[a-f0-9]{2,}\s*)+$"))
    clean = F.transform(raw, lambda p: F.array_join(F.filter(F.split(p, r"\s+"), lambda w: good_token(w, stop)), " "))
    clean = F.filter(clean, lambda p: (p != "") & ~p.isin(*stop)) if stop else F.filter(clean, lambda p: p != "")
    return F.transform(clean, lambda p: F.rtrim(F.left(p, F.lit(most))))


def clean_phrase(phrase: Column, stop: tuple[str, ...] = ()) -> Column:
    """A phrase without stop words; empty if it holds an URL-encoded byte or a hex word of eight characters or more."""
    words = F.filter(F.split(F.coalesce(phrase, F.lit("")), r"\s+"), lambda w: (w != "") & (~w.isin(*stop) if stop else F.lit(True)))
    bad = phrase.rlike("%[0-9A-Fa-f]{2}") | F.exists(words, lambda w: w.rlike("^[a-f0-9]{8,}$"))
    return F.when(bad, "").otherwise(F.array_join(words, " "))


def rough_url_decode(text: Column) -> Column:
    """%20 and plus signs to spaces, %27 to an apostrophe; nothing else."""
    for code, plain in (("%20", " "), ("+", " "), ("%27", "'")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


HEADING = r"(?m)^\s*#\s+(.+?)\s*$"
LINK = r"\[([^\]]+)\]\([^)]+\)"


def markdown_title(text: Column, name: Column) -> Column:
    """The first heading without leading signs, links and tags if 3 to 159 characters are left, else the last part of a path."""
    title = F.regexp_replace(F.regexp_extract(text, HEADING, 1), "^[^A-Za-z0-9]+", "")
    title = strip_tags_of(F.regexp_replace(title, LINK, "$1"))
    return F.when(F.length(title).between(3, 159), title).otherwise(F.substring_index(name, "/", -1))


def strip_tags_of(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def first_prose(text: Column, least: int = 12, most: int = 280) -> Column:
    """The first paragraph after the first heading that is no code, heading, badge or list of links, without markup."""
    tail = F.when(text.rlike(HEADING), F.regexp_replace(text, r"(?s)\A.*?(?m:^\s*#\s+.+?\s*$)", "")).otherwise(text)
    parts = F.transform(F.split(F.coalesce(tail, F.lit("")), r"\n\s*\n"), F.trim)
    prose = F.filter(parts, lambda p: (p != "") & ~p.startswith("```") & ~p.startswith("#") & ~p.rlike(r"(?s)^\s*!\[.*?\]\(.*?\)\s*$") & ~p.rlike(r"^\s*[*\-]\s*\["))

    def plain(p: Column) -> Column:
        p = strip_tags_of(F.regexp_replace(p, "!?" + LINK, "$1"))
        return F.trim(F.regexp_replace(F.regexp_replace(p, "[`*_~]", ""), r"\s+", " "))

    found = F.get(F.filter(F.transform(prose, plain), lambda p: F.length(p) >= least), F.lit(0))
    return F.left(F.coalesce(found, F.lit("")), F.lit(most))


def top_terms(text: Column, stop: tuple[str, ...] = (), k: int = 40) -> Column:
    """map<word,count> of the k commonest words of 3 to 24 letters outside code, tags and link targets; ties by word.

    Counted inside the row, along the sorted words."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " "), "`[^`]+`", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), LINK, "$1")
    words = F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z][a-z0-9'\\-]*"), F.lit(0)), lambda w: F.length(w).between(3, 24) & (~w.isin(*stop) if stop else F.lit(True)))
    none = F.struct(F.array().cast("array<struct<n:int,w:string>>").alias("done"), F.lit("").alias("w"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        more = F.when(acc["n"] > 0, F.array_append(acc["done"], F.struct((-acc["n"]).alias("n"), acc["w"].alias("w")))).otherwise(acc["done"])
        same = acc["w"] == w
        return F.struct(F.when(same, acc["done"]).otherwise(more).alias("done"), w.alias("w"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"))

    end = F.array_append(words, F.lit("\uffff"))  # closes the last run
    runs = F.aggregate(F.sort_array(end), none, step, lambda acc: acc["done"])
    best = F.slice(F.sort_array(runs), 1, k)
    return F.map_from_entries(F.transform(best, lambda r: F.struct(r["w"], -r["n"])))


def century(year: Column) -> Column:
    """Of a year from -3000 to 2100 but 0: floor(year / 100), and 1 more after the year 0; else null."""
    return F.when((year != 0) & year.between(-3000, 2100), F.floor(year / F.lit(100.0)).cast("long") + F.when(year > 0, 1).otherwise(0))


def created_date(first: Column, update: Column) -> Column:
    """The date of a first version in RFC 2822 form, else that of an update such as 2019-03-30T..., else null."""
    return F.coalesce(rfc_date(first), F.try_to_date(F.left(update, F.lit(10)), "yyyy-MM-dd"))


def valid_month(date: Column) -> Column:
    """year * 100 + month between 1990 and 2100, else null."""
    return F.when(F.year(date).between(1990, 2100), F.year(date) * 100 + F.month(date))


def human_number(value: Column) -> Column:
    """1.23B, 1.23M, 1.2K and 999, of the value rounded to a whole number."""
    n = F.round(value).cast("long")
    part = lambda unit, digits: F.format_string(f"%.{digits}f", n / F.lit(float(unit)))
    out = F.when(n >= 1_000_000_000, F.concat(part(1_000_000_000, 2), F.lit("B"))).when(n >= 1_000_000, F.concat(part(1_000_000, 2), F.lit("M")))
    return out.when(n >= 1000, F.concat(part(1000, 1), F.lit("K"))).otherwise(n.cast("string"))


def human_time(seconds: Column) -> Column:
    """45 seconds, ~3 minutes, ~1.5 hours."""
    part = lambda unit, digits: F.format_string(f"~%.{digits}f", seconds / F.lit(float(unit)))
    return F.when(seconds < 60, F.format_string("%.0f seconds", seconds.cast("double"))).when(seconds < 3600, F.concat(part(60, 0), F.lit(" minutes"))).otherwise(F.concat(part(3600, 1), F.lit(" hours")))


def month_label(ym: Column) -> Column:
    """202403 to 2024-03."""
    return F.format_string("%04d-%02d", F.floor(ym / 100).cast("int"), (ym % 100).cast("int"))


def one_of(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    """value in lower case if it is one of these, else a default."""
    return F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(F.lit(default))


def track_condition(raw: Column) -> Column:
    """sloppy, muddy, good or wet-fast, whichever is named first in this order; fast otherwise and for null."""
    has = lambda w: F.contains(F.lower(F.coalesce(raw, F.lit(""))), F.lit(w))
    return F.when(has("sloppy"), "sloppy").when(has("muddy"), "muddy").when(has("good"), "good").when(has("wet"), "wet-fast").otherwise("fast")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def style_score(last: Column) -> Column:
    """Of the last three furlongs' seconds: 7 below 36, 8 below 37, 8.5 below 38, else 4; 6.5 without a time."""
    return F.when(last.isNull(), 6.5).when(last < 36, 7.0).when(last < 37, 8.0).when(last < 38, 8.5).otherwise(4.0)


def pace_fit(last: Column) -> Column:
    """10 at 35.5 seconds and 2 less for each further one, within 0 and 10; 6 without a time."""
    return F.when(last.isNull(), 6.0).otherwise(clip(10 - (last - 35.5) * 2, 0, 10))


def dosage_score(dosage: Column) -> Column:
    """10 at a dosage of 1, falling to 0 at 7; 2.5 stands for a missing one."""
    return clip(10 - (F.coalesce(dosage, F.lit(2.5)) - 1) * (10 / 6), 0, 10)


def finish_place(text: Column) -> Column:
    """struct<place,status> of '1[a]', '17-DQ' or 'Scratched': a number, or a known status in lower case; nulls otherwise."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[\s*[A-Za-z0-9]+\s*\]\s*", ""), r"(?i)\s*-\s*DQ\s*$", ""))
    return F.struct(bare.try_cast("int").alias("place"), F.when(F.lower(bare).isin("scratched", "ae", "n/a", "dnf"), F.lower(bare)).alias("status"))


def page_title(html: Column, suffix: str = "", most: int = 200) -> Column:
    """The title without what follows a suffix such as ' - Site'; null without a title element."""
    title = F.nullif(F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1), F.lit(""))
    return F.left(F.substring_index(title, suffix, 1) if suffix else title, F.lit(most))


def meta_price(html: Column) -> Column:
    """The content of the first meta element of a price, as a number; null without one."""
    tag = F.regexp_extract(html, r"(?is)<meta\b[^>]*\b(?:property|name|itemprop)\s*=\s*[\"'](?:product:|og:)?price(?::amount)?[\"'][^>]*>", 0)
    return parse_price(F.nullif(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")))


def asset_urls(html: Column, host: str, bad: tuple[str, ...] = ()) -> Column:
    """Distinct URLs of a host in order, from JSON members called url, baseUrl, picture or pictureUrl at any depth (escaped as
    HTML or not) and then from the rest of the page; queries are cut off, URLs with a bad piece left out."""
    plain = html
    for code, char in (("&quot;", '"'), ("&amp;", "&"), ("&#x27;", "'"), ("\\u002F", "/")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    own = r"https?://[^\"'\s<>\\]*" + host.replace(".", r"\.") + r"/[^\"'\s<>\\]*"
    members = F.regexp_extract_all(plain, F.lit(rf'(?i)"(?:baseurl|picture|pictureurl|url)"\s*:\s*"({own})"'), F.lit(1))
    urls = F.transform(F.concat(members, F.regexp_extract_all(plain, F.lit(f"({own})"), F.lit(1))), lambda u: F.substring_index(u, "?", 1))
    return F.filter(F.array_distinct(urls), lambda u: ~reduce(Column.__or__, [F.contains(u, F.lit(b)) for b in bad], F.lit(False)))


def number_groups(text: Column, pattern: str = r"[0-9]+(?:\.[0-9]+)?") -> Column:
    """All numbers of a text, in order, as array<double>."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)), lambda x: x.try_cast("double"))


def last_name(name: Column) -> Column:
    """The last name in lower case, suffixes left out, 'Last, First' or 'First Last'."""
    return F.substring_index(person_key(name), "|", 1)


@F.pandas_udf(StringType())
def casefold_norm(text: pd.Series) -> pd.Series:
    """NFKC, case folded, white space squeezed; null stays null. No built-in function normalises Unicode."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")
