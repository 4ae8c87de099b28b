"""Text functions on cases with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values, kind="string"):
        rows = [(v,) for v in values]
        return [r[0] for r in spark.createDataFrame(rows, f"x {kind}").select(function(F.col("x")).alias("y")).collect()]

    return run


def test_numbers(apply):
    assert apply(T.whole_number, "12", "*7", "m3", "*m4", "x", "", None, "1.5") == [12, 7, 3, 4, None, None, None, None]
    assert apply(T.decimal_number, "1.5", "*2", "m.5", "a") == [1.5, 2.0, 0.5, None]
    assert apply(T.number_groups, "24.1 48 1:12.5", None) == [[24.1, 48.0, 1.0, 12.5], []]
    assert apply(T.human_number, 12.0, 1234.0, 1234567.0, 2_500_000_000.0, 999.6, kind="double") == ["12", "1.2K", "1.23M", "2.50B", "1.0K"]
    assert apply(T.human_time, 45.0, 160.0, 5400.0, kind="double") == ["45 seconds", "~3 minutes", "~1.5 hours"]
    assert apply(T.month_label, 202403, kind="int") == ["2024-03"]


def test_dates(apply, spark):
    assert apply(T.century, 1901, 1900, 0, -44, None, 2500, -3001, kind="int") == [20, 20, None, -1, None, None, None]
    own = spark.createDataFrame([("Sat, 30 Mar 2019 08:00:00 GMT", None), ("junk", "2020-05-06T01"), (None, None)], "a string, b string")
    assert [r[0] for r in own.select(T.created_date(F.col("a"), F.col("b"))).collect()] == [datetime.date(2019, 3, 30), datetime.date(2020, 5, 6), None]
    assert apply(T.valid_month, datetime.date(2019, 3, 1), datetime.date(1980, 3, 1), kind="date") == [201903, None]


def test_phrases(apply):
    assert apply(lambda c: T.tag_phrases(c, ("the",)), "New+York, 2009,ab12cd,the,bhz rock , the+lake", None) == [["new york", "rock", "lake"], []]
    assert apply(lambda c: T.clean_phrase(c, ("photo",)), "red photo barn", "caf%C3%A9", "x deadbeef00", None, "photo") == ["red barn", "", "", "", ""]
    assert apply(T.rough_url_decode, "a%20b+c%27s%21") == ["a b c's%21"]
    assert apply(T.last_name, "Bob Baffert Jr.", "Baffert, Bob") == ["baffert", "baffert"]
    assert apply(lambda c: T.one_of(c, ("high", "low"), "low"), " High", "x", None) == ["high", "low", "low"]


README = """![build](http://x/y.svg)
#  🚀 My [Tool](http://x) <b>v2</b>

![badge](http://x/b.png)

- [toc](#a)

```
code here that is long
```

short

A **fast** tool for [things](http://z) that   work. It does.
"""


def test_readme(apply, spark):
    own = spark.createDataFrame([(README, "me/repo"), ("no heading", "me/other"), ("# ab\n\nsome longer prose here", "x")], "t string, n string")
    assert [r[0] for r in own.select(T.markdown_title(F.col("t"), F.col("n"))).collect()] == ["My Tool v2", "other", "x"]
    assert apply(T.first_prose, README, "", None, "# t\n\nsome longer prose here") == ["A fast tool for things that work. It does.", "", "", "some longer prose here"]
    assert apply(lambda c: T.top_terms(c, ("the",), 2), "the cat cat dog `bird bird bird` ant ant ```\ncow cow cow\n```", "", None) == [{"ant": 2, "cat": 2}, {}, {}]


def test_tracks(apply):
    assert apply(T.track_condition, "Wet (Sloppy)", "MUDDY", "Good", "wet", "x", None) == ["sloppy", "muddy", "good", "wet-fast", "fast", "fast"]
    assert apply(T.style_score, 35.0, 36.5, 37.9, 38.0, None, kind="double") == [7.0, 8.0, 8.5, 4.0, 6.5]
    assert apply(T.pace_fit, 35.5, 36.0, 50.0, None, kind="double") == [10.0, 9.0, 0.0, 6.0]
    assert apply(T.dosage_score, 1.0, None, 9.0, kind="double") == [10.0, 7.5, 0.0]
    assert [tuple(x) for x in apply(T.finish_place, "1 [ c ]", "17-DQ", "Scratched", "x")] == [(1, None), (17, None), (None, "scratched"), (None, None)]


PAGE = """<title> Nice flat - Site </title><meta property="product:price:amount" content="$1,250.00">
<script>{"a":{"pictureUrl":"https://img.host.com/im/1.jpg?w=2","x":[{"baseUrl":"https:\\u002F\\u002Fimg.host.com/pictures/2.jpg"}]},
"other":"https://img.host.com/user-profile-pic/3.jpg"}</script><img src="https://img.host.com/im/1.jpg"><img src="https://else.com/4.jpg">"""


def test_pages(apply):
    assert apply(lambda c: T.page_title(c, " - Site"), PAGE, "none", None) == ["Nice flat", None, None]
    assert apply(T.meta_price, PAGE, "<meta name=description content='5'>", None) == [1250.0, None, None]
    assert apply(lambda c: T.asset_urls(c, "host.com", ("user-profile-pic",)), PAGE) == [["https://img.host.com/im/1.jpg", "https://img.host.com/pictures/2.jpg"]]
