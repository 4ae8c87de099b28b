import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty and a very long text, copies, a repeated row, and extra columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "Hello there, my friend. How are you today my dear old friend of mine?"), (2, "Hello there,  my friend. How are you today my dear old friend of mine?\n"), (3, None), (4, ""), (5, long), (6, long), (7, "x"), (7, "x"), (None, "null id text of words"), (8, "...!!! 123"), (9, "über straße naïve café")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"score": F.lit("s"), "rid": F.lit(1), "name": F.lit(2), "lang_pred": F.lit(None).cast("int"), "a.b": F.lit(3), "lang": F.lit("en"), "kept": F.lit(True)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
