"""All queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import QUERIES, SQL
from . import composite, relational, report_queries, scoring_queries, summary_queries, text_queries

__all__ = ["QUERIES", "SQL", "composite", "flagship", "relational", "report_queries", "scoring_queries", "summary_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.series_class(spark, sf_dir)
