"""Differences of sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_way_difference(left: DataFrame, right: DataFrame, left_only: str, right_only: str) -> DataFrame:
    """The rows that only one side has, with a column ``problem`` that says which; duplicates count."""
    return left.exceptAll(right).withColumn("problem", F.lit(left_only)).unionByName(right.exceptAll(left).withColumn("problem", F.lit(right_only)))
