"""The newest, the first and the best of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import week_start
from ..sources.files import work_folder


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the largest order columns of each key; combined before the shuffle, so no key is sorted."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def first_occurrence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, and how often the key occurs."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("occurrences")).select(key, "_r.*", "occurrences")


def best_match(pairs: DataFrame, key: str, score: str, other: str) -> DataFrame:
    """The pair with the highest score of each key; ties go to the smaller partner."""
    rest = [c for c in pairs.columns if c != key]
    return pairs.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), other)).alias("_r")).select(key, "_r.*").select(*pairs.columns)


def default_week(rows: DataFrame, key: str, today: Column) -> DataFrame:
    """The week of today if there is one, else the next, else the last, for each key."""
    monday, week = week_start(today), F.col("week_start")
    rank = F.when(week == monday, F.struct(F.lit(0), F.lit(0))).when(week > monday, F.struct(F.lit(1), F.datediff(week, monday))).otherwise(F.struct(F.lit(2), F.datediff(monday, week)))
    return rows.groupBy(key).agg(F.min_by("week_start", rank).alias("week_start"))


def placed(rows: DataFrame, *order: str | Column, name: str = "place_in_order") -> DataFrame:
    """Every row with its place in the order, from 1: ranges are numbered by themselves and moved by the sizes of those before.

    The ranges are written once, as the sizes and the rows must come from the same ones.
    """
    spark, at = rows.sparkSession, F.monotonically_increasing_id()
    folder = work_folder(spark, "placed")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def placed_within(rows: DataFrame, group: str, *order: str | Column, name: str) -> DataFrame:
    """Every row with its place in its group, from 1, so that no group has to fit one task.

    The rows are dealt by ranges of group and order and written once. A group's rows lie in
    neighbouring ranges; how many each range has of it, and where they begin there, is one
    row a group and range, which the rows are joined with.
    """
    spark, at = rows.sparkSession, F.monotonically_increasing_id()
    folder = work_folder(spark, "placed")
    rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges of a group
    starts = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_range"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range"))
    return rows.join(starts, on).withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_group", "_range", "_shift")
