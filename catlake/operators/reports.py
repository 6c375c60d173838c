"""Shares, priorities and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_rates(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The share of rows with a value in each field, to four places; no rows, no line."""
    return rows.groupBy(*keys).agg(*[F.round(F.avg(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1.0).otherwise(0.0)), 4).alias(f) for f in fields])


def review_priority(rows: DataFrame, today: Column) -> DataFrame:
    """1 for this week's, 2 for the plan's horizon, 3 for older, 4 for the rest."""
    ahead = F.datediff("start_day", today)
    return rows.withColumn("priority", F.when(ahead.between(0, 6), 1).when(ahead.between(7, 14), 2).when(ahead < 0, 3).otherwise(4))


def shape_profile(rows: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """(keys, field, kinds, fill): what kinds of text each field holds, and how often it holds any."""
    long = rows.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(keys), fields, "field", "value")
    kind = (
        F.when(F.col("value").isNull(), None)
        .when(F.col("value").rlike(r"^-?\d+$"), "integer")
        .when(F.col("value").rlike(r"^-?\d+\.\d+$"), "number")
        .when(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .otherwise("text")
    )
    filled = F.avg(F.when(F.col("value").isNotNull() & (F.col("value") != ""), 1.0).otherwise(0.0))
    return long.withColumn("kind", kind).groupBy(*keys, "field").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.round(filled, 4).alias("fill"))


def batch_status(ok: Column, failed: Column, changed: Column) -> Column:
    """failed, partial, no-change or success from a batch's counts."""
    return F.when((failed > 0) & (ok == 0), "failed").when(failed > 0, "partial").when(changed == 0, "no-change").otherwise("success")


def backlog_band(rows: DataFrame) -> DataFrame:
    """The pressure of an open backlog of n: low below 30, medium to 70, high above."""
    return rows.withColumn("band", F.when(F.col("n") < 30, "low").when(F.col("n") <= 70, "medium").otherwise("high"))


def report_yield(rows: DataFrame) -> DataFrame:
    """Of each report's found items (report, event, source, confirmed): how many are confirmed, events a source, and the share of items that repeat an event."""
    n = rows.groupBy("report").agg(
        F.count_if("confirmed").alias("confirmed"), F.count("*").alias("found"), F.count_distinct("event").alias("events"), F.count_distinct("source").alias("sources")
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    return n.withColumns({"confirmation": share(F.col("confirmed"), F.col("found")), "per_source": share(F.col("events"), F.col("sources")), "duplicates": share(F.col("found") - F.col("events"), F.col("found"))})


def extract_metrics(items: DataFrame, *keys: str) -> DataFrame:
    """found, valid, rejected, unparsed and rejected_categories of items (parsed, valid, categories rejected): found is valid and rejected, unparsed are among the rejected."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("found"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"), F.count_if(~F.col("parsed")).alias("unparsed"),
        F.coalesce(F.sum(F.size("rejected_values")), F.lit(0)).cast("long").alias("rejected_categories"),
    )


def batch_report(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Sums and counts of the sources' outcomes (source, place, ok, changed, items, error), with what was covered, sorted and each once, and the errors."""
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.count_distinct("source").alias("sources"), F.count_if("changed").alias("changed"),
        F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("source")))).alias("covered"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("source", "id", "error")))).alias("errors"),
    )
