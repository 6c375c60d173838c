"""Records that last: overlap, weeks and days touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import week_start


def overlaps(first: Column, last: Column, start: str = "start_day", end: str = "end_day") -> Column:
    """Whether a record touches [first, last]; without an end it lasts one day."""
    return (F.col(start) <= last) & (F.coalesce(F.col(end), F.col(start)) >= first)


def explode_weeks(records: DataFrame, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """One row for each week touched (week_start), so that weeks join by equality.

    An end before the start counts as the start.
    """
    last = F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start))
    return records.filter(F.col(start).isNotNull()).withColumn("week_start", F.explode(F.sequence(week_start(F.col(start)), week_start(last), F.expr("INTERVAL 7 DAY"))))


def explode_days(records: DataFrame, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """One row for each day touched (day)."""
    last = F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start))
    return records.filter(F.col(start).isNotNull()).withColumn("day", F.explode(F.sequence(F.col(start), last)))


def day_role(day: Column, start: str = "start_day", end: str = "end_day") -> Column:
    """all-day, starts, ends or continues."""
    last = F.coalesce(F.col(end), F.col(start))
    return F.when(F.col(start) == last, "all-day").when(day == F.col(start), "starts").when(day == last, "ends").otherwise("continues")


def calendar_days(records: DataFrame, monday: Column, spine: DataFrame) -> DataFrame:
    """The week's seven days with the records that touch each; a day without records has one row of nulls.

    ``spine`` has any one row; it makes the seven days.
    """
    days = spine.limit(1).select(F.explode(F.sequence(monday, F.date_add(monday, 6))).alias("day"))
    sunday = F.date_add(monday, 6)
    clipped = records.filter(overlaps(monday, sunday)).withColumns({"_first": F.greatest("start_day", monday), "_last": F.least(F.greatest(F.coalesce("end_day", "start_day"), "start_day"), sunday)})
    touching = explode_days(clipped, "_first", "_last").drop("_first", "_last")
    return days.join(touching, "day", "left").withColumn("role", F.when(F.col("id").isNotNull(), day_role(F.col("day"))))
