"""Data-quality checks whose results are rows: level, check, key, message."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import iso_week, week_bounds

FINDING = ["level", "check", "key", "message"]


def rule_findings(rows: DataFrame, check: str, key: str, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """A finding for each row and rule (message: (level, condition of the fault)) that holds; a null condition is no fault."""
    faults = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"))) for message, (level, bad) in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(faults).alias("f")).select("f.level", F.lit(check).alias("check"), "key", "f.message")


def key_findings(rows: DataFrame, check: str, key: str, message: str, level: str = "error") -> DataFrame:
    """A finding for each row that a join or a group has left over."""
    return rows.select(F.lit(level).alias("level"), F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.lit(message).alias("message"))


def duplicates(rows: DataFrame, check: str, key: str, message: str) -> DataFrame:
    return key_findings(rows.groupBy(key).count().filter("count > 1"), check, key, message)


def dangling(rows: DataFrame, check: str, key: str, ref: str, targets: DataFrame, target: str, message: str) -> DataFrame:
    """A finding for each row whose reference has no target; a null reference is none."""
    bad = rows.filter(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("_target")), F.col(ref) == F.col("_target"), "left_anti")
    return key_findings(bad, check, key, message)


def week_membership(copies: DataFrame) -> DataFrame:
    """Copies (id, week, start_day, end_day) that don't touch the week they are filed under."""
    monday, sunday = week_bounds(F.col("week"))
    outside = (F.col("start_day") > sunday) | (F.coalesce("end_day", "start_day") < monday)
    return rule_findings(copies, "week-membership", "id", {"bad-week": ("error", monday.isNull()), "outside-week": ("error", outside)})


def missing_start_week(records: DataFrame, copies: DataFrame, published_weeks: DataFrame) -> DataFrame:
    """Records without a copy in the week they start in, where that week is published."""
    starts = records.select("id", iso_week(F.col("start_day")).alias("week")).join(published_weeks, "week", "left_semi")
    return key_findings(starts.join(copies.select("id", "week"), ["id", "week"], "left_anti"), "start-week", "id", "missing-in-start-week")


def times(records: DataFrame) -> DataFrame:
    return rule_findings(records, "times", "id", {"end-before-start": ("error", F.col("end_raw") < F.col("start_day")), "no-end": ("warning", F.col("end_raw").isNull())})


def offset_valid(text: Column, zone: str) -> Column:
    """Whether a written time's offset is the zone's offset at that instant; null if it has none."""
    offset = F.nullif(F.regexp_extract(text, r"([+-]\d{2}:\d{2})$", 1), F.lit(""))
    at = F.try_to_timestamp(F.concat(F.substring(text, 1, 19), offset), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    minutes = (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60
    written = F.substring(offset, 1, 3).cast("int") * 60 + F.when(offset.startswith("-"), -1).otherwise(1) * F.substring(offset, 5, 2).cast("int")
    return F.when(offset.isNotNull(), F.coalesce(minutes == written, F.lit(False)))


def offsets(records: DataFrame, zone: str) -> DataFrame:
    """Records (id, start_at as text) whose written offset isn't the zone's at that instant."""
    return rule_findings(records, "times", "id", {"wrong-offset": ("error", ~offset_valid(F.col("start_at"), zone))})


def manifest(listed: DataFrame, weeks: DataFrame) -> DataFrame:
    """Faults of a manifest (week, first, last, file) and the weeks that have files but aren't listed."""
    monday, sunday = week_bounds(F.col("week"))
    rules = {
        "bad-week": ("error", monday.isNull()),
        "wrong-bounds": ("error", (F.col("first") != monday) | (F.col("last") != sunday)),
        "wrong-file-name": ("error", F.col("file") != F.concat("week", F.lit(".json"))),
    }
    unlisted = weeks.select("week").distinct().join(listed, "week", "left_anti")
    return run_all(rule_findings(listed, "manifest", "week", rules), key_findings(unlisted, "manifest", "week", "not-listed"))


def candidates(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Faults of candidates (key, id, file, state, event_id, reason): ids in two files, imports without their event (id), rejections without a reason."""
    twice = rows.groupBy("id").agg((F.min("file") != F.max("file")).alias("several")).filter("several")
    imported = F.col("state") == "imported"
    rules = {
        "imported-without-event": ("error", imported & F.col("event_id").isNull()),
        "rejected-without-reason": ("error", (F.col("state") == "rejected") & F.coalesce(F.trim("reason") == "", F.lit(True))),
    }
    missing = dangling(rows.filter(imported), "candidates", "key", "event_id", events, "id", "event-missing")
    return run_all(key_findings(twice, "candidates", "id", "id-in-two-files"), rule_findings(rows, "candidates", "key", rules), missing)


def dictionary(categories: DataFrame, aliases: DataFrame, axes: list[str]) -> DataFrame:
    """Faults of categories (axis, category) and aliases (alias, category); keys are names.

    A category twice on an axis; an axis that isn't known; an alias of no category, one that is a category's name, and
    one of several categories.
    """
    names = categories.select("category").distinct()
    several = aliases.groupBy("alias").agg((F.min("category") != F.max("category")).alias("several")).filter("several")
    return run_all(
        key_findings(categories.groupBy("axis", "category").count().filter("count > 1"), "dictionary", "category", "duplicate-category"),
        key_findings(categories.filter(~F.col("axis").isin(*axes)).select("category").distinct(), "dictionary", "category", "unknown-axis"),
        key_findings(aliases.join(names, "category", "left_anti").select("alias").distinct(), "dictionary", "alias", "alias-of-unknown"),
        key_findings(aliases.select("alias").distinct().join(names.withColumnRenamed("category", "alias"), "alias", "left_semi"), "dictionary", "alias", "alias-shadows-category"),
        key_findings(several, "dictionary", "alias", "alias-of-several"),
    )


def dictionary_use(used: DataFrame, records: DataFrame, categories: DataFrame, aliases: DataFrame, reviewed: DataFrame, required: list[str]) -> DataFrame:
    """Faults of how categories are used.

    ``used`` (id, axis, category, published) against the dictionary: a published category that isn't canonical, a raw
    value that is neither category nor alias; ``records`` (id) without a category of a required axis; and values
    under review (``reviewed``: value) that the dictionary has already.
    """
    names = categories.select(F.col("category").alias("value")).distinct()
    known = names.union(aliases.select("alias")).distinct()
    values = used.withColumnRenamed("category", "value")
    odd = values.filter("published").join(names, "value", "left_anti").select("value").distinct()
    raw = values.filter("NOT published").join(known, "value", "left_anti").select("value").distinct()
    has = used.join(names, F.col("category") == F.col("value"), "left_semi")
    missing = [key_findings(records.join(has.filter(F.col("axis") == a).select("id"), "id", "left_anti"), "dictionary", "id", f"no-{a}", "warning") for a in required]
    return run_all(
        key_findings(odd, "dictionary", "value", "not-canonical"),
        key_findings(raw, "dictionary", "value", "unknown-value", "warning"),
        key_findings(reviewed.distinct().join(known, "value", "left_semi"), "dictionary", "value", "reviewed-but-known", "warning"),
        *missing,
    )


def registry(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Faults of sources (source) and pages (page, source): a source's id twice, and pages of no known source."""
    return run_all(duplicates(sources, "registry", "source", "duplicate-source"), dangling(pages, "registry", "page", "source", sources, "source", "unknown-source"))


def reports(rows: DataFrame) -> DataFrame:
    """Faults of run reports (key, run_id, agent, folder, started, finished, declared in seconds, status, reason).

    A run id is the day, a time or number and the agent; its month is the folder's.
    """
    measured = F.unix_timestamp("finished") - F.unix_timestamp("started")
    pattern = r"^\d{4}-\d{2}-\d{2}-\d{4}-[a-z-]+$"
    named = F.col("run_id").rlike(pattern)
    rules = {
        "bad-run-id": ("error", ~named),
        "other-agent": ("error", named & (F.regexp_extract("run_id", r"^\d{4}-\d{2}-\d{2}-\d{4}-([a-z-]+)$", 1) != F.col("agent"))),
        "other-month": ("error", named & (F.substring("run_id", 1, 7) != F.col("folder"))),
        "finished-before-start": ("error", measured < 0),
        "other-duration": ("warning", F.abs(measured - F.col("declared")) > 60),
        "partial-without-reason": ("error", (F.col("status") == "partial") & F.coalesce(F.trim("reason") == "", F.lit(True))),
    }
    return rule_findings(rows, "reports", "key", rules)


def report_files(loaded: DataFrame) -> DataFrame:
    """Reports (``sources.files.load_reports``) whose file doesn't lie where it belongs: agent's folder, month's folder, name; and those that can't be read."""
    rules = {
        "unreadable": ("error", F.col("_corrupt").isNotNull()),
        "outside-tree": ("error", F.col("_corrupt").isNull() & F.col("name_run").isNull()),
        "other-name": ("error", F.col("name_run") != F.col("run_id")),
        "other-agent": ("error", F.col("folder_agent") != F.col("agent")),
        "other-month": ("error", F.col("folder_month") != F.substring("run_id", 1, 7)),
    }
    return rule_findings(loaded.withColumn("_key", F.coalesce("run_id", "file")), "report-files", "_key", rules)


def run_all(*findings: DataFrame) -> DataFrame:
    """All findings as one table."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.select(*FINDING)


def summary(findings: DataFrame, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by level (and more columns), and whether the level fails the run: errors always, warnings in strict mode."""
    fails = (F.col("level") == "error") | F.lit(strict)
    return findings.groupBy("level", *by).agg(F.count("*").alias("n")).withColumn("fails", fails)
