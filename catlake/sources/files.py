"""Catalogue files: nested documents in, partitions out, and the folder for files between jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "id string, week string, title string, description string, start_at string, end_at string, all_day boolean, venue string, municipality string, "
    "categories array<string>, price struct<type:string,text:string,amount:double,currency:string>, source struct<type:string,url:string>, "
    "last_verified_at string, cancelled boolean"
)
WEEK = f"schema_version int, week string, document string, generated_at string, events array<struct<{', '.join(x.replace(' ', ':', 1) for x in EVENT.split(', '))}>>"
MANIFEST = "schema_version int, generated_at string, weeks array<struct<id:string,`from`:string,`to`:string,file:string>>"
CANDIDATES = "schema_version int, generated_at string, candidates array<struct<id:string,title:string,date_text:string,municipality:string,status:string,source_url:string,production_event_id:string>>"
REPORT = "agent string, run_id string, started_at string, finished_at string, duration_seconds double, status string, partial_reason string, metrics map<string,string>, errors array<string>"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; only a local master may go without it.

    There it is below the warehouse, which one machine has for itself.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the finished tables ``name=n`` in a folder, which need not exist."""
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    found = [x.getPath().getName() for x in system.listStatus(path)]
    return sorted(int(x.split("=")[1]) for x in found if x.startswith(f"{name}=") and system.exists(_path(spark, f"{folder}/{x}/_SUCCESS")[0]))


def remove(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def write_catalog(rows: DataFrame, folder: str, most: int = 1000) -> None:
    """Week documents of at most ``most`` events, one line each, and the manifest of their weeks, in ``folder``.

    ``rows`` has week and event, a struct that starts with id; events are in the order of their id. No week is
    gathered in one place: rows are dealt by ranges of (week, id), and each range is cut into documents.
    """
    spark = rows.sparkSession
    dealt = f"{folder}/dealt"
    at = F.monotonically_increasing_id()
    rows.repartitionByRange("week", F.col("event")["id"]).sortWithinPartitions("week", F.col("event")["id"]).select("week", "event", F.shiftright(at, 33).alias("part"), at.alias("at")).write.parquet(dealt)
    rows = spark.read.parquet(dealt)
    first = rows.groupBy("week", "part").agg(F.min("at").alias("first"))
    cut = rows.join(first, ["week", "part"]).withColumn("cut", F.floor((F.col("at") - F.col("first")) / most))
    documents = cut.groupBy("week", "part", "cut").agg(F.array_sort(F.collect_list("event")).alias("events"))
    name = F.concat_ws("-", "week", F.lpad(F.col("part").cast("string"), 10, "0"), F.lpad(F.col("cut").cast("string"), 10, "0"))
    # Each line is a document, which says its own name: there are as many files as tasks, not as documents.
    documents.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "week", name.alias("document"), "events")).alias("value")).write.text(f"{folder}/weeks")
    listed = F.array_sort(F.collect_list(F.struct(F.col("week").alias("id"), F.col("week").alias("from"))))
    first.select("week").distinct().agg(listed.alias("weeks")).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "weeks")).alias("value")).write.text(f"{folder}/manifest")


def load_catalog(spark: SparkSession, weeks: str, manifest: str | None = None, whole: bool = False) -> DataFrame:
    """The copies of events in week documents, with (file_week, position, file: the document's name or its path); only weeks that the manifest lists, if one is given.

    Documents are lines of files, or with ``whole`` a file each. A week may have several; positions count through them in the order of their names.
    """
    files = spark.read.schema(WEEK).option("multiLine", whole).json(weeks).withColumn("file", F.coalesce("document", F.col("_metadata.file_path"))).drop("document")
    if manifest is not None:
        listed = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest).select(F.explode("weeks").alias("w")).select(F.col("w.id").alias("week")).distinct()
        files = files.join(F.broadcast(listed), "week", "left_semi")
    before = Window.partitionBy("week").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("week", "file", F.coalesce(F.size("events"), F.lit(0)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).select("file", "start")
    rows = files.select(F.col("week").alias("file_week"), "file", F.posexplode("events").alias("position", "e")).join(starts, "file")
    return rows.select("file_week", "file", (F.col("start") + F.col("position")).alias("position"), "e.*")


def load_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; unreadable lines are kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports from a tree of folders ``agent/yyyy-mm/run.json``, with what the place of each file says.

    Columns of the report, and file (its name), folder_agent, folder_month and name_run (the
    name without its ending), so that checks compare the report with its place. Files
    elsewhere in the tree have nulls there; a file that can't be read has _corrupt.
    """
    rows = (
        spark.read.schema(f"{REPORT}, _corrupt string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    )
    # A folder may be written as name=value, and a report as a folder with one part.
    place = r"(?:[^/=]*=)?([^/=]+)/(?:[^/=]*=)?(\d{4}-\d{2})/(?:[^/=]*=)?([^/=]+)\.json(?:/part-[^/]*)?$"
    part = lambda k: F.nullif(F.regexp_extract("path", place, k), F.lit(""))
    return rows.select("*", F.regexp_extract("path", r"([^/=]+?)(?:/part-[^/]*)?$", 1).alias("file"), part(1).alias("folder_agent"), part(2).alias("folder_month"), part(3).alias("name_run")).drop("path")


def load_candidates(spark: SparkSession, path: str, order: str = "file") -> DataFrame:
    """The rows of candidate documents with ``file`` (its name, or another field of the document that orders them) and position."""
    files = spark.read.schema(CANDIDATES).json(path).withColumn("name", F.col("_metadata.file_path"))
    return files.select(F.col("name" if order == "file" else order).alias("file"), F.posexplode("candidates").alias("position", "c")).select("file", "position", "c.*")


def last_candidates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row an id, from the last file and position; a link to a record only if it exists."""
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "status", "production_event_id"), F.struct("file", "position")).alias("r")).select("id", "r.*")
    targets = known.select(F.col("id").cast("string").alias("production_event_id"), F.lit(True).alias("_known"))
    return last.join(targets, "production_event_id", "left").select("id", "title", "status", F.when(F.col("_known"), F.col("production_event_id")).alias("record"))


def load_dictionary(categories: DataFrame, strict: bool = True) -> DataFrame:
    """(norm_key, category, axis, order, search_terms, targets) from (category, axis, order, label, aliases): one row a folded name or alias.

    search_terms are the category's label and aliases, sorted, each once. A key with several
    targets is an error; if not ``strict``, it is marked in the column ``targets`` instead.
    """
    from ..functions.text import fold

    terms = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    each = categories.select("category", "axis", "order", terms.alias("search_terms"), F.explode(F.concat(F.array("category"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    keys = each.select(fold(F.col("alias"), "category").alias("norm_key"), "category", "axis", "order", "search_terms")
    out = keys.groupBy("norm_key").agg(*[F.min_by(c, "category").alias(c) for c in ("category", "axis", "order", "search_terms")], F.count_distinct("category").alias("targets"))
    if strict and not (twice := out.filter("targets > 1").select("norm_key").limit(10)).isEmpty():
        raise ValueError(f"names with several categories: {', '.join(sorted(r['norm_key'] for r in twice.collect()))}")
    return out


def load_registry(rows: DataFrame) -> DataFrame:
    """Sources with their defaults: enabled unless said otherwise, one day between checks."""
    return rows.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "interval": F.coalesce("interval", F.lit(1).cast("long"))})


def load_pages(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(page, source, enabled, known) of the registry of pages (page, source, enabled): a page is on unless it or its source is off; known tells whether the source is registered."""
    own = sources.select("source", F.col("enabled").alias("_on"), F.lit(True).alias("_known"))
    joined = rows.join(own, "source", "left")
    on = F.coalesce("enabled", F.lit(True)) & F.coalesce("_on", F.lit(True))
    return joined.select("page", "source", on.alias("enabled"), F.coalesce("_known", F.lit(False)).alias("known"))


def load_codelist(spark: SparkSession, path: str, required: list[str], regions: list[str], minimum: int, types: dict[str, str] | None = None, districts: DataFrame | None = None) -> DataFrame:
    """Rows of a code list file within the regions, with a column ``problem`` that is null if the whole list is sound.

    Sound: all columns present, at least ``minimum`` rows, one validity date, numeric codes, each once; if ``types`` (as
    written to canonical) is given, no other type; if ``districts`` (region, district) is given, each region has just these.
    The column type is then the canonical one, null for a type that isn't known.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"the code list lacks {', '.join(missing)}")
    rows = raw.select(*required).filter(F.col("region").isin(*regions))
    if types is not None:
        rows = rows.withColumn("type", F.try_element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("type")))
    facts = rows.agg(
        F.count("*").alias("n"), F.count_distinct("valid_from").alias("dates"), F.count_distinct("code").alias("codes"), F.count_if(~F.coalesce(F.col("code").rlike(r"^\d+$"), F.lit(False))).alias("odd"),
        F.count_if(F.col("type").isNull() if types is not None else F.lit(False)).alias("untyped"),
    ).first()
    problem = (
        "too-few-rows" if facts["n"] < minimum else "several-dates" if facts["dates"] != 1 else "unknown-type" if facts["untyped"]
        else "bad-code" if facts["odd"] else "repeated-code" if facts["codes"] != facts["n"] else None
    )
    if problem is None and districts is not None:
        wanted, found = districts.filter(F.col("region").isin(*regions)).select("region", "district"), rows.select("region", "district")
        if not (wanted.exceptAll(found.distinct()).isEmpty() and found.join(F.broadcast(wanted), ["region", "district"], "left_anti").isEmpty()):
            problem = "other-districts"
    return rows.withColumn("problem", F.lit(problem).cast("string"))


def codelist_counts(rows: DataFrame) -> DataFrame:
    """Rows by region, and of all (region null)."""
    return rows.rollup("region").agg(F.count("*").alias("n"))


def export_weeks(records: DataFrame, bridge: DataFrame, folder: str) -> None:
    """One folder a week of records as JSON lines, in stored order; null keys are left out.

    ``records`` has id and its fields; ``bridge`` (id, week, position).
    """
    fields = [c for c in records.columns if c != "id"]
    rows = bridge.join(records, "id").select("week", "position", "id", F.to_json(F.struct("id", "position", *fields)).alias("value"))
    # By ranges of both, so that a week with very many records is several files, in order.
    rows.repartitionByRange("week", "position", "id").sortWithinPartitions("week", "position", "id").select("week", "value").write.partitionBy("week").text(folder)


def read_weeks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def roundtrip_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, difference): rows that only one export has, or whose fields differ."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*[c for c in sorted(df.columns) if c != key])), 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), key, "full_outer")
    difference = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differing")
    return both.select(key, difference.alias("difference")).filter("difference IS NOT NULL")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def content_store(bodies: DataFrame, body: str) -> DataFrame:
    """(hash, path, bytes): each different body once, under the path its SHA-256 gives."""
    rows = bodies.select(F.sha2(body, 256).alias("hash"), F.octet_length(body).alias("bytes"))
    return rows.groupBy("hash").agg(F.max("bytes").alias("bytes")).withColumn("path", F.concat_ws("/", F.substring("hash", 1, 2), "hash"))


def content_retention(history: DataFrame, last: int = 3) -> DataFrame:
    """(source, hash, keep): the last distinct contents of each source and the last one with items are kept; the rest may go.

    What is kept of a source is found by a limited rank, which Spark cuts in every task, and
    a maximum that is combined before the shuffle, so no source's contents are ranked whole.
    """
    contents = history.filter("hash IS NOT NULL").groupBy("source", "hash").agg(F.max("id").alias("id"), F.max(F.when(F.col("items") > 0, F.col("id"))).alias("used"))
    newest = contents.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("id")))).filter(F.col("n") <= last).select("source", "hash")
    used = contents.filter("used IS NOT NULL").groupBy("source").agg(F.max_by("hash", "used").alias("hash"))
    kept = newest.unionByName(used.select("source", "hash")).distinct().withColumn("_kept", F.lit(True))
    return contents.select("source", "hash").join(kept, ["source", "hash"], "left").select("source", "hash", F.coalesce("_kept", F.lit(False)).alias("keep"))


def latest_content(history: DataFrame) -> DataFrame:
    """(source, hash): the newest hash that isn't null; an attempt that found nothing new keeps the one before."""
    return history.filter("hash IS NOT NULL AND status < 400").groupBy("source").agg(F.max_by("hash", F.struct("fetched_at", "id")).alias("hash"))


def sitemap_rows(records: DataFrame) -> DataFrame:
    """(id, lastmod) of published records: verified, else last seen, else first seen."""
    return records.select("id", F.coalesce("verified", "last_seen", "first_seen").cast("string").alias("lastmod"))


def feed_rows(records: DataFrame) -> DataFrame:
    """(id, calendar, data): a calendar record and structured data of each record (id, title, start_day, end_day; start_at, end_at for timed ones).

    A record without start_at is all-day, and its end is the day after its last one; a timed
    record is in UTC, and lasts two hours where its end isn't known.
    """
    timed = F.col("start_at").isNotNull() if "start_at" in records.columns else F.lit(False)
    at = F.col("start_at") if "start_at" in records.columns else F.lit(None).cast("timestamp")
    till = F.coalesce(F.col("end_at") if "end_at" in records.columns else F.lit(None).cast("timestamp"), at + F.expr("INTERVAL 2 HOURS"))
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    utc = lambda t: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz")), "yyyyMMdd'T'HHmmss'Z'")
    iso = lambda t: F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.date_add(F.coalesce("end_day", "start_day"), 1)
    begins = F.when(timed, F.concat(F.lit("DTSTART:"), utc(at))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp("start_day")))
    ends = F.when(timed, F.concat(F.lit("DTEND:"), utc(till))).otherwise(F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(end)))
    escaped = F.col("title")
    for a, b in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    calendar = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string")), F.concat(F.lit("SUMMARY:"), escaped), begins, ends, F.lit("END:VEVENT")
    )
    data = F.to_json(F.struct(
        F.lit("Event").alias("@type"), F.col("title").alias("name"), F.when(timed, iso(at)).otherwise(F.col("start_day").cast("string")).alias("startDate"),
        F.when(timed, iso(till)).otherwise(F.col("end_day").cast("string")).alias("endDate"),
    ))
    return records.select("id", calendar.alias("calendar"), data.alias("data"))
