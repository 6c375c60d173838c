"""Data-quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.temporal import iso_week
from ..functions.urls import generic_url
from ..operators import match, quality as q
from ..operators.schemas import schema_findings
from .registry import ORACLE_SQL, QUERIES, query

_F = "'{}' AS level, '{}' AS \"check\", CAST({} AS VARCHAR) AS key, '{}' AS message"


def _f(level, check, key, message):
    return _F.format(level, check, key, message)


_DOCS = f"""SELECT {_f('error', 'texts', 'doc_id', 'no-text')} FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL
    SELECT {_f('warning', 'texts', 'doc_id', 'short-text')} FROM documents WHERE n_chars < 200 UNION ALL
    SELECT {_f('error', 'texts', 'doc_id', 'bad-length')} FROM documents WHERE n_chars <> length(text) UNION ALL
    SELECT {_f('error', 'texts', 'doc_id', 'unknown-language')} FROM documents WHERE lang NOT IN ('en', 'de', 'fr')"""


@query(_DOCS)
def dq_texts(spark, sf_dir):
    rules = {
        "no-text": ("error", F.col("text").isNull() | (F.trim("text") == "")),
        "short-text": ("warning", F.col("n_chars") < 200),
        "bad-length": ("error", F.col("n_chars") != F.char_length("text")),
        "unknown-language": ("error", ~F.col("lang").isin("en", "de", "fr")),
    }
    return q.rule_findings(b.table(spark, sf_dir, "documents"), "texts", "doc_id", rules)


#: A schema document of the kind that catalogues declare their records by.
_RECORD = {
    "type": "object",
    "required": ["id", "text", "lang", "source", "words"],
    "additionalProperties": False,
    "$defs": {"name": {"type": "string", "pattern": "^src[0-9]+$"}},
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z0-9]+(-[a-z0-9]+)*$"},
        "text": {"type": "string", "minLength": 1},
        "lang": {"enum": ["en", "de", "fr"]},
        "source": {"type": "object", "required": ["name"], "properties": {"name": {"$ref": "#/$defs/name"}, "chars": {"type": ["integer", "null"], "minimum": 200}}},
        "words": {"type": "array", "minItems": 3, "uniqueItems": True, "items": {"type": "string", "minLength": 1, "pattern": "^[^0-9]*$"}},
    },
}
_WORDS = "list_slice(string_split(text, ' '), 1, 3)"
_ITEM = f"(SELECT doc_id, i - 1 AS i, {_WORDS}[i] AS w FROM documents, (SELECT unnest(range(1, 4)) AS i) WHERE i <= len({_WORDS}))"


def _broken(rule, of, message="", literal=None):
    message = message or f"'{literal}'"
    return f"SELECT 'error' AS level, 'schema' AS \"check\", CAST(doc_id AS VARCHAR) AS key, {message} AS message FROM {of} WHERE {rule}"


@query(" UNION ALL ".join([
    _broken("doc_id % 50 = 0", "documents", literal="id pattern"),
    _broken("doc_id % 70 = 0", "documents", literal="text required"), _broken("text = '' AND doc_id % 70 <> 0", "documents", literal="text minLength"),
    _broken("lang NOT IN ('en', 'de', 'fr')", "documents", literal="lang enum"),
    _broken("doc_id % 90 = 0", "documents", literal="source required"), _broken("doc_id % 90 <> 0 AND doc_id % 60 = 0", "documents", literal="source.name pattern"),
    _broken("doc_id % 90 <> 0 AND n_chars < 200", "documents", literal="source.chars minimum"),
    _broken(f"len({_WORDS}) < 3", "documents", literal="words minItems"), _broken(f"len(list_distinct({_WORDS})) < len({_WORDS})", "documents", literal="words uniqueItems"),
    _broken("w = ''", _ITEM, "'words[' || i || '] minLength'"), _broken("regexp_matches(w, '[0-9]')", _ITEM, "'words[' || i || '] pattern'"),
]))
def dq_schema(spark, sf_dir):
    key = F.col("doc_id")
    source = F.struct(F.when(key % 60 == 0, "Source").otherwise(F.col("source")).alias("name"), F.col("n_chars").alias("chars"))
    record = F.struct(
        F.concat(F.when(key % 50 == 0, "Doc_").otherwise("doc-"), key.cast("string")).alias("id"), F.when(key % 70 != 0, F.col("text")).alias("text"), "lang",
        F.when(key % 90 != 0, source).alias("source"), F.slice(F.split("text", " "), 1, 3).alias("words"),
    )
    return schema_findings(b.table(spark, sf_dir, "documents").select("doc_id", record.alias("record")), "doc_id", "record", _RECORD)


_LISTED = """(SELECT strftime(week_start, '%G-W%V') AS week, week_start + CASE WHEN extract(day FROM week_start) = 5 THEN 1 ELSE 0 END AS first, week_start + 6 AS last,
      strftime(week_start, '%G-W%V') || CASE WHEN extract(day FROM week_start) = 9 THEN '.js' ELSE '.json' END AS file, week_start FROM (SELECT DISTINCT week_start FROM wks) WHERE extract(day FROM week_start) <> 20)"""


@query(f"""SELECT {_f('error', 'manifest', 'week', 'wrong-bounds')} FROM {_LISTED} WHERE first <> week_start UNION ALL SELECT {_f('error', 'manifest', 'week', 'wrong-file-name')} FROM {_LISTED} WHERE NOT file LIKE '%.json' UNION ALL
    SELECT {_f('error', 'manifest', 'week', 'not-listed')} FROM (SELECT DISTINCT strftime(week_start, '%G-W%V') AS week FROM wks WHERE extract(day FROM week_start) = 20)""", "wks")
def dq_manifest(spark, sf_dir):
    weeks = b.weeks(spark, sf_dir).select("week_start").distinct().withColumn("week", iso_week(F.col("week_start")))
    day, start = F.day("week_start"), F.col("week_start")
    listed = weeks.filter(day != 20).select("week", F.when(day == 5, F.date_add(start, 1)).otherwise(start).alias("first"), F.date_add(start, 6).alias("last"), F.concat("week", F.when(day == 9, ".js").otherwise(".json")).alias("file"))
    return q.manifest(listed, weeks)


_AT = "(SELECT id, start_day, extract(year FROM start_day) AS y FROM pub)"
_SUNDAY = "(make_date(y, {m}, 31) - CAST(extract(dow FROM make_date(y, {m}, 31)) AS INTEGER))"


@query(f"""SELECT {_f('error', 'times', 'id', 'wrong-offset')} FROM {_AT} WHERE (id % 2 = 0) <> (start_day >= {_SUNDAY.format(m=3)} AND start_day < CASE WHEN y < 1996 THEN make_date(y, 9, 30) - CAST(extract(dow FROM make_date(y, 9, 30)) AS INTEGER) ELSE {_SUNDAY.format(m=10)} END)""", "pub")
def dq_offsets(spark, sf_dir):
    """Times at noon in central Europe, with the summer's offset for even ids and the winter's for odd ones."""
    text = F.concat(F.col("start_day").cast("string"), F.lit("T12:00:00"), F.when(F.col("id") % 2 == 0, "+02:00").otherwise("+01:00"))
    return q.offsets(b.published(spark, sf_dir).select("id", text.alias("start_at")), "Europe/Prague")


@query(f"""SELECT {_f('warning', 'manifest-fresh', 'place', 'older-than-records')} FROM (SELECT place, max(start_day) AS newest, max(CASE WHEN price_type = 'free' THEN start_day END) AS listed FROM pub GROUP BY place) WHERE listed < newest""", "pub")
def dq_manifest_fresh(spark, sf_dir):
    rows = b.published(spark, sf_dir).groupBy("place").agg(F.max("start_day").alias("newest"), F.max(F.when(F.col("price_type") == "free", F.col("start_day"))).alias("listed"))
    return q.key_findings(rows.filter("listed < newest"), "manifest-fresh", "place", "older-than-records", "warning")


@query(f"""SELECT {_f('error', 'week-membership', 'id', 'outside-week')} FROM (SELECT *, CAST(date_trunc('week', start_day + CAST(id % 9 AS INTEGER)) AS DATE) AS monday FROM pub) WHERE start_day > monday + 6 OR coalesce(end_day, start_day) < monday""", "pub")
def dq_week_membership(spark, sf_dir):
    copies = b.published(spark, sf_dir).withColumn("week", iso_week(F.date_add("start_day", (F.col("id") % 9).cast("int"))))
    return q.week_membership(copies)


_ENDS = "(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start_day, CAST(max(l_shipdate) AS DATE) AS end_raw FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)"


def _ends(spark, sf_dir):
    last = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("end_raw"))
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start_day")).join(last, "id", "left")


_TIMES = f"SELECT {_f('error', 'times', 'id', 'end-before-start')} FROM {_ENDS} WHERE end_raw < start_day UNION ALL SELECT {_f('warning', 'times', 'id', 'no-end')} FROM {_ENDS} WHERE end_raw IS NULL"


@query(_TIMES)
def dq_times(spark, sf_dir):
    return q.times(_ends(spark, sf_dir))


@query(f"SELECT {_f('error', 'identity', 'l_orderkey', 'copies-differ')} FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1")
def dq_identity(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    return q.key_findings(match.identity_conflicts(lines, "id", ["l_linestatus"]), "identity", "id", "copies-differ")


@query(f"""SELECT {_f('error', 'start-week', 'id', 'missing-in-start-week')} FROM pub WHERE id % 4 = 0 AND strftime(start_day, '%G-W%V') IN (SELECT strftime(start_day, '%G-W%V') FROM pub WHERE id % 4 <> 0)""", "pub")
def dq_start_week(spark, sf_dir):
    rows = b.published(spark, sf_dir)
    copies = rows.filter("id % 4 <> 0").select("id", iso_week(F.col("start_day")).alias("week"))
    return q.missing_start_week(rows, copies, copies.select("week").distinct())


@query(f"SELECT {_f('warning', 'generic-url', 'page_id', 'site-only')} FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^[a-z]+://[^/]+/') ELSE url END AS url FROM pages) WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/?(#.*)?$')")
def dq_generic_url(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "^[a-z]+://[^/]+/", 0)).otherwise(F.col("url")).alias("url"))
    return q.rule_findings(pages, "generic-url", "page_id", {"site-only": ("warning", generic_url(F.col("url")))})


@query(f"SELECT {_f('warning', 'semantic-duplicate', 'min(id)', 'several-ids')} FROM pub GROUP BY start_day, place, price_type HAVING count(DISTINCT id) > 1", "pub")
def dq_semantic_dup(spark, sf_dir):
    return q.key_findings(match.semantic_duplicates(b.published(spark, sf_dir), ["start_day", "place", "price_type"]), "semantic-duplicate", "first", "several-ids", "warning")


_ROWS = """(SELECT l_orderkey || '-' || l_linenumber AS key, l_orderkey AS id, l_suppkey % 2 AS file, CASE l_returnflag WHEN 'A' THEN 'imported' WHEN 'R' THEN 'rejected' ELSE 'new' END AS state,
      CASE WHEN l_linenumber > 1 THEN l_partkey END AS event_id, CASE WHEN l_quantity > 10 THEN 'old' WHEN l_quantity > 5 THEN ' ' END AS reason FROM lineitem)"""


@query(f"""SELECT {_f('error', 'candidates', 'id', 'id-in-two-files')} FROM {_ROWS} GROUP BY id HAVING min(file) <> max(file) UNION ALL
    SELECT {_f('error', 'candidates', 'key', 'imported-without-event')} FROM {_ROWS} WHERE state = 'imported' AND event_id IS NULL UNION ALL
    SELECT {_f('error', 'candidates', 'key', 'rejected-without-reason')} FROM {_ROWS} WHERE state = 'rejected' AND coalesce(trim(reason), '') = '' UNION ALL
    SELECT {_f('error', 'candidates', 'key', 'event-missing')} FROM {_ROWS} WHERE state = 'imported' AND event_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def dq_candidates(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 2).alias("file"),
        F.when(F.col("l_returnflag") == "A", "imported").when(F.col("l_returnflag") == "R", "rejected").otherwise("new").alias("state"),
        F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("event_id"), F.when(F.col("l_quantity") > 10, "old").when(F.col("l_quantity") > 5, " ").alias("reason"),
    )
    return q.candidates(lines, b.table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id")))


_CATEGORIES = "(SELECT CASE WHEN p_size > 45 THEN 'colour' WHEN p_partkey % 2 = 0 THEN 'kind' ELSE 'audience' END AS axis, p_name AS category, p_partkey FROM part)"
_ALIASES = "(SELECT CASE WHEN s_suppkey % 7 = 0 THEN coalesce(p_name, 'x') ELSE 'alias ' || (s_suppkey % 40) END AS alias, CASE WHEN s_suppkey % 5 = 0 THEN 'nothing' ELSE coalesce(p_name, 'y') END AS category FROM supplier LEFT JOIN part ON p_partkey = s_suppkey)"


def _dictionary(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    categories = part.select(F.when(F.col("p_size") > 45, "colour").when(F.col("p_partkey") % 2 == 0, "kind").otherwise("audience").alias("axis"), F.col("p_name").alias("category"))
    rows, key = b.table(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey"), "left"), F.col("s_suppkey")
    alias = F.when(key % 7 == 0, F.coalesce("p_name", F.lit("x"))).otherwise(F.concat(F.lit("alias "), (key % 40).cast("string")))
    return categories, rows.select(alias.alias("alias"), F.when(key % 5 == 0, "nothing").otherwise(F.coalesce("p_name", F.lit("y"))).alias("category"))


@query(f"""SELECT {_f('error', 'dictionary', 'category', 'duplicate-category')} FROM {_CATEGORIES} GROUP BY axis, category HAVING count(*) > 1 UNION ALL
    SELECT {_f('error', 'dictionary', 'category', 'unknown-axis')} FROM (SELECT DISTINCT category FROM {_CATEGORIES} WHERE axis = 'colour') UNION ALL
    SELECT {_f('error', 'dictionary', 'alias', 'alias-of-unknown')} FROM (SELECT DISTINCT alias FROM {_ALIASES} WHERE category NOT IN (SELECT p_name FROM part)) UNION ALL
    SELECT {_f('error', 'dictionary', 'alias', 'alias-shadows-category')} FROM (SELECT DISTINCT alias FROM {_ALIASES} WHERE alias IN (SELECT p_name FROM part)) UNION ALL
    SELECT {_f('error', 'dictionary', 'alias', 'alias-of-several')} FROM {_ALIASES} GROUP BY alias HAVING min(category) <> max(category)""")
def dq_dictionary(spark, sf_dir):
    return q.dictionary(*_dictionary(spark, sf_dir), ["kind", "audience"])


_USED = "(SELECT l_orderkey AS id, CASE WHEN l_partkey % 2 = 0 THEN 'kind' ELSE 'audience' END AS axis, CASE WHEN l_quantity > 48 THEN 'odd ' || l_suppkey ELSE p_name END AS category, l_returnflag = 'A' AS published FROM lineitem JOIN part ON l_partkey = p_partkey)"
_KNOWN = f"(SELECT p_name AS value FROM part UNION SELECT alias FROM {_ALIASES})"


@query(f"""SELECT {_f('error', 'dictionary', 'category', 'not-canonical')} FROM (SELECT DISTINCT category FROM {_USED} WHERE published AND category NOT IN (SELECT p_name FROM part)) UNION ALL
    SELECT {_f('warning', 'dictionary', 'category', 'unknown-value')} FROM (SELECT DISTINCT category FROM {_USED} WHERE NOT published AND category NOT IN (SELECT value FROM {_KNOWN})) UNION ALL
    SELECT {_f('warning', 'dictionary', 'value', 'reviewed-but-known')} FROM (SELECT DISTINCT 'alias ' || (c_custkey % 60) AS value FROM customer) WHERE value IN (SELECT value FROM {_KNOWN}) UNION ALL
    SELECT {_f('warning', 'dictionary', 'o_orderkey', 'no-kind')} FROM orders WHERE o_orderkey NOT IN (SELECT id FROM {_USED} WHERE axis = 'kind' AND category IN (SELECT p_name FROM part))""")
def dq_dictionary_use(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    category = F.when(F.col("l_quantity") > 48, F.concat(F.lit("odd "), F.col("l_suppkey").cast("string"))).otherwise(F.col("p_name"))
    used = lines.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_partkey") % 2 == 0, "kind").otherwise("audience").alias("axis"), category.alias("category"), (F.col("l_returnflag") == "A").alias("published"))
    reviewed = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("alias "), (F.col("c_custkey") % 60).cast("string")).alias("value"))
    return q.dictionary_use(used, b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), *_dictionary(spark, sf_dir), reviewed, ["kind"])


@query(f"""SELECT {_f('error', 'registry', 's_name', 'duplicate-source')} FROM (SELECT s_suppkey % 90 AS s_name FROM supplier) GROUP BY s_name HAVING count(*) > 1 UNION ALL
    SELECT {_f('error', 'registry', 'event_id', 'unknown-source')} FROM events WHERE user_id NOT IN (SELECT s_suppkey % 90 FROM supplier)""")
def dq_registry(spark, sf_dir):
    sources = b.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 90).alias("source"))
    return q.registry(sources, b.table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), F.col("user_id").alias("source")))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_REPORTS = f"""(SELECT event_id AS key, CASE WHEN event_id % 11 = 0 THEN 'run' ELSE strftime(ts, '%Y-%m-%d-%H%M') || '-' || event_type END AS run_id, CASE WHEN event_id % 13 = 0 THEN 'planner' ELSE event_type END AS agent,
      CASE WHEN event_id % 17 = 0 THEN '1999-01' ELSE strftime(ts, '%Y-%m') END AS folder, {_K} - 20 AS measured, value AS declared, event_type = 'error' AS part, event_id % 2 = 0 AS said, event_type FROM events)"""


@query(f"""SELECT {_f('error', 'reports', 'key', 'bad-run-id')} FROM {_REPORTS} WHERE key % 11 = 0 UNION ALL SELECT {_f('error', 'reports', 'key', 'other-agent')} FROM {_REPORTS} WHERE key % 11 <> 0 AND agent <> event_type UNION ALL
    SELECT {_f('error', 'reports', 'key', 'other-month')} FROM {_REPORTS} WHERE key % 11 <> 0 AND folder = '1999-01' UNION ALL SELECT {_f('error', 'reports', 'key', 'finished-before-start')} FROM {_REPORTS} WHERE measured < 0 UNION ALL
    SELECT {_f('warning', 'reports', 'key', 'other-duration')} FROM {_REPORTS} WHERE abs(measured - declared) > 60 UNION ALL SELECT {_f('error', 'reports', 'key', 'partial-without-reason')} FROM {_REPORTS} WHERE part AND NOT said""")
def dq_reports(spark, sf_dir):
    key, at = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = b.table(spark, sf_dir, "events").select(
        key.alias("key"), F.when(key % 11 == 0, "run").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd-HHmm"), F.lit("-"), "event_type")).alias("run_id"), F.when(key % 13 == 0, "planner").otherwise(F.col("event_type")).alias("agent"),
        F.when(key % 17 == 0, "1999-01").otherwise(F.date_format("ts", "yyyy-MM")).alias("folder"), at.alias("started"), (at + F.make_dt_interval(secs=F.get_json_object("props", "$.k").cast("int") - 20)).alias("finished"),
        F.col("value").alias("declared"), F.when(F.col("event_type") == "error", "partial").otherwise("success").alias("status"), F.when(key % 2 == 0, "blocked").alias("reason"),
    )
    return q.reports(rows)


_CHECKS = [name for name in QUERIES if name.startswith("dq_")]
_ALL = " UNION ALL ".join(f'SELECT level, "check", key, message FROM ({ORACLE_SQL[name]})' for name in _CHECKS)


@query(f"SELECT level, \"check\", count(*) AS n, level = 'error' AS fails FROM ({_ALL}) GROUP BY ALL")
def dq_run_all(spark, sf_dir):
    """Every check of this module in one table of findings, counted by level and check."""
    found = q.run_all(*[QUERIES[name](spark, sf_dir) for name in _CHECKS])
    return q.summary(found, by=("check",))
