"""Run history, health and absence over the history view."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import health as h
from ..operators import reports
from ..operators.windows import latest_per_key, placed
from .registry import query

_NOW = "2024-02-01 00:00:00"
_H = "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, id DESC) AS n FROM runs)"
_SIG = f"""(SELECT source, count(*) AS runs, max(fetched_at) AS checked_at, coalesce(min(CASE WHEN ok THEN n END) - 1, max(n)) AS failures,
      max(CASE WHEN ok THEN fetched_at END) AS last_success_at, max(CASE WHEN items > 0 THEN fetched_at END) AS last_item_at,
      max(CASE WHEN n = 1 THEN items END) AS items, median(CASE WHEN k <= 10 THEN items END) AS baseline,
      median(CASE WHEN k <= 10 THEN title_fill END) AS base_fill, max(CASE WHEN n = 1 THEN title_fill END) AS now_fill,
      sum(CASE WHEN other = 0 AND hash IS NOT NULL THEN 1 ELSE 0 END) AS unchanged_runs,
      CASE WHEN sum(CASE WHEN other = 0 AND hash IS NOT NULL THEN 1 ELSE 0 END) >= 2 THEN
        floor((epoch(date_trunc('second', max(CASE WHEN other = 0 THEN fetched_at END))) - epoch(date_trunc('second', min(CASE WHEN other = 0 THEN fetched_at END)))) / 86400) END AS unchanged_days
    FROM (SELECT *, CASE WHEN n > 1 AND items > 0 THEN sum(CASE WHEN n > 1 AND items > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) END AS k,
            max(CASE WHEN hash IS DISTINCT FROM newest THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS other
          FROM (SELECT *, first_value(hash) OVER (PARTITION BY source ORDER BY n) AS newest FROM {_H} WHERE n <= 60)) GROUP BY source)"""
_STATE = f"""(SELECT *, CASE WHEN failures >= 3 THEN 'broken' WHEN baseline >= 3 AND items = 0 THEN 'suspect' WHEN baseline >= 3 AND items < 0.4 * baseline THEN 'degraded'
      WHEN items > 0 AND base_fill > 0 AND now_fill < 0.8 * base_fill THEN 'schema-drift'
      WHEN unchanged_days > 30 AND source NOT IN (SELECT s_suppkey FROM supplier) THEN 'stale' ELSE 'healthy' END AS state FROM {_SIG})"""


def _signals(spark, sf_dir):
    return h.signals(b.runs(spark, sf_dir), ["title_fill"])


def _health(spark, sf_dir):
    future = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    return h.source_health(b.runs(spark, sf_dir), ["title_fill"], future)


@query(f"SELECT source, id, n FROM {_H} WHERE n <= 60", "runs")
def run_history(spark, sf_dir):
    return h.run_history(b.runs(spark, sf_dir)).select("source", "id", F.col("n").cast("long").alias("n"))


@query("SELECT event_id AS id, event_type <> 'error' AS ok FROM events")
def fetch_ok(spark, sf_dir):
    return b.runs(spark, sf_dir).select("id", h.fetch_ok(F.col("status"), F.lit(None).cast("string")).alias("ok"))


@query(f"SELECT source, failures FROM {_SIG}", "runs")
def failure_streak(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", "failures")


@query(f"SELECT source, CAST(unchanged_runs AS BIGINT) AS unchanged_runs, CAST(unchanged_days AS BIGINT) AS unchanged_days FROM {_SIG}", "runs")
def unchanged_streak(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", "unchanged_runs", "unchanged_days")


@query(f"SELECT source, strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(last_item_at, '%Y-%m-%d %H:%M:%S') AS last_item_at FROM {_SIG}", "runs")
def last_success_at(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_success_at", "last_item_at")])


@query("SELECT source, strftime(max(CASE WHEN items > 0 THEN fetched_at END), '%Y-%m-%d %H:%M:%S') AS last_item_at FROM runs GROUP BY source", "runs")
def last_item_at(spark, sf_dir):
    newest = F.max(F.when(F.col("items") > 0, F.col("fetched_at")))
    return b.runs(spark, sf_dir).groupBy("source").agg(F.date_format(newest, "yyyy-MM-dd HH:mm:ss").alias("last_item_at"))


@query(f"SELECT source, CAST(baseline AS DOUBLE) AS baseline FROM {_SIG}", "runs")
def baseline_median(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", "baseline")


@query(f"SELECT source, CAST(base_fill AS DOUBLE) AS base_fill FROM {_SIG}", "runs")
def baseline_fill_median(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", F.col("base_title_fill").alias("base_fill"))


@query(f"SELECT source, coalesce(items > 0 AND base_fill > 0 AND now_fill < 0.8 * base_fill, false) AS drifted FROM {_SIG}", "runs")
def schema_drift(spark, sf_dir):
    return _signals(spark, sf_dir).select("source", (F.size("drifted") > 0).alias("drifted"))


@query("""SELECT s_suppkey AS source, coalesce(max(coalesce(end_day, start_day)) >= DATE '2001-07-20', false) AS future FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN catalog ON id = l_orderkey AND status <> 'archived' GROUP BY 1""", "catalog")
def future_flag(spark, sf_dir):
    live = b.catalog(spark, sf_dir).filter("status <> 'archived'").select("id", F.coalesce("end_day", "start_day").alias("day"))
    links = b.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").join(live, F.col("l_orderkey") == F.col("id"))
    last = links.groupBy(F.col("l_suppkey").alias("source")).agg(F.max("day").alias("day"))
    sources = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    return sources.join(last, "source", "left").select("source", F.coalesce(F.col("day") >= F.lit(datetime.date(2001, 7, 20)), F.lit(False)).alias("future"))


_REASON = """CASE state WHEN 'broken' THEN failures || ' failed attempts in a row' WHEN 'suspect' THEN 'no items, usually ' || CAST(round(baseline) AS BIGINT)
      WHEN 'degraded' THEN items || ' items, usually ' || CAST(round(baseline) AS BIGINT) WHEN 'schema-drift' THEN 'fields filled less than usual: title_fill'
      WHEN 'stale' THEN 'unchanged for ' || CAST(unchanged_days AS BIGINT) || ' days, nothing ahead' END"""


@query(f"SELECT source, state, {_REASON} AS reason FROM {_STATE}", "runs")
def health_decide(spark, sf_dir):
    return _health(spark, sf_dir).select("source", "state", "reason")


_SEEDED = f"""(SELECT coalesce(g.source, s.source) AS source, coalesce(runs, 0) AS runs, failures, items, coalesce(g.baseline, s.seed) AS baseline, base_fill, now_fill, unchanged_days
      FROM {_SIG} g FULL JOIN (SELECT c_custkey * 2 AS source, CAST(c_custkey % 9 AS DOUBLE) AS seed FROM customer) s ON g.source = s.source)"""


@query(f"""SELECT source, runs, CAST(baseline AS DOUBLE) AS baseline, CASE WHEN runs = 0 THEN 'healthy' WHEN failures >= 3 THEN 'broken' WHEN baseline >= 3 AND items = 0 THEN 'suspect' WHEN baseline >= 3 AND items < 0.4 * baseline THEN 'degraded'
      WHEN items > 0 AND base_fill > 0 AND now_fill < 0.8 * base_fill THEN 'schema-drift' WHEN unchanged_days > 30 AND source NOT IN (SELECT s_suppkey FROM supplier) THEN 'stale' ELSE 'healthy' END AS state FROM {_SEEDED}""", "runs")
def source_health_seeded(spark, sf_dir):
    """Sources whose history has no baseline take a seeded one."""
    future = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    seeds = b.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("source"), (F.col("c_custkey") % 9).cast("double").alias("baseline"))
    return h.source_health(b.runs(spark, sf_dir), ["title_fill"], future, seeds).select("source", "runs", "baseline", "state")


@query(f"SELECT source, runs, failures, items, CAST(baseline AS DOUBLE) AS baseline, CAST(unchanged_runs AS BIGINT) AS unchanged_runs, state, source IN (SELECT s_suppkey FROM supplier) AS future FROM {_STATE}", "runs")
def source_health(spark, sf_dir):
    return _health(spark, sf_dir).select("source", "runs", "failures", "items", "baseline", "unchanged_runs", "state", "future")


_STORED = "(SELECT c_custkey AS source, CASE WHEN c_custkey % 3 = 0 THEN 'healthy' ELSE 'broken' END AS state, CASE WHEN c_custkey % 3 = 1 THEN '2024-01-01' END AS first_alerted_at, CAST(2.0 AS DOUBLE) AS baseline FROM customer)"


def _stored(spark, sf_dir):
    key = F.col("c_custkey")
    empty = F.lit(None).cast("timestamp")
    return b.table(spark, sf_dir, "customer").select(
        key.alias("source"), F.when(key % 3 == 0, "healthy").otherwise("broken").alias("state"),
        empty.alias("last_success_at"), empty.alias("last_item_at"), F.lit(2.0).alias("baseline"), F.when(key % 3 == 1, "2024-01-01").alias("first_alerted_at"),
    )


@query(f"""SELECT coalesce(o.source, n.source) AS source, coalesce(n.state, o.state) AS state, CAST(coalesce(n.baseline, o.baseline) AS DOUBLE) AS baseline,
      CASE WHEN n.source IS NULL THEN o.first_alerted_at WHEN n.state = 'healthy' THEN NULL WHEN o.first_alerted_at IS NULL OR o.state = 'healthy' THEN '2024-02-01' ELSE o.first_alerted_at END AS first_alerted_at,
      CASE WHEN o.source IS NULL THEN 'created' WHEN n.source IS NULL THEN 'existing' ELSE 'updated' END AS outcome
    FROM {_STORED} o FULL JOIN {_STATE} n ON o.source = n.source""", "runs")
def health_upsert(spark, sf_dir):
    return h.health_upsert(_stored(spark, sf_dir), _health(spark, sf_dir), F.lit("2024-02-01")).select("source", "state", "baseline", "first_alerted_at", "outcome")


@query(f"""SELECT n.source, CASE WHEN n.state = 'healthy' THEN NULL WHEN o.first_alerted_at IS NULL OR o.state = 'healthy' THEN '2024-02-01' ELSE o.first_alerted_at END AS first_alerted_at
    FROM {_STATE} n LEFT JOIN {_STORED} o ON o.source = n.source""", "runs")
def first_alerted_at(spark, sf_dir):
    return h.health_upsert(_stored(spark, sf_dir), _health(spark, sf_dir), F.lit("2024-02-01")).join(_health(spark, sf_dir).select("source"), "source", "left_semi").select("source", "first_alerted_at")


_REPORT = f"""(SELECT c_custkey AS source, coalesce(state, 'unchecked') AS state,
      CAST(floor((epoch(TIMESTAMP '{_NOW}') - epoch(date_trunc('second', last_item_at))) / 86400) AS BIGINT) AS days_since_item,
      CAST(floor((epoch(TIMESTAMP '{_NOW}') - epoch(date_trunc('second', checked_at))) / 86400) AS BIGINT) AS days_since_check,
      coalesce(floor((epoch(TIMESTAMP '{_NOW}') - epoch(date_trunc('second', checked_at))) / 86400) > 2 * (c_custkey % 2), false) AS overdue
    FROM customer LEFT JOIN {_STATE} ON source = c_custkey)"""


def _report(spark, sf_dir):
    sources = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 2).alias("interval"))
    return h.health_report(sources, _health(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


_SEVERITY = "CASE state WHEN 'broken' THEN 1 WHEN 'suspect' THEN 2 WHEN 'degraded' THEN 3 WHEN 'schema-drift' THEN 4 WHEN 'stale' THEN 5 WHEN 'healthy' THEN 6 ELSE 7 END"


@query(f"SELECT *, row_number() OVER (ORDER BY {_SEVERITY}, days_since_item DESC NULLS LAST, source) AS place_in_order FROM {_REPORT}", "runs")
def health_report(spark, sf_dir):
    return placed(_report(spark, sf_dir), h.severity(F.col("state")), F.desc_nulls_last("days_since_item"), "source")



@query(f"SELECT source, state, days_since_item FROM {_REPORT} WHERE state NOT IN ('healthy', 'unchecked')", "runs")
def repair_queue(spark, sf_dir):
    return h.repair_queue(_report(spark, sf_dir)).select("source", "state", "days_since_item")



@query("SELECT row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS place_in_order, o_orderkey AS id, o_orderpriority AS priority FROM orders")
def health_listing_order(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return placed(rows, (F.col("priority") != "1-URGENT"), "id")



_SEEDS = "(SELECT s_suppkey * 3 AS source, CASE WHEN s_acctbal > 0 THEN '2023-12-31' END AS first_alerted_at, CAST(s_nationkey AS DOUBLE) AS baseline FROM supplier)"


@query(f"""SELECT source, coalesce(o.first_alerted_at, n.first_alerted_at) AS first_alerted_at, coalesce(o.baseline, n.baseline) AS baseline, source NOT IN (SELECT c_custkey FROM customer) AS skipped
    FROM (SELECT source, first_alerted_at, CASE WHEN source % 2 = 0 THEN baseline END AS baseline FROM {_STORED}) o FULL JOIN {_SEEDS} n USING (source)""")
def seed_state(spark, sf_dir):
    seeds = b.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 3).alias("source"), F.when(F.col("s_acctbal") > 0, "2023-12-31").alias("first_alerted_at"), F.col("s_nationkey").cast("double").alias("baseline")
    )
    stored = _stored(spark, sf_dir).select("source", "first_alerted_at", F.when(F.col("source") % 2 == 0, F.col("baseline")).alias("baseline"))
    return h.seed_state(stored, seeds, ["first_alerted_at", "baseline"])


_LINKS = "(SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber AS item, CAST(l_shipdate AS DATE) AS day, l_orderkey % 4 AS missing FROM lineitem)"
_WINDOW = f"(SELECT source, max(CASE WHEN missing = 0 THEN day END) AS last FROM {_LINKS} GROUP BY source HAVING max(CASE WHEN missing = 0 THEN day END) >= DATE '2000-06-01')"


def _links(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") % 4).alias("missing")
    )


@query(f"SELECT source, '2000-06-01' AS first, CAST(last AS VARCHAR) AS last FROM {_WINDOW}")
def fetched_window(spark, sf_dir):
    return h.fetched_window(_links(spark, sf_dir), F.lit(datetime.date(2000, 6, 1))).select("source", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query(f"""SELECT source, item, missing, reason, reason = 'cancelled' AS cancelled FROM (
      SELECT l.*, CASE WHEN st.state IS DISTINCT FROM 'healthy' THEN 'source-unhealthy' WHEN w.last IS NULL THEN 'no-window' WHEN NOT (day BETWEEN DATE '2000-06-01' AND w.last) THEN 'outside-window'
        WHEN missing < 2 THEN 'too-few-absences' ELSE 'cancelled' END AS reason
      FROM {_LINKS} l LEFT JOIN {_STATE} st ON st.source = l.source LEFT JOIN {_WINDOW} w ON w.source = l.source WHERE missing > 0)""", "runs")
def derive_cancellations(spark, sf_dir):
    return h.derive_cancellations(_links(spark, sf_dir), _health(spark, sf_dir), F.lit(datetime.date(2000, 6, 1)))


@query("""SELECT source, item, CAST(sum(CASE WHEN healthy AND NOT seen AND id > coalesce(last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS missing
    FROM (SELECT *, max(CASE WHEN seen AND healthy THEN id END) OVER (PARTITION BY source, item) AS last FROM
      (SELECT user_id AS source, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS item, event_id AS id, event_type IN ('view', 'click') AS seen, event_type <> 'error' AS healthy FROM events)) GROUP BY source, item""")
def missing_runs(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("item"), F.col("event_id").alias("id"),
        F.col("event_type").isin("view", "click").alias("seen"), (F.col("event_type") != "error").alias("healthy"),
    )
    return h.missing_runs(rows)


_DUE = f"""SELECT c_custkey AS source FROM customer LEFT JOIN (SELECT source, max(fetched_at) AS last FROM runs GROUP BY source) ON source = c_custkey
    WHERE c_acctbal > 0 AND (last IS NULL OR floor(epoch(last)) + (c_custkey % 5) * 86400 <= epoch(TIMESTAMP '{_NOW}'))"""


@query(_DUE, "runs")
def due_sources(spark, sf_dir):
    sources = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 5).alias("interval"), (F.col("c_acctbal") > 0).alias("enabled"))
    return h.due_sources(sources, b.runs(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("source")



@query("""SELECT source, arg_max(id, (epoch(fetched_at), id)) AS id FROM runs WHERE ok AND items > 0 GROUP BY source""", "runs")
def last_good_reference(spark, sf_dir):
    good = b.runs(spark, sf_dir).filter("ok AND items > 0").select("source", "fetched_at", "id")
    return latest_per_key(good, "source", "fetched_at", "id").select("source", "id")


@query("""SELECT id, change, CASE WHEN change = 'changed' THEN fields END AS fields FROM (SELECT coalesce(o.id, n.id) AS id,
      concat_ws(',', CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END, CASE WHEN o.price IS DISTINCT FROM n.price THEN 'price' END) AS fields,
      CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.status IS DISTINCT FROM n.status OR o.price IS DISTINCT FROM n.price THEN 'changed' END AS change
    FROM (SELECT o_orderkey AS id, o_orderstatus AS status, floor(o_totalprice / 1000) AS price FROM orders WHERE o_orderkey % 7 <> 0) o
    FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status, floor((o_totalprice + o_orderkey % 13) / 1000) AS price FROM orders WHERE o_orderkey % 5 <> 0) n ON o.id = n.id) WHERE change IS NOT NULL""")
def output_diff(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = b.table(spark, sf_dir, "orders")
    old = orders.filter(key % 7 != 0).select(key.alias("id"), F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 1000).alias("price"))
    new = orders.filter(key % 5 != 0).select(key.alias("id"), F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.floor((F.col("o_totalprice") + key % 13) / 1000).alias("price"))
    return h.output_diff(old, new, "id", ["status", "price"])


@query(f"""SELECT source, CASE WHEN source % 10 = 9 THEN 'code-regression' WHEN source % 10 = 8 THEN 'source-change' WHEN failures > 0 AND state = 'broken' THEN 'source-access-failure' WHEN failures > 0 THEN 'transient-fetch-failure'
      WHEN state IN ('suspect', 'degraded', 'schema-drift') THEN 'source-change' WHEN state = 'stale' THEN 'source-content-stale' ELSE 'healthy' END AS kind FROM {_STATE}""", "runs")
def drift_classify(spark, sf_dir):
    key = F.col("source")
    return _health(spark, sf_dir).select("source", h.drift_classify(key % 10 != 9, key % 10 == 8, F.col("failures") == 0, F.col("state")).alias("kind"))


@query("SELECT field, kinds, round(fill, 4) AS fill FROM (SELECT 'props' AS field, 'text' AS kinds, avg(CASE WHEN props IS NOT NULL AND props <> '' THEN 1.0 ELSE 0.0 END) AS fill FROM events UNION ALL SELECT 'ts', 'date', avg(CASE WHEN ts IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM events UNION ALL SELECT 'user_id', 'integer', avg(CASE WHEN user_id IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM events)")
def shape_profile(spark, sf_dir):
    return reports.shape_profile(b.table(spark, sf_dir, "events"), ["props", "ts", "user_id"])


_KIND_OF = "CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^-?[0-9]+\\.[0-9]+$') THEN 'number' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END"
_PROFILE = "SELECT {0} AS source, '{1}' AS field, list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL)) AS kinds, round(avg(CASE WHEN v IS NOT NULL AND v <> '' THEN 1.0 ELSE 0.0 END), 4) AS fill FROM (SELECT *, {2} AS kind FROM (SELECT *, {3} AS v FROM events)) GROUP BY 1, 2"
_SHAPES = {
    "e": {"n": "CAST(user_id AS VARCHAR)", "day": "CAST(CAST(ts AS DATE) AS VARCHAR)", "props": "CASE WHEN event_id % 2 = 0 THEN props END", "v": "CASE WHEN user_id % 3 <> 0 THEN 'x' END"},
    "c": {"n": "CASE WHEN event_id % 3 = 0 THEN 'no ' || user_id END", "props": "CASE WHEN event_id % 10 = 0 THEN props END", "v": "CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END"},
}


def _shape_sql(side):
    return "(" + " UNION ALL ".join(_PROFILE.format("user_id % 7", name, _KIND_OF, value) for name, value in _SHAPES[side].items()) + ")"


@query(f"""SELECT source, field, unnest(issues) AS issue FROM (SELECT coalesce(e.source, c.source) AS source, coalesce(e.field, c.field) AS field, list_filter([
      CASE WHEN c.field IS NULL OR (c.fill = 0 AND e.fill > 0) THEN 'missing-field' END,
      CASE WHEN len(e.kinds) > 0 AND len(c.kinds) > 0 AND len(list_filter(c.kinds, lambda k: NOT list_contains(e.kinds, k))) > 0 THEN 'incompatible-kinds' END,
      CASE WHEN e.fill > 0 AND c.fill < 0.8 * e.fill THEN 'fill-rate-drop' END], lambda x: x IS NOT NULL) AS issues
    FROM {_shape_sql("e")} e FULL JOIN {_shape_sql("c")} c ON e.source = c.source AND e.field = c.field)""")
def structure_compare(spark, sf_dir):
    """Expected and current shapes of each of seven sources."""
    events, source = b.table(spark, sf_dir, "events"), (F.col("user_id") % 7).alias("source")
    was = events.select(
        source, F.col("user_id").alias("n"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"), F.when(F.col("user_id") % 3 != 0, "x").alias("v")
    )
    now = events.select(
        source, F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no "), F.col("user_id"))).alias("n"), F.when(F.col("event_id") % 10 == 0, F.col("props")).alias("props"),
        F.when(F.col("user_id") % 2 == 0, F.col("event_id").cast("string")).alias("v"),
    )
    return h.structure_compare(reports.shape_profile(was, ["n", "day", "props", "v"], "source"), reports.shape_profile(now, ["n", "props", "v"], "source"), "source")


@query("""SELECT source, count(*) AS found, CAST(sum(CASE WHEN items > 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN coalesce(items, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
      CAST(sum(CASE WHEN items IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unparsed, CAST(sum(CASE WHEN items > 4 THEN items - 4 ELSE 0 END) AS BIGINT) AS rejected_categories FROM runs GROUP BY source""", "runs")
def extract_metrics(spark, sf_dir):
    values = F.when(F.col("items") > 4, F.sequence(F.lit(5), F.col("items").cast("int"))).otherwise(F.array().cast("array<int>"))
    items = b.runs(spark, sf_dir).select("source", F.col("items").isNotNull().alias("parsed"), (F.coalesce("items", F.lit(0)) > 0).alias("valid"), values.alias("rejected_values"))
    return reports.extract_metrics(items, "source")


_BATCH = """(SELECT CAST(CAST(fetched_at AS DATE) AS VARCHAR) AS day, count(*) AS attempts, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed,
      CAST(coalesce(sum(items), 0) AS BIGINT) AS items, count(DISTINCT source) AS sources, CAST(sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) AS BIGINT) AS changed,
      array_to_string(list_sort(list(DISTINCT source % 5)), ',') AS places, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE ok)), ','), '') AS covered,
      coalesce(string_agg(source || ':' || status, ',' ORDER BY source, id) FILTER (WHERE NOT ok), '') AS errors FROM runs GROUP BY 1)"""


def _batches(spark, sf_dir):
    outcomes = b.runs(spark, sf_dir).select(
        F.to_date("fetched_at").cast("string").alias("day"), "source", "id", (F.col("source") % 5).alias("place"), "ok", (F.col("status") == 200).alias("changed"), "items",
        F.when(~F.col("ok"), F.col("status").cast("string")).alias("error"),
    )
    return reports.batch_report(outcomes, "day")


@query(f"SELECT * FROM {_BATCH}", "runs")
def batch_report(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["source"].cast("string"), e["error"])), ",").alias("errors")
    return _batches(spark, sf_dir).select("day", "attempts", "ok", "failed", "items", "sources", "changed", joined("places"), joined("covered"), errors)


@query(f"SELECT day, CASE WHEN failed > 0 AND ok = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' WHEN changed = 0 THEN 'no-change' ELSE 'success' END AS status FROM {_BATCH}", "runs")
def batch_status(spark, sf_dir):
    return _batches(spark, sf_dir).select("day", reports.batch_status(F.col("ok"), F.col("failed"), F.col("changed")).alias("status"))


@query("""SELECT event_id AS id FROM events WHERE event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 < 3 ORDER BY event_id LIMIT 50""")
def pending_batch(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "new").otherwise("failed").alias("state"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("attempts"))
    return rows.filter("state = 'new' AND attempts < 3").select("id").orderBy("id").limit(50)


_PLAN = """(SELECT c_custkey AS place, CAST(c_custkey % 3 + 1 AS INTEGER) AS tier, c_nationkey AS district, n_regionkey AS region, c_custkey % 17 + 1 AS queries, c_custkey % 11 AS candidates, CAST(c_custkey % 4 = 0 AS BIGINT) AS new_sources,
      round(0.40 * ((c_custkey * 7) % 100) / 100.0 + 0.20 * ((c_custkey * 13) % 100) / 100.0 + 0.15 * (c_nationkey / 25.0) + 0.15 * (c_custkey % 2) + 0.10 * (c_custkey % 5) / 5.0, 6) AS priority FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_LIMITS = h.Limits(places=30, queries=120, candidates=70, new_sources=5, districts=7)
_RANKED = f"""(SELECT *, row_number() OVER (ORDER BY ahead, priority DESC, place) AS r FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY priority DESC, place) = 1 THEN 0
      WHEN place IN (SELECT arg_min(place, (-priority, place)) AS best FROM {_PLAN} GROUP BY district ORDER BY max(priority) DESC, district LIMIT {_LIMITS.districts}) THEN 1 ELSE 2 END AS ahead FROM {_PLAN}))"""


@query(f"""SELECT place, tier, district, region, queries, priority, CAST({_LIMITS.queries} - q AS BIGINT) AS spent FROM (
    WITH RECURSIVE ranked AS MATERIALIZED (SELECT * FROM {_RANKED}), plan AS (
      SELECT CAST(NULL AS BIGINT) AS place, CAST(0 AS INTEGER) AS tier, CAST(NULL AS BIGINT) AS district, CAST(NULL AS BIGINT) AS region, CAST(0 AS BIGINT) AS queries, CAST(0 AS DOUBLE) AS priority, CAST(0 AS BIGINT) AS r,
             CAST({_LIMITS.queries} AS BIGINT) AS q, CAST({_LIMITS.candidates} AS BIGINT) AS c, CAST({_LIMITS.new_sources} AS BIGINT) AS s, [11, 11, 9] AS quota, 0 AS n
      UNION ALL
      SELECT b.place, b.tier, b.district, b.region, b.queries, b.priority, b.r, q - b.queries, c - b.candidates, s - b.new_sources,
             [quota[1] - CAST(b.tier = 1 AS INTEGER), quota[2] - CAST(b.tier = 2 AS INTEGER), quota[3] - CAST(b.tier = 3 AS INTEGER)], n + 1
      FROM (SELECT p.q, p.c, p.s, p.quota, p.n, arg_min({{'place': k.place, 'tier': k.tier, 'district': k.district, 'region': k.region, 'queries': k.queries, 'candidates': k.candidates, 'new_sources': k.new_sources, 'priority': k.priority, 'r': k.r}}, k.r) AS b
            FROM plan p JOIN ranked k ON k.r > p.r AND k.queries <= p.q AND k.candidates <= p.c AND k.new_sources <= p.s AND p.quota[k.tier] > 0 WHERE p.n < {_LIMITS.places} GROUP BY ALL))
    SELECT * FROM plan WHERE n > 0)""")
def plan_batch(spark, sf_dir):
    key = F.col("c_custkey")
    nation = b.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    places = b.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("place"), (key % 3 + 1).cast("int").alias("tier"), F.col("c_nationkey").alias("district"), "region", (key % 17 + 1).alias("queries"), (key % 11).alias("candidates"),
        (key % 4 == 0).cast("long").alias("new_sources"), ((key * 7) % 100 / 100).alias("days_since_check"), ((key * 13) % 100 / 100).alias("event_yield"), (F.col("c_nationkey") / 25).alias("season"), (key % 2).alias("gap"), (key % 5 / 5).alias("new_source"),
    )
    return h.plan_batch(places, _LIMITS).select("place", "tier", "district", "region", "queries", "priority", "spent")
