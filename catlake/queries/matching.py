"""Matching, merging and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.text import fold
from ..operators import match as m
from ..operators.merge import merge_by_key
from ..operators.windows import best_match as best
from ..operators.windows import first_occurrence as first
from .registry import query

_DAY_PLACE = ["day", "place_id"]
_KEYED = """(SELECT CAST(start_at AS DATE) AS day, place_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key, id, status FROM matchable)"""
_SIDE = f"(SELECT day, place_id, title_key, min(id) AS id FROM {_KEYED} WHERE status = '{{}}' GROUP BY ALL)"


def _keyed(spark, sf_dir):
    """Drafts and published orders by their day and place, with folded titles."""
    rows = b.matchable(spark, sf_dir).select("id", F.to_date("start_at").alias("day"), "place_id", fold(F.col("title")).alias("title_key"), "status")
    return tuple(rows.filter(F.col("status") == s).drop("status") for s in ("draft", "published"))


@query(f"SELECT c.id AS c_id, r.id AS r_id, c.title_key AS c_title, r.title_key AS r_title FROM {_SIDE.format('draft')} c JOIN {_SIDE.format('published')} r USING (day, place_id)", "matchable")
def block_pairs(spark, sf_dir):
    """Pairs of the different titles of a day and place; block_members says who each stands for."""
    sides = (m.distinct_titles(rows, _DAY_PLACE) for rows in _keyed(spark, sf_dir))
    return m.salted_pairs(*sides, _DAY_PLACE).select("c_id", "r_id", F.col("c_title_key").alias("c_title"), F.col("r_title_key").alias("r_title"))


@query(f"SELECT status, id, min(id) OVER (PARTITION BY day, place_id, title_key, status) AS representative FROM {_KEYED} WHERE status IN ('draft', 'published')", "matchable")
def block_members(spark, sf_dir):
    """Which row stands for each in block_pairs."""
    drafts, published = (m.title_members(rows, _DAY_PLACE).withColumn("status", F.lit(s)) for rows, s in zip(_keyed(spark, sf_dir), ("draft", "published"), strict=True))
    return drafts.unionByName(published)


_WHOLE = ["lang", "source"]
_LINES = """(SELECT lang, source, title_key, min(id) AS id FROM lines WHERE id % 3 {} 1 GROUP BY ALL)"""


def _rows(spark, sf_dir):
    """The candidates and the records: by thirds of the ids, as the parity of an id settles its source."""
    rows = b.first_lines(spark, sf_dir)
    return rows.filter("id % 3 = 1"), rows.filter("id % 3 <> 1")


def _lines(spark, sf_dir):
    return tuple(m.distinct_titles(rows, _WHOLE) for rows in _rows(spark, sf_dir))


@query("SELECT id, min(id) OVER (PARTITION BY lang, source, title_key, id % 3 = 1) AS representative FROM lines", "lines")
def title_members(spark, sf_dir):
    """Which row stands for each in the pairs of jaro_winkler_lines and block_pairs_all."""
    candidates, records = (m.title_members(rows, _WHOLE) for rows in _rows(spark, sf_dir))
    return candidates.unionByName(records)


@query(f"SELECT c.id AS c_id, r.id AS r_id FROM {_LINES.format('=')} c JOIN {_LINES.format('<>')} r USING (lang, source)", "lines")
def block_pairs_all(spark, sf_dir):
    return m.salted_pairs(*_lines(spark, sf_dir), _WHOLE).select("c_id", "r_id")


@query()
def jaro_winkler_lines(spark, sf_dir):
    return m.title_pairs(*_lines(spark, sf_dir), _WHOLE).withColumn("similarity", F.round("similarity", 6))


def _events(spark, sf_dir):
    """Drafts as candidates, published orders as events."""
    rows = b.matchable(spark, sf_dir)
    return rows.filter("status = 'draft'"), rows.filter("status = 'published'")


@query("SELECT c_id, r_id, round(title, 6) AS similarity FROM scored", "scored")
def jaro_winkler(spark, sf_dir):
    return m.event_pairs(*_events(spark, sf_dir)).select("c_id", "r_id", F.round("title", 6).alias("similarity"))


@query("SELECT event_id AS id, round(greatest(0.0, 1 - abs(extract(hour FROM ts) * 60 + extract(minute FROM ts) - 720) / 180.0), 4) AS similarity FROM events")
def time_similarity(spark, sf_dir):
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(m.time_similarity(F.col("ts").cast("timestamp"), noon), 4).alias("similarity"))


_SCORE = """(SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN round((0.7e0 * t + 0.15e0 * 0.5e0 + 0.15e0 * 0.25e0) / (0.7e0 + 0.15e0 + 0.15e0), 4) ELSE round((0.7e0 * t + 0.15e0 * 0.5e0) / (0.7e0 + 0.15e0), 4) END AS score
    FROM (SELECT event_id, CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) % 101) AS DOUBLE) / 100 AS t FROM events))"""


def _scores(spark, sf_dir):
    t = (F.get_json_object("props", "$.k").cast("int") % 101) / 100
    venue = F.when(F.col("event_id") % 2 == 0, 0.25)
    return b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), m.match_score(t, F.lit(0.5), venue).alias("score"))


@query(f"SELECT id, score, CASE WHEN score >= 0.92 THEN 'auto-merge' WHEN score >= 0.75 THEN 'review' ELSE 'separate' END AS decision FROM {_SCORE}")
def match_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", "score", m.decision(F.col("score")).alias("decision"))


@query("""SELECT user_id AS c_id, arg_min(event_id, (-value, event_id)) AS r_id FROM events GROUP BY user_id""")
def best_match(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("c_id"), F.col("event_id").alias("r_id"), F.col("value").alias("score"))
    return best(rows, "c_id", "score", "r_id").select("c_id", "r_id")


def _line_matches(spark, sf_dir):
    """The decision for every candidate; equal titles are scored once and share it."""
    return m.expand_matches(m.match_candidates(*_lines(spark, sf_dir), _WHOLE), _rows(spark, sf_dir)[0], _WHOLE)


@query()
def match_lines(spark, sf_dir):
    return _line_matches(spark, sf_dir)


@query()
def match_lines_links(spark, sf_dir):
    links, reviews = m.apply_matches(_line_matches(spark, sf_dir))
    known = b.first_lines(spark, sf_dir).filter("id % 10 = 0").select(F.col("id").alias("record"), F.lit(-1).cast("long").alias("candidate"))
    merged = merge_by_key(known, links, ["record", "candidate"], {})
    return merged.select("record", "candidate", F.col("outcome").alias("outcome")).unionByName(reviews.select("record", "candidate", F.lit("queued").alias("outcome")))


@query()
def match_lines_gate(spark, sf_dir):
    return m.review_gate(_line_matches(spark, sf_dir)).select("c_id", "state")


@query()
def match_lines_calibration(spark, sf_dir):
    """How decisions agree with equal titles; ``match_calibration`` has pairs whose truth doesn't come from the score."""
    known = _line_matches(spark, sf_dir).withColumn("same", F.col("title_similarity") == 1.0)
    return known.groupBy("same", "decision").agg(F.count("*").alias("n"))


@query("SELECT * FROM matches", "matches")
def match_candidates(spark, sf_dir):
    return m.match_events(*_events(spark, sf_dir))


_URL = "'https://' || customer || '.example/' || id"
_APPLIED = f"""
    SELECT 'link' AS kind, coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.url, n.url) AS key, CAST(coalesce(o.source_id, n.source_id) AS VARCHAR) AS value, CAST(coalesce(o.first_seen, n.seen) AS VARCHAR) AS first, CAST(coalesce(n.seen, o.last_seen) AS VARCHAR) AS last
    FROM (SELECT r_id AS event_id, {_URL} AS url, CASE WHEN c_id % 3 = 0 THEN c_id END AS source_id, DATE '2024-01-01' AS first_seen, DATE '2024-01-01' AS last_seen FROM matches JOIN matchable ON id = c_id WHERE c_id % 2 = 0) o
    FULL JOIN (SELECT r_id AS event_id, {_URL} AS url, min(customer) AS source_id, DATE '2024-02-01' AS seen FROM matches JOIN matchable ON id = c_id WHERE decision = 'auto-merge' GROUP BY 1, 2) n ON o.event_id = n.event_id AND o.url = n.url
    UNION ALL SELECT 'review', coalesce(o.event_id, n.event_id), CAST(coalesce(o.c_id, n.c_id) AS VARCHAR), CASE WHEN o.c_id IS NULL THEN 'pending' ELSE 'open' END, CAST(coalesce(n.score, o.score) AS VARCHAR), CAST(coalesce(o.created, DATE '2024-02-01') AS VARCHAR)
    FROM (SELECT c_id, r_id AS event_id, 0.5e0 AS score, DATE '2024-01-01' AS created FROM matches WHERE c_id % 5 = 0) o
    FULL JOIN (SELECT c_id, r_id AS event_id, score FROM matches WHERE decision = 'review') n ON o.c_id = n.c_id AND o.event_id = n.event_id
    UNION ALL SELECT 'candidate', CASE decision WHEN 'auto-merge' THEN r_id END, CAST(id AS VARCHAR), CASE decision WHEN 'auto-merge' THEN 'imported' WHEN 'review' THEN 'needs-verification' ELSE 'new' END, NULL, NULL FROM matchable LEFT JOIN matches ON c_id = id WHERE status = 'draft'"""


@query(_APPLIED, "matches")
def apply_matches(spark, sf_dir):
    """The three tables after the matches, one below the other; half of the links and a fifth of the reviews were there before."""
    drafts, events = _events(spark, sf_dir)
    matches = m.match_events(drafts, events)
    url = F.concat(F.lit("https://"), F.col("customer").cast("string"), F.lit(".example/"), F.col("id").cast("string"))
    candidates = drafts.select("id", F.col("customer").alias("source_id"), url.alias("url"), F.lit("new").alias("state"), F.lit(None).cast("long").alias("event_id"))
    day = lambda x: F.lit(x).cast("date")
    known = matches.join(candidates.select(F.col("id").alias("c_id"), "url"), "c_id")
    links = known.filter("c_id % 2 = 0").select(F.col("r_id").alias("event_id"), "url", F.when(F.col("c_id") % 3 == 0, F.col("c_id")).alias("source_id"), day("2024-01-01").alias("first_seen"), day("2024-01-01").alias("last_seen"))
    reviews = matches.filter("c_id % 5 = 0").select(F.col("c_id").alias("candidate_id"), F.col("r_id").alias("event_id"), F.lit(0.5).alias("score"), F.lit("open").alias("state"), day("2024-01-01").alias("created"))
    links, reviews, candidates = m.store_matches(matches, candidates, links, reviews, day("2024-02-01"))
    text = lambda c: F.col(c).cast("string")
    out = links.select(F.lit("link").alias("kind"), "event_id", F.col("url").alias("key"), text("source_id").alias("value"), text("first_seen").alias("first"), text("last_seen").alias("last"))
    out = out.unionByName(reviews.select(F.lit("review").alias("kind"), "event_id", text("candidate_id").alias("key"), F.col("state").alias("value"), text("score").alias("first"), text("created").alias("last")))
    none = F.lit(None).cast("string")
    return out.unionByName(candidates.select(F.lit("candidate").alias("kind"), "event_id", text("id").alias("key"), F.col("state").alias("value"), none.alias("first"), none.alias("last")))


@query("SELECT c_id, CASE decision WHEN 'auto-merge' THEN 'imported' WHEN 'review' THEN 'needs-verification' ELSE 'new' END AS state, count(*) OVER (PARTITION BY decision) AS n FROM matches", "matches")
def match_review_gate(spark, sf_dir):
    """The state of each candidate, and how many have it."""
    states = m.review_gate(m.match_events(*_events(spark, sf_dir))).select("c_id", "state")
    return states.join(F.broadcast(states.groupBy("state").agg(F.count("*").alias("n"))), "state").select("c_id", "state", "n")


@query("""SELECT same, decision, count(*) AS n, CASE WHEN same THEN decision <> 'auto-merge' ELSE decision <> 'separate' END AS wrong
    FROM (SELECT same, CASE WHEN score >= 0.92 THEN 'auto-merge' WHEN score >= 0.75 THEN 'review' ELSE 'separate' END AS decision FROM scored) GROUP BY same, decision""", "scored")
def match_calibration(spark, sf_dir):
    """Pairs of one customer are known positives, the others known negatives; the score sees neither."""
    drafts, events = _events(spark, sf_dir)
    pairs = m.event_pairs(drafts, events, ("customer",))
    return m.calibration(pairs.withColumn("same", F.col("c_customer") == F.col("r_customer")))


@query("SELECT pub.id, min(title) AS title, string_agg(CAST(week_start AS VARCHAR), ',' ORDER BY week_start) AS week_ids FROM wks JOIN pub ON wks.id = pub.id GROUP BY pub.id", "wks")
def merge_copies(spark, sf_dir):
    copies = b.weeks(spark, sf_dir).join(b.published(spark, sf_dir).select("id", "title"), "id")
    return m.merge_copies(copies, "id", "week_start", ["title"])


_FIELDS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_CONFLICTS = f"""(SELECT l_orderkey AS id, concat_ws(',', {', '.join(f"CASE WHEN count(DISTINCT {f}) > 1 THEN '{f}' END" for f in _FIELDS)}) AS fields FROM lineitem GROUP BY 1)"""


@query(f"SELECT * FROM {_CONFLICTS} WHERE fields <> ''")
def identity_conflicts(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    return m.identity_conflicts(lines, "id", _FIELDS)


@query("SELECT CAST(start_day AS VARCHAR) AS start_day, place, price_type, count(DISTINCT id) AS n, min(id) AS first, max(id) AS last FROM pub GROUP BY start_day, place, price_type HAVING count(DISTINCT id) > 1", "pub")
def semantic_duplicates(spark, sf_dir):
    return m.semantic_duplicates(b.published(spark, sf_dir), ["start_day", "place", "price_type"]).withColumn("start_day", F.col("start_day").cast("string"))


@query("SELECT id, twin_of FROM (SELECT id, min(id) OVER (PARTITION BY lower(title), start_day) AS twin_of, count(*) OVER (PARTITION BY lower(title), start_day) AS n FROM pub) WHERE n > 1", "pub")
def twin_titles(spark, sf_dir):
    return m.twin_titles(b.published(spark, sf_dir))


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.state IN ('imported', 'rejected') OR n.id IS NULL THEN o.payload ELSE n.payload END AS payload, coalesce(o.state, 'new') AS state,
      CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL OR o.state IN ('imported', 'rejected') OR o.payload = n.payload THEN 'existing' ELSE 'updated' END AS outcome
    FROM (SELECT o_orderkey AS id, o_orderpriority AS payload, CASE o_orderkey % 4 WHEN 0 THEN 'imported' WHEN 1 THEN 'rejected' ELSE 'new' END AS state FROM orders WHERE o_orderkey % 3 <> 0) o
    FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'x' || o_orderpriority END AS payload FROM orders WHERE o_orderkey % 5 <> 0) n ON o.id = n.id""")
def candidate_merge(spark, sf_dir):
    key, orders = F.col("o_orderkey"), b.table(spark, sf_dir, "orders")
    old = orders.filter(key % 3 != 0).select(key.alias("id"), F.col("o_orderpriority").alias("payload"), F.when(key % 4 == 0, "imported").when(key % 4 == 1, "rejected").otherwise("new").alias("state"))
    new = orders.filter(key % 5 != 0).select(key.alias("id"), F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("x"), "o_orderpriority")).alias("payload"))
    closed = F.col("o.state").isin("imported", "rejected")
    payload = F.when(F.coalesce(closed, F.lit(False)) | F.col("n._new").isNull(), F.col("o.payload")).otherwise(F.col("n.payload"))
    return merge_by_key(old, new, ["id"], {"payload": payload, "state": F.coalesce(F.col("o.state"), F.lit("new"))})


@query("SELECT o_custkey AS key, min(o_orderkey) AS first, count(*) AS occurrences FROM orders GROUP BY 1 HAVING count(*) > 1")
def first_occurrence(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first"))
    return first(orders, "key", "first").filter("occurrences > 1")
