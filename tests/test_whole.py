"""Queries that take their tables whole: what a bound on ids would lose is there, and equals the SQL on larger tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from catlake import bindings
from catlake.functions import text
from catlake.operators import intervals, match, pages
from catlake.queries import ORACLE_SQL, QUERIES
from catlake.sources import files
from tests.test_boundaries import brute_jaro_winkler
from tests.test_queries import TABLES, ordered

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def same(df, duck, name):
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    at = [list(found.columns).index(c) for c in columns]
    rows = df.select(*columns).collect()
    assert ordered(rows) == ordered([tuple(r[i] for i in at) for r in found.fetchall()])
    return rows


@pytest.mark.parametrize(
    ("name", "beyond"),
    [("health_report", "source >= 200"), ("due_sources", "source >= 300"), ("load_candidates", "CAST(record AS LONG) >= 7500")],
)
def test_ids_beyond_the_old_bound(spark, duck, name, beyond):
    df = QUERIES[name](spark, DIR)
    same(df, duck, name)
    assert df.filter(beyond).count() > 0


def test_repairs_of_every_source(spark, duck):
    same(QUERIES["repair_queue"](spark, DIR), duck, "repair_queue")


def test_retries_see_every_event(spark, duck):
    rows = same(QUERIES["stream_retry_queue"](spark, DIR), duck, "stream_retry_queue")
    assert len(rows) == spark.read.parquet(f"{DIR}/events.parquet").agg(F.count_distinct("user_id")).first()[0]


PUBLISHED = ["load_catalog", "jsonld_items", "microdata_items", "card_items", "calendar_feed_items"]


@pytest.mark.parametrize("name", PUBLISHED)
def test_every_published_record(spark, duck, name):
    same(QUERIES[name](spark, DIR), duck, name)


def test_catalogue_files_are_bounded_and_follow_the_manifest(spark, tmp_path):
    day = F.when(F.col("id") % 10 == 0, "2024-01-08").otherwise("2024-01-01")  # one hot week
    rows = spark.range(1000).select(day.alias("week"), F.struct(F.col("id").cast("string").alias("id"), day.alias("week"), F.lit("t").alias("title")).alias("event"))
    files.write_catalog(rows, str(tmp_path), most=50)
    read = files.load_catalog(spark, f"{tmp_path}/weeks", f"{tmp_path}/manifest")
    assert read.groupBy("file").count().agg(F.max("count")).first()[0] <= 50
    for week, n in (("2024-01-01", 900), ("2024-01-08", 100)):
        got = read.filter(F.col("file_week") == week).orderBy("position").select("id", "position").collect()
        assert [r["position"] for r in got] == list(range(n)) and [r["id"] for r in got] == sorted(r["id"] for r in got)
    (tmp_path / "one.json").write_text('{"schema_version": 1,\n "weeks": [{"id": "2024-01-08"}]}')
    assert {r["file_week"] for r in files.load_catalog(spark, f"{tmp_path}/weeks", f"{tmp_path}/one.json").select("file_week").distinct().collect()} == {"2024-01-08"}


@pytest.mark.parametrize("name", ["fold_text", "block_pairs", "block_pairs_all"])
def test_whole_texts(spark, duck, name):
    same(QUERIES[name](spark, DIR), duck, name)


def test_similarity_equals_brute_force():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
    pairs = [(word(x), word(x)) for x in ("abcd ", "abčdž\0", "日本a") for _ in range(300)] + [("martha", "marhta"), ("a", "b"), ("ab", "ba")]
    for x, y in pairs:
        assert abs(text.similarity(x, y) - brute_jaro_winkler(x, y)) < 1e-9, (x, y)


def test_titles_differ_after_forty_letters_and_at_the_first(spark):
    long = "one two three four five six seven eight nine ten "
    rows = [(1, "en", "s", long + "left"), (2, "en", "s", long + "right"), (4, "en", "t", "xbcdefgh"), (5, "en", "t", "abcdefgh")]
    lines = spark.createDataFrame(rows, "id long, lang string, source string, title_key string")
    sides = [match.distinct_titles(lines.filter(f"id % 3 {x} 1"), ["lang", "source"]) for x in ("=", "<>")]
    got = {r["c_id"]: (r["r_id"], r["title_similarity"]) for r in match.match_candidates(*sides, ["lang", "source"]).collect()}
    assert got[1][0] == 2 and got[1][1] < 1 and got[4][0] == 5


def test_hot_blocks_are_split_without_loss(spark):
    side = lambda start, n: spark.range(start, start + n).select("id", F.lit("en").alias("lang"), F.col("id").cast("string").alias("title_key"))
    pairs = match.salted_pairs(side(0, 450), side(1000, 20), ["lang"], most=50)
    assert pairs.count() == pairs.distinct().count() == 450 * 20


def test_every_row_of_a_shared_title_is_matched(spark):
    title = F.when(F.col("id") < 300, "a shared title").otherwise(F.concat(F.lit("another "), "id"))
    rows = spark.range(330).select("id", F.lit("en").alias("lang"), F.lit("s").alias("source"), title.alias("title_key"))
    sides = rows.filter("id % 3 = 1"), rows.filter("id % 3 <> 1")
    block = ["lang", "source"]
    matches = match.expand_matches(match.match_candidates(*(match.distinct_titles(x, block) for x in sides), block), sides[0], block)
    links = match.apply_matches(matches)[0].filter("record = 0")
    assert matches.count() == matches.select("c_id").distinct().count() == 110 and links.count() == 100


def test_calibration_counts_every_candidate(spark, duck):
    same(QUERIES["title_members"](spark, DIR), duck, "title_members")
    lines = bindings.first_lines(spark, DIR)
    records = lines.filter("id % 3 <> 1").select("lang", "source").distinct()
    n = lines.filter("id % 3 = 1").join(records, ["lang", "source"], "left_semi").count()
    assert QUERIES["match_lines_calibration"](spark, DIR).agg(F.sum("n")).first()[0] == QUERIES["match_lines_gate"](spark, DIR).count() == n


def test_each_automatic_match_is_a_link(spark):
    links = QUERIES["match_lines_links"](spark, DIR).filter("outcome = 'created'")
    assert links.count() == QUERIES["match_lines"](spark, DIR).filter("decision = 'auto-merge'").count()


@pytest.mark.parametrize("name", ["health_listing_order", "review_priority", "catalog_order"])
def test_every_row_has_its_place(spark, duck, name):
    same(QUERIES[name](spark, DIR), duck, name)


def test_long_records_keep_their_days_and_weeks(spark):
    rows = spark.sql("SELECT 1 AS id, DATE'2020-01-01' AS start_day, DATE'2024-01-03' AS end_day")
    week = intervals.calendar_days(rows, F.lit("2024-01-01").cast("date"), spark.range(1)).orderBy("day").collect()
    assert [r["role"] for r in week] == ["continues", "continues", "ends", None, None, None, None]
    assert intervals.explode_days(rows).count() == 1464 and intervals.explode_weeks(rows).count() == 210


def test_a_short_page_with_one_event_is_judged(spark):
    event = '<html><title>t</title><script type="application/ld+json">{"@type": "MusicEvent", "startDate": "2026-05-01"}</script><p>short</p></html>'
    page = spark.createDataFrame([(1, "https://a.example/x", event), (2, "https://a.example/y", "<p>short</p>")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["kind"] for r in pages.classify(pages.signals(page)).collect()}
    assert kinds == {1: "event-detail", 2: "unknown"}
