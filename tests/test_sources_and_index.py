"""The stored index, trees of reports, feeds, dictionaries and contents."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from catlake.operators import quality, search
from catlake.sources import files


def test_index_reads_ranges_of_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Café Nové", "x"), (2, "cafeteria", None), (3, None, "nové caf"), (4, "cab nov", "y"), (4, "café", "novinka")], "id long, text string, more string")
    search.write_index(rows, "id", f"{tmp_path}/index", "text", "more")
    index = spark.read.parquet(f"{tmp_path}/index")
    for text in ("CAFÉ", "café nov", "nov caf ca", "ca", " ! ", "zzz", "caf\u00e9 caf"):
        found = search.search_index(index, "id", text)
        assert sorted(r["id"] for r in found.collect()) == sorted({r["id"] for r in search.fulltext_prefix(rows, "id", text, "text", "more").collect()}), text
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = search.search_index(index, "id", "café nov")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(x in pushed for x in ("GreaterThanOrEqual(token,cafe)", "LessThan(token,caff)", "GreaterThanOrEqual(token,nov)", "LessThan(token,now)"))


def report(tmp_path, place, run_id, agent):
    path = tmp_path / place
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"run_id": run_id, "agent": agent, "metrics": {"found": "1"}}))


def test_reports_lie_where_they_belong(spark, tmp_path):
    report(tmp_path, "curator/2026-08/2026-08-02-1736-curator.json", "2026-08-02-1736-curator", "curator")
    report(tmp_path, "curator/2026-07/2026-08-02-2021-curator.json", "2026-08-02-2021-curator", "curator")
    report(tmp_path, "quality/2026-08/2026-08-01-1925-quality.json", "2026-08-01-1925-quality", "planner")
    report(tmp_path, "quality/2026-08/other.json", "2026-08-01-1930-quality", "quality")
    report(tmp_path, "stray.json", "2026-08-01-1940-quality", "quality")
    (tmp_path / "quality/2026-08/broken.json").write_text("{no json")
    loaded = files.load_reports(spark, str(tmp_path))
    assert {r["file"] for r in loaded.collect()} == {p.name for p in tmp_path.rglob("*.json")}
    found = {(r["key"], r["message"]) for r in quality.report_files(loaded).collect()}
    assert found == {
        ("2026-08-02-2021-curator", "other-month"), ("2026-08-01-1925-quality", "other-agent"), ("2026-08-01-1930-quality", "other-name"), ("2026-08-01-1940-quality", "outside-tree"), ("broken.json", "unreadable"),
    }


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_feeds(spark, zone):
    day, at = datetime.date(2026, 5, 1), "2026-05-01T18:30:00+02:00"
    rows = spark.createDataFrame([(1, "a,b;c\\d\ne", day, None, None, None), (2, "t", day, None, at, None), (3, "t", day, day, at, "2026-05-02T00:30:00+02:00")], "id long, title string, start_day date, end_day date, s string, e string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        found = {r["id"]: r for r in files.feed_rows(rows.withColumns({"start_at": F.to_timestamp("s"), "end_at": F.to_timestamp("e")})).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[1]["calendar"].split("\r\n")[1:5] == ["UID:1", "SUMMARY:a\\,b\\;c\\\\d\\ne", "DTSTART;VALUE=DATE:20260501", "DTEND;VALUE=DATE:20260502"]
    assert found[2]["calendar"].split("\r\n")[3:5] == ["DTSTART:20260501T163000Z", "DTEND:20260501T183000Z"]
    assert found[3]["calendar"].split("\r\n")[4] == "DTEND:20260501T223000Z"
    assert json.loads(found[2]["data"]) == {"@type": "Event", "name": "t", "startDate": "2026-05-01T16:30:00Z", "endDate": "2026-05-01T18:30:00Z"}


def test_a_name_of_two_categories_fails(spark):
    schema = "category string, axis string, order int, label string, aliases array<string>"
    rows = [("music", "kind", 1, "Music", ["Gig", "concert"]), ("film", "kind", 2, "Film", None)]
    got = {r["norm_key"]: (r["category"], r["order"], r["search_terms"]) for r in files.load_dictionary(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"music": ("music", 1, ["Gig", "Music", "concert"]), "gig": ("music", 1, ["Gig", "Music", "concert"]), "concert": ("music", 1, ["Gig", "Music", "concert"]), "film": ("film", 2, ["Film"])}
    twice = spark.createDataFrame([*rows, ("show", "kind", 3, "Show", ["GIG"])], schema)
    with pytest.raises(ValueError, match="gig"):
        files.load_dictionary(twice)
    assert {r["norm_key"]: r["targets"] for r in files.load_dictionary(twice, strict=False).collect()}["gig"] == 2


def test_pages_of_the_registry(spark):
    sources = spark.createDataFrame([(1, True), (2, False)], "source long, enabled boolean")
    pages = spark.createDataFrame([(10, 1, None), (11, 1, False), (12, 2, True), (13, 3, None), (14, None, None)], "page long, source long, enabled boolean")
    assert {r["page"]: (r["enabled"], r["known"]) for r in files.load_pages(pages, sources).collect()} == {10: (True, True), 11: (False, True), 12: (False, True), 13: (True, False), 14: (True, False)}


def test_retention_of_contents(spark):
    rows = [(1, h, i, n) for i, (h, n) in enumerate([("a", 5), ("b", 5), ("c", 0), ("d", None), ("e", 0), ("c", 0), ("f", 0)])] + [(2, None, 50, 3), (2, "a", 51, None)]
    got = files.content_retention(spark.createDataFrame(rows, "source long, hash string, id long, items int")).collect()
    assert {(r["source"], r["hash"]): r["keep"] for r in got} == {(1, "a"): False, (1, "b"): True, (1, "c"): True, (1, "d"): False, (1, "e"): True, (1, "f"): True, (2, "a"): True}
