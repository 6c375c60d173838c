"""JSON-LD at any level, dates with offsets, hosts in other scripts, code lists and the notes of the inbox."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from catlake.functions.urls import canonical_url
from catlake.operators import pages
from catlake.sources import files
from catlake.streaming import stateful


def event(name, **more):
    return {"@type": "MusicEvent", "name": name} | more


def test_events_at_every_level_in_the_order_of_the_text(spark):
    listed = {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": event("a", **{"@type": ["Thing", "https://schema.org/Festival"]})}, {"@type": "ListItem", "item": event("b", subEvent=[event("c")])}]}
    blocks = [[{"@graph": [{"@type": "WebPage", "mainEntity": listed}, event("d")]}, event("e", location={"name": "hall"})], event("f", review={"@type": "Review", "name": "not one"})]
    html = "".join(f'<script type="application/ld+json"> {json.dumps(x)} </script>' for x in blocks)
    broken = '<script type="application/ld+json">{"@type": </script>' + f'<script type="application/ld+json">{json.dumps(event("g"))}</script>'
    rows = spark.createDataFrame([(1, html), (2, broken), (3, "<p>none</p>"), (4, None), (5, '<script type="application/ld+json">[]</script>')], "page_id long, html string")
    got = [(r["page_id"], r["position"], r["title"], r["venue"]) for r in pages.jsonld_items(rows).orderBy("page_id", "position").collect()]
    first = [(1, k, name, "hall" if name == "e" else None) for k, name in enumerate("abcdef")]
    assert got == [*first, (2, 0, None, None), (2, 1, "g", None)]


def test_offsets_cut_out_the_written_dates(spark):
    rng = random.Random(3)
    pieces = ["Čtení ", "1. 5. 2024", "12. května", " až ", "2024-02-29", "31. 2.", "ß", "é", " x ", "3. Října 2025", "45. 13. 1999", "\n", "日本 ", "1. 5. 2024"]
    texts = ["".join(f"{rng.choice(pieces)}; " for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, ""]
    rows = pages.date_offsets(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    valid = {"1. 5. 2024": (1, 5, 2024), "12. května": (12, 5, None), "2024-02-29": (29, 2, 2024), "3. Října 2025": (3, 10, 2025)}
    got = sorted((r["id"], r["start"], r["end"]) for r in rows)
    assert got == sorted((k, m.start(), m.end()) for k, t in enumerate(texts) if t for w in valid for m in re.finditer(re.escape(w), t))
    for r in rows:
        assert (r["day"], r["month"], r["year"]) == valid[texts[r["id"]][r["start"] : r["end"]]]


@pytest.mark.parametrize(("url", "wanted"), [
    ("http://Kulturní-dům.cz/akce/", "https://{}/akce"), ("https://müller.example:8080/", "https://{}:8080/"), ("https://plain.example", "https://{}/"),
])
def test_hosts_in_other_scripts(spark, url, wanted):
    host = re.match(r"https?://([^/:]+)", url.lower())[1].encode("idna").decode()
    assert spark.range(1).select(canonical_url(F.lit(url))).first()[0] == wanted.format(host)


CODES = [("1", "A", "a1", "t"), ("2", "A", "a2", "v"), ("3", "B", "b1", "t")]


@pytest.mark.parametrize(("rows", "problem"), [
    (CODES, None), ([*CODES, ("4", "C", "c9", "?")], None), ([*CODES, ("4", "A", "a1", "?")], "unknown-type"), ([*CODES, ("4", "A", "a9", "t")], "other-districts"),
    (CODES[1:], "other-districts"), ([*CODES, ("3", "A", "a1", "t")], "repeated-code"), ([*CODES, ("x", "A", "a1", "t")], "bad-code"), ([*CODES, (None, "A", "a1", "t")], "bad-code"), (CODES[:1], "too-few-rows"),
])
def test_code_lists(spark, tmp_path, rows, problem):
    columns = "code string, region string, district string, type string"
    spark.createDataFrame(rows, columns).withColumn("valid_from", F.lit("2024-01-01")).write.option("header", True).csv(f"{tmp_path}/codes")
    districts = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1"), ("C", "c1")], "region string, district string")
    required = ["valid_from", "code", "region", "district", "type"]
    got = files.load_codelist(spark, f"{tmp_path}/codes", required, ["A", "B"], 2, {"t": "town", "v": "village"}, districts)
    assert {r["problem"] for r in got.collect()} == {problem} and got.filter("region = 'C'").isEmpty()
    assert got.filter("code = '1' AND type <> 'town'").isEmpty()


def test_notes_are_merged_over_batches(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1, k)
    batches = [
        [(1, "http://A.example/x/", " one \n\ntwo", at(1)), (2, "https://a.example/x#y", "two", at(2)), (3, "https://b.example/", None, at(2)), (4, "no url", "lost", at(2))],
        [(5, "https://a.example/x?utm_source=m", "three\none", at(3)), (6, "https://b.example", "  ", at(3)), (7, "https://c.example", "late", at(4)), (8, "https://c.example", "late", at(4))],
    ]
    schema = "id long, url string, note string, at timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["url"]: r["note"] for r in stateful.inbox_notes(spark, stream, f"{tmp_path}/notes").collect()}
    assert got == {"https://a.example/x": "one\ntwo\nthree", "https://b.example/": None, "https://c.example/": "late"}


def test_no_submission_gives_no_row(spark, tmp_path):
    schema = "id long, url string, note string, at timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    assert stateful.inbox_notes(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/notes").isEmpty()
