"""Texts, dates, prices, URLs, pages and streams at the edges of their rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from catlake.functions.price import normalize_price
from catlake.functions.temporal import parse_when
from catlake.functions.text import clean_text, fold
from catlake.functions.urls import canonical_url
from catlake.operators import intervals, match, normalize, pages, search
from catlake.streaming import stateful as st

D = datetime.date


def values(spark, made, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", made(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def test_fold_by_decomposition(spark):
    assert values(spark, fold, "Café NOËL", "ṩ̣x ＡＢ", "Straße ①", "", None) == ["cafe noel", "sx ab", "strasse 1", "", None]


def test_entities(spark):
    texts = ["&#233;&eacute;&#xE9; &ndash; &copy;", "&amp;amp;lt;b&amp;gt;", "a &bogus; &#0; &#xD800; & b;", "&#128512;", "&nbsp; ​ ", None]
    assert values(spark, clean_text, *texts) == ["ééé – ©", "<b>", "a &bogus; &#0; &#xD800; & b;", "😀", None, None]


def test_dates_are_never_guessed(spark):
    texts = ["1. 5. 2024", "1.5.2024 od 18:30", "1. 5. 2024 - 3. 5. 2024", "cancelled, formerly 1. 5. 2024", "31. 4. 2024", "2024-05-01", " 2024-05-01T23:30:00+0200 ", None]
    found = values(spark, parse_when, *texts)
    day = D(2024, 5, 1)
    assert [x and (x["day"], x["all_day"]) for x in found] == [(day, True), (day, False), (None, None), (None, None), (None, None), (day, True), (day, False), (None, None)]
    assert found[6]["at"] == datetime.datetime(2024, 5, 1, 21, 30)


def test_ranges_with_names_of_months(spark):
    as_of = F.lit(D(2024, 4, 1))
    texts = ["Pátek 3. května 2024", "so 28. 12. - 2. ledna 2025", "9. 9. - 1. 5.", "31. 4.", "no date", "30. března"]
    found = values(spark, lambda x: normalize.parse_when_range(x, as_of), *texts)
    assert [(x["first"], x["last"], x["reason"]) for x in found] == [
        (D(2024, 5, 3), None, None), (D(2024, 12, 28), D(2025, 1, 2), None), (None, None, "too-long"), (None, None, "invalid-date"), (None, None, "no-date"), (D(2024, 3, 30), None, None),
    ]


def test_prices(spark):
    texts = ["1 500 Kč", "1.500 Kč", "dne 5. 8. 2024 100 Kč", "50-100 Kč", "od 50 do 100 Kč", "12,50 Kč", "100 Kč, 100 CZK", "100 Kč / 50 Kč", "vstup  volný", "zdarma, 10 Kč", "kč", None]
    found = values(spark, normalize_price, *texts)
    assert [(x["type"], x["amount"]) for x in found[:-1]] == [
        ("paid", 1500), ("paid", 1500), ("paid", 100), ("paid", None), ("paid", None), ("paid", None), ("paid", 100), ("paid", None), ("free", 0), ("unknown", None), ("paid", None),
    ]
    assert found[9]["reason"] == "conflicting-price"


def test_urls(spark):
    texts = ["http://A.Example:80/x/?b=2&utm_source=q&a=1#f", "https://a.example/pouť/%c5%a5", "https://a.example/%2520", "https://a.example/#!/r", "ftp://a.example/", "https://a b/", "https://a.example?q=é"]
    want = ["https://a.example/x?a=1&b=2", "https://a.example/pou%C5%A5/%C5%A5", "https://a.example/%2520", "https://a.example/#!/r", None, None, "https://a.example/?q=%C3%A9"]
    assert values(spark, canonical_url, *texts) == want


def test_long_records_touch_every_week(spark):
    rows = spark.createDataFrame([(1, D(2022, 1, 1), D(2024, 12, 31)), (2, D(2024, 5, 1), None), (3, None, D(2024, 5, 1))], "id long, start_day date, end_day date")
    assert intervals.explode_weeks(rows).groupBy("id").count().orderBy("id").collect() == [(1, 158), (2, 1)]
    days = intervals.calendar_days(rows, F.lit(D(2024, 4, 29)), spark.range(1))
    assert [tuple(r) for r in days.select("day", "id", "role").orderBy("day", "id").collect()] == sorted(
        [(D(2024, 4, 29) + datetime.timedelta(k), 1, "continues") for k in range(7)] + [(D(2024, 5, 1), 2, "all-day")]
    )


LONG = "<p>" + "plain words of a page " * 25 + "</p>"
EVENT = '{"@type":["Event"],"name":"N","startDate":"2026-05-01"}'


@pytest.mark.parametrize("url,html,kind,reasons", [
    ("https://e.org/x", f'<script type="application/ld+json">{EVENT}</script>', "event-detail", "D1-one-jsonld-event"),
    ("https://e.org/x", f'<script type="application/ld+json">{{"@type":"ItemList","item":[{EVENT},{EVENT}]}}</script>', "listing", "L1-jsonld-list"),
    ("https://e.org/x", f'<script type="application/ld+json">{EVENT}</script><table>{"".join(f"<td>{d}.</td>" for d in ("Po", "Út", "St", "Čt", "Pá"))}</table>', "unknown", "D1-one-jsonld-event,L4-calendar"),
    ("https://e.org/akce/pout", f"{LONG}<h1>T</h1><p>3. května 2026</p>", "event-detail", "D3-one-date-one-heading,D5-detail-url"),
    ("https://e.org/akce/kveten", f"{LONG}<h1>T</h1><p>3. 5. a 3. 5. 2026, 2026-05-03</p>", "event-detail", "D3-one-date-one-heading"),
    ("https://e.org/x", f'{LONG}<meta content="event" property="og:type"><h1>T</h1>', "unknown", "D2-page-type"),
    ("https://e.org/x", f'{LONG}{"".join(f"<a href=/p/{k}>n</a> {k}. 6. 2026 {"z" * 200}" for k in range(1, 6))}', "listing", "L2-dated-links"),
    ("https://e.org/x", f'{LONG}<div class="Pagination">1. 6. 2026 a 2. 6. 2026</div>', "listing", "L3-pagination"),
    ("https://e.org/x", f"{LONG}<h1>T</h1><script>1. 5. 2026</script>", "unknown", ""),
    ("https://e.org/x", "<h1>T</h1>3. 5. 2026", "unknown", "D3-one-date-one-heading"),
    (None, None, "unknown", ""),
])
def test_pages_by_their_evidence(spark, url, html, kind, reasons):
    rows = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    assert tuple(pages.classify(pages.signals(rows)).first()) == (1, kind, reasons)


def test_dates_near_links(spark):
    html = "<p>1. 6. 2026" + "x" * 150 + '<a href="/a">a</a>' + "y" * 300 + '<a href="/b">b</a>' + "z" * 58 + '2. 6.</p><a href="#c">3. 6. 2026</a>'
    marks = pages.signals(spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string")).first()
    assert (marks["dated_links"], marks["distinct_dates"], marks["links"]) == (1, 3, 3)


def test_fields_after_line_sixty(spark):
    text = "\n".join(f"line {k}" for k in range(70)) + "\nAddress: Long Street 1\nOrganizer: A\nOrganizer: B\n1. 5. 2026"
    rows = spark.createDataFrame([(1, text, D(2026, 1, 1))], "id long, text string, day date")
    row = pages.detail_fields(rows, "id", "text", "day").first()
    assert (row["date_text"], row["address"], row["organizers"]) == (None, "Long Street 1", ["A", "B"])


def test_search_and_index_agree(spark):
    rows = spark.createDataFrame([(1, "Café Nové"), (2, "cafeteria"), (3, None)], "id long, text string")
    assert sorted(r["id"] for r in search.fulltext_prefix(rows, "id", "CAFÉ", "text").collect()) == [1, 2]
    assert [r["id"] for r in search.fulltext_prefix(rows, "id", "café nov", "text").collect()] == [1]
    assert search.fulltext_prefix(rows, "id", " ! ", "text").count() == 0


def test_matches_need_day_and_place(spark):
    schema = "id long, title string, start_at timestamp, place_id long, venue string"
    at = datetime.datetime(2026, 5, 1, 18, 0)
    events = spark.createDataFrame([(1, "Summer Concert", at, 7, "Hall"), (2, "Summer Concert", at, 7, "Hall"), (3, "Summer Concert", at, 8, "Hall"), (4, "Other", at, None, None)], schema)
    candidates = spark.createDataFrame([(10, "summer  concért", at, 7, "HALL"), (11, "Summer Concert", at + datetime.timedelta(hours=3), 7, " "), (12, "Other", at, None, None), (13, "zzz", at, 8, None), (14, None, None, 7, None)], schema)
    found = {r["c_id"]: tuple(r)[1:] for r in match.match_events(candidates, events).collect()}
    assert found == {10: (1, 1.0, "auto-merge", 1.0, 1.0, 1.0), 11: (1, 0.8235, "review", 1.0, 0.0, None), 13: (3, 0.1765, "separate", 0.0, 1.0, None)}


def test_streams_of_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    none = spark.createDataFrame([], "source long")
    for made, mode, keys in ((lambda r: st.source_health(r, none), "update", ("source",)), (st.inbox_dedup, "append", ())):
        assert st.drain(spark, made(st.run_stream(spark, str(tmp_path))), mode, f"{tmp_path}/{mode}", keys).count() == 0
    assert st.catalog_ingest(spark, st.run_stream(spark, str(tmp_path)), f"{tmp_path}/ingest").count() == 0
