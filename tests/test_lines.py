"""Lines that say when, blocks of a listing and texts of a detail; under two session zones."""

import datetime

import pytest
from pyspark.sql import functions as F

from catlake.functions import lines, temporal
from catlake.operators import pages

ZONE = "Europe/Prague"
TODAY = "2026-08-02"


@pytest.fixture(params=["UTC", "America/New_York"])
def session(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def utc(seconds):
    return None if seconds is None else datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%d %H:%M")


#: line, day it is read, preference -> start and end in UTC, all-day, number of dates.
READ = [
    ("Čt, 13. 8. v 20:30 CEST", TODAY, "future", "2026-08-13 18:30", None, False, None),
    ("Sobota 29. srpna 2026 v 14:00 CEST", TODAY, "future", "2026-08-29 12:00", None, False, None),
    ("So, 7. 9. 2024", TODAY, "past", "2024-09-06 22:00", None, True, None),
    ("Pá, 1. 5.", TODAY, "past", "2026-04-30 22:00", None, True, None),
    ("Pá, 9. 1. v 19:00", TODAY, "future", "2027-01-09 18:00", None, False, None),
    ("30. 4. v 18:00 až 1. 5. v 5:00 CEST", "2026-04-01", "future", "2026-04-30 16:00", "2026-05-01 03:00", False, None),
    ("So, 15. 8. v 22:00 až 3:00", TODAY, "future", "2026-08-15 20:00", "2026-08-16 01:00", False, None),
    ("So, 15. 8. v 20:00–22:30", TODAY, "future", "2026-08-15 18:00", "2026-08-15 20:30", False, None),
    ("Pá, 7. 8. – 9. 8.", TODAY, "future", "2026-08-06 22:00", "2026-08-08 22:00", True, None),
    ("Pá, 7. 8.–9. 8.", TODAY, "future", "2026-08-06 22:00", "2026-08-08 22:00", True, None),
    ("7.-9. srpna", TODAY, "future", "2026-08-06 22:00", "2026-08-08 22:00", True, None),
    ("15.–17. 8. 2024", TODAY, "future", "2024-08-14 22:00", "2024-08-16 22:00", True, None),
    ("1. 7. v 9:00 až 31. 8. v 17:00", TODAY, "future", "2026-07-01 07:00", "2026-08-31 15:00", False, None),
    ("28. 12. v 18:00 až 2. 1. v 2:00", "2026-12-01", "future", "2026-12-28 17:00", "2027-01-02 01:00", False, None),
    ("So, 29. 2. v 20:00", "2028-01-01", "future", "2028-02-29 19:00", None, False, None),
    ("Út, 4. 8. ve 9:00 CEST a 23 dalších", TODAY, "future", "2026-08-04 07:00", None, False, 24),
    ("1. 8.", TODAY, "future", "2026-07-31 22:00", None, True, None),
    ("30. 7.", TODAY, "future", "2027-07-29 22:00", None, True, None),
    ("2024-05-01 – 2024-05-03", TODAY, "future", "2024-04-30 22:00", "2024-05-02 22:00", True, None),
    ("14. 8. 2026, 17:00", TODAY, "future", "2026-08-14 15:00", None, False, None),
]
REFUSED = [
    ("Zobrazit víc", "no-date"), ("", "empty-line"), (None, "empty-line"), ("Událost vytvořena Divadlo 29", "no-date"), ("v 20:30", "no-date"), ("Ne, 29. 2. v 20:00", "invalid-date"),
    ("St, 31. 4. v 18:00", "invalid-date"), ("Pá, 31. 11.", "invalid-date"), ("15. 8. v 20:00 až 10. 8. v 17:00", "too-long"), ("15. 8. 2026 v 20:00 až 10. 8. 2026 v 17:00", "end-before-start"),
    ("zrušeno 1. 5. 2024, nově 3. 5. 2024", "unread-line"), ("1. 5., 8. 5., 15. 5. 2024", "unread-line"), ("14. 8. v 27:00", "invalid-time"), ("17.–15. 8. 2024", "end-before-start"),
    ("30.", "unread-line"), ("14. 8. 2026 Divadlo", "unread-line"), ("1.500 Kč", "no-date"), ("1. 5. a", "unread-line"),
]


def test_lines(session):
    for prefer in ("future", "past"):
        cases = [c for c in READ if c[2] == prefer]
        rows = session.createDataFrame([(i, c[0], datetime.date.fromisoformat(c[1])) for i, c in enumerate(cases)], "i int, line string, day date")
        r = lines.parse_when_range(F.col("line"), F.col("day"), prefer, ZONE)
        found = rows.select("i", r.alias("r")).select("i", F.unix_timestamp("r.start_at"), F.unix_timestamp("r.end_at"), "r.all_day", "r.total_dates", "r.reason").orderBy("i").collect()
        assert [(cases[i][0], utc(a), utc(b), d, n, x) for i, a, b, d, n, x in found] == [(c[0], *c[3:], None) for c in cases]
    rows = session.createDataFrame(REFUSED, "line string, want string").select("line", lines.parse_when_range(F.col("line"), F.lit(TODAY).cast("date")).alias("r"))
    found = rows.select("line", "r.*").collect()
    assert [(r["line"], r["reason"]) for r in found] == REFUSED
    assert all(r[c] is None for r in found for c in ("first", "last", "start_at", "end_at", "all_day", "total_dates"))


def test_instants_don_t_depend_on_the_session(session):
    texts = {"2024-01-15T12:00:00+02:00": 1705312800, "2024-01-15 12:00": 1705316400, "15. 1. 2024 od 8:05": 1705302300, "2024-01-15T12:00+0530": 1705300200, "2024-01-15T12:00:00.5Z": 1705320000, "2024-01-15": 1705273200}
    bad = ["2024-02-30", "2024-01-15T25:00", "2024-01-15T12:00:00+99:00", "0000-01-01", "soon", None]
    rows = session.createDataFrame([(t,) for t in [*texts, *bad]], "t string").select("t", temporal.parse_when(F.col("t"), ZONE).alias("w"))
    found = {t: (at, day) for t, at, day in rows.select("t", F.unix_timestamp("w.at"), F.col("w.day").cast("string")).collect()}
    assert found == {t: (at, "2024-01-15") for t, at in texts.items()} | dict.fromkeys(bad, (None, None))


def test_dates_by_their_neighbours(spark):
    text = "15. 8. 2026 a 15.8. ale 1.500 a 1. 2. 3. dne 2024-05-06, 3. srpna 2024 4. zari .5. 6. 1.2.3.4 a 1. 5.2024 12024-05-06 2024-05-067 31. 2. 5. srpna2024 9. 9.9"
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(temporal.written_dates(F.col("t"))).alias("d")).select("d.*").collect()
    assert [(r["d"], r["m"], r["y"], r["text"]) for r in found] == [
        (15, 8, 2026, "15. 8. 2026"), (15, 8, None, "15.8."), (1, 2, None, "1. 2."), (6, 5, 2024, "2024-05-06"), (3, 8, 2024, "3. srpna 2024"), (4, 9, None, "4. zari"), (1, 5, 2024, "1. 5.2024"),
    ]
    offsets = pages.date_offsets(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert [text[r["start"] : r["end"]] for r in sorted(offsets, key=lambda r: r["start"])] == [r["text"] for r in found]


def test_a_long_run_of_dates(spark):
    text = "1. 5. 2024 " * 3000 + "   " * 50_000
    assert spark.createDataFrame([(text,)], "t string").select(F.size(temporal.dates_in(F.col("t")))).first()[0] == 3000


BLOCKS = [
    ["Pá, 14. 8. v 17:00 CEST", "Letní scéna – vernisáž", "Muzeum baroka", " ", " · Chrudim", "Událost vytvořena Chrudimská beseda, středisko"],
    ["So, 15. 8. v 20:00 CEST", "Il fratricidio", "Událost pořádá Beseda", "Event by Second"],
    ["Právě probíhá", "Sportovní park - slavíme 10 let!", "Park Na Špici", " · Pardubice", "Událost vytvořena Park"],
    ["Právě probíhá do 10. 8.", "Výstava", "Událost vytvořena Galerie"],
    ["Ongoing", "Show", "Hall"],
    ["Út, 4. 8. ve 9:00 CEST a 23 dalších", "Za skřítky", "Zámek"],
    ["14. srpna 2024", "A", "B"],
    ["Název bez data", "A", "B"],
    ["Pá, 14. 8."],
    [],
]


def test_blocks_of_a_listing(spark):
    rows = spark.createDataFrame([(i, "\n".join(x), datetime.date.fromisoformat(TODAY)) for i, x in enumerate(BLOCKS)], "id int, text string, day date")
    found = pages.listing_blocks(rows, "id", "text", "day", zone=ZONE).withColumns({c: F.unix_timestamp(c) for c in ("start_at", "end_at")}).orderBy("id").collect()
    assert [(utc(r["start_at"]), utc(r["end_at"]), r["ongoing"], r["title"], r["venue"], r["municipality"], r["organizers"], r["total_dates"], r["reason"]) for r in found] == [
        ("2026-08-14 15:00", None, False, "Letní scéna – vernisáž", "Muzeum baroka", "Chrudim", ["Chrudimská beseda, středisko"], None, None),
        ("2026-08-15 18:00", None, False, "Il fratricidio", None, None, ["Beseda", "Second"], None, None),
        (None, None, True, "Sportovní park - slavíme 10 let!", "Park Na Špici", "Pardubice", ["Park"], None, None),
        (None, "2026-08-09 22:00", True, "Výstava", None, None, ["Galerie"], None, None),
        (None, None, True, "Show", "Hall", None, [], None, None),
        ("2026-08-04 07:00", None, False, "Za skřítky", "Zámek", None, [], 24, None),
        ("2024-08-13 22:00", None, False, "A", "B", None, [], None, None),
        (None, None, False, "A", "B", None, [], None, "no-date"),
        (None, None, False, None, None, None, [], None, "short-block"),
        (None, None, False, None, None, None, [], None, "short-block"),
    ]


def test_texts_of_details(spark):
    texts = [
        "30 lidí\nodpočet 5\nPátek 14. srpna 2026 v 17:00\nDivadlo, Ulice 1, 530 02 Pardubice\nUdálost pořádá RockIn a TRAKTOR spolu s 4 dalšími\nPořadatelé\nRockIn\nTRAKTOR\nRockIn\nPodrobnosti\nJiný",
        "Událost pořádá RockIn a TRAKTOR spolu s 4 dalšími\nEvent by DrumCity\nAddress: Hall 2\nzrušeno 1. 5. 2024, nově 3. 5. 2024",
        "Organizers\nA\nShare\nUdálost pořádá B",
        "",
    ]
    rows = spark.createDataFrame([(i, x, datetime.date.fromisoformat(TODAY)) for i, x in enumerate(texts)], "id int, text string, day date")
    found = pages.detail_fields(rows, "id", "text", "day").orderBy("id").collect()
    assert [(r["date_text"], r["address"], r["organizers"]) for r in found] == [
        ("Pátek 14. srpna 2026 v 17:00", "Divadlo, Ulice 1, 530 02 Pardubice", ["RockIn", "TRAKTOR"]),
        (None, "Hall 2", ["RockIn a TRAKTOR", "DrumCity"]),
        (None, None, ["A"]),
        (None, None, []),
    ]


def test_programmes(spark):
    blocks = spark.createDataFrame([(1, 24), (2, 1), (3, None), (4, None)], "id long, total_dates int")
    times = spark.createDataFrame([(3, "a"), (3, "b"), (3, "b"), (4, "a")], "id long, time_id string")
    found = {r["id"]: (r["kind"], r["recurring"], r["times"]) for r in pages.programmes(blocks, times, "id").collect()}
    assert found == {1: ("programme", True, 0), 2: ("single-event", False, 0), 3: ("programme", True, 2), 4: ("single-event", False, 1)}
