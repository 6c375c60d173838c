"""Lines are read once, and those that can't be accepted not at all, with the same results."""

import datetime

from pyspark.sql import functions as F

from catlake.functions import lines as li

DAY = datetime.date(2024, 5, 1)
LINES = [
    "", "30 lidí", "So, 5. 5. 2024 od 18:15", "zrušeno 1. 5. 2024", "v 18:00", "od 5. 5. v 25:00", "5. 5. v 8:00 a 3 dalších", "2024-05-05 – 2024-05-07", "pole 5. 5.", "pondělí 6. května", "1.500",
    "31. 2. 2024", "5.5. 9:00-8:00", "15.-17. 8.", "ve 5. 6. 7. 8.", ", 5. 5.", "30. 12. - 2. 1. v 20:00", "ne", "utc+2 5. 5.", "5. 5. 9:00 UTC+2", "1:2 5. 5.", "5. 5. 1:2", "5. 5. 123:45", "po. 5. 5. až út, 7. 5.", "5. 5. 9:60",
]


def test_the_first_accepted_line(spark):
    """Against all lines, each read by itself."""
    texts = [(i, LINES[i:] + LINES[:i], DAY) for i in range(len(LINES))] + [(99, [x for x in LINES if "zrušeno" in x or x == "ne"], DAY), (100, None, DAY)]
    rows = spark.createDataFrame(texts, "id int, l array<string>, as_of date")
    each = F.filter(F.transform("l", lambda x: F.struct(x.alias("line"), li.parse_when_range(x, F.col("as_of")).alias("w"))), lambda x: x["w"]["reason"].isNull())
    got = rows.select(F.get(each, F.lit(0)).alias("a"), li.first_range(F.col("l"), F.col("as_of")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert sum(r["b"] is None for r in got) == 2 and len({r["b"]["line"] for r in got if r["b"]}) >= 8


def test_every_accepted_line_is_likely(spark):
    starts = {kind for kind in li._MACHINE["start"]}
    assert starts == {"day", "figure", "iso", "at"}
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").select("line", li.parse_when_range(F.col("line"), F.lit(DAY)).alias("w"), li.unaccent(F.col("line")).rlike(li._BEGINNING).alias("likely")).collect()
    assert all(r["likely"] for r in rows if r["w"]["reason"] is None)
    assert any(not r["likely"] for r in rows)


RUNS = ["1. 5. 2024", "1.\n\n2.\n\n3.", "1.\n2. 3.", "1.\n \n5. 2024", "1.5.", "1 . 5.", "1. 5", "1.\nkvetna 2024", "1.\n\nkvetna", "2024-05-01", "2024 -05-01", "2024-5-1", "1.2.3.4.", "1.500", "12-13. 5.", "3. unor a 4. 4.", ".5. 6. 7."]


def test_runs_that_are_passed_over_hold_no_date(spark):
    from catlake.functions import temporal as t

    rows = spark.createDataFrame([(x,) for x in RUNS], "run string")
    found = F.filter(t.run_dates(F.col("run")), t.valid_parts)
    got = rows.select("run", F.size(found).alias("n"), F.col("run").rlike(t._LIKELY_RUN).alias("likely")).collect()
    assert all(r["likely"] for r in got if r["n"])
    assert not next(r["likely"] for r in got if r["run"] == "1.\n\n2.\n\n3.") and sum(r["n"] > 0 for r in got) >= 8
