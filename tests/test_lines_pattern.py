"""Lines are read by one pattern, which takes what the grammar's table takes."""

import datetime
import random
import re

from pyspark.sql import functions as F

from catlake.functions import lines as li

SAMPLES = {
    "day": ["po", "nedele"], "figure": ["1.", "31.", "0."], "iso": ["2024-05-01", "2023-02-30"], "at": ["v", "od"], "month": ["kvetna", "12."], "until": ["az", "-", "–"], "clock": ["9:00", "24:00", "9:60"],
    "year": ["2024", "0000"], "zone": ["cest", "utc+2"], "comma": [","], "point": ["."], "and": ["a"], "number": ["3", "99999999999"], "others": ["dalsich", "more"],
}
JUNK = ["1:2", "123:45", "12345", "1.500", "x", "cetx", "·", "1.2", "2024-05-012", "utc+2a", "utc", "5.5.", "v20:00", "cet2024", "1.1000", "..", "12-13.", "\t"]
FIGURES = {"iso": r"\d{4}-\d{2}-\d{2}", "clock": r"\d{1,2}:\d{2}", "figure": r"\d{1,2}\.", "year": r"\d{4}", "number": r"\d+"}


def kind_of(sign):
    figures = next((k for k, p in FIGURES.items() if re.fullmatch(p, sign)), None)
    return figures or li._WORDS.get(sign) or ("zone" if re.fullmatch(li.ZONES, sign) else "word")


def by_table(line):
    """(accepted, the fields, dated) sign by sign."""
    state, got, dated = "start", {}, False
    for sign in re.findall(li._SIGN.replace(r"\p{L}", r"[^\W\d_]"), line):
        kind = kind_of(sign)
        state = li._MACHINE.get(state, {}).get(kind, "")
        dated |= kind in ("iso", "figure", "month")
        if kind == "iso" and state[:1] == "y":
            got |= {f + state[1]: int(x) for f, x in zip("ymd", sign.split("-"))}
        elif kind == "clock" and state[:1] == "t":
            hours, minutes = map(int, sign.split(":"))
            got[state] = hours * 60 + minutes if hours < 24 and minutes < 60 else -1
        elif kind in ("figure", "month", "year") and state in li._FIELDS:
            got[state] = li.MONTHS.get(sign) or int(sign.strip("."))
        elif state == "n":
            got["more"] = int(sign) if int(sign) < 2**31 else None
    ok = state in li._ACCEPTED
    return ok, [got.get(f) if ok else None for f in (*li._FIELDS, "more")], dated


def test_the_pattern_and_the_table(spark):
    r, lines = random.Random(1), ["", "a", "po " + "," * 20000, "v " * 20000, "x " * 20000, "1. 5. " + "cest " * 20000]
    for _ in range(6000):
        state, signs = "start", []
        while not (state in li._ACCEPTED and r.random() < 0.25) and len(signs) < 25:
            kind = r.choice(list(li._MACHINE[state]))
            state = li._MACHINE[state][kind]
            signs.append(r.choice(SAMPLES[kind]))
        if r.random() < 0.3:
            signs[r.randrange(len(signs))] = r.choice(JUNK + sum(SAMPLES.values(), []))
        lines.append("".join(x + r.choice((" ", " ", "")) for x in signs))
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", li.read_line(F.col("line")).alias("r")).collect()
    assert [x["line"] for x in rows if (x["r"]["accepted"], [x["r"][f] for f in (*li._FIELDS, "more")], x["r"]["dated"]) != by_table(x["line"])] == []
    assert 2000 < sum(x["r"]["accepted"] for x in rows) < 6000


def test_days_that_there_are_and_counts_too_large(spark):
    day = F.lit(datetime.date(2024, 5, 1))
    lines = ["29. 2. 2024", "29. 2. 2023", "29. 2. 1900", "29. 2. 2000", "31. 4. 2024", "30. 4. 2024", "0. 1. 2024", "1. 13. 2024", "5. 5. a 2147483646 dalších", "5. 5. a 2147483647 dalších"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", li.parse_when_range(F.col("line"), day).alias("w")).orderBy("id").collect()
    assert [x["w"]["reason"] for x in rows] == [None, "invalid-date", "invalid-date", None, "invalid-date", None, "invalid-date", "invalid-date", None, None]
    assert [x["w"]["total_dates"] for x in rows[-2:]] == [2**31 - 1, None]
