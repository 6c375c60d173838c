"""Pairs of events are neither shuffled nor scored one by one where texts are few, and give the same either way."""

import datetime
import random

from catlake.operators import match


def _sides(spark):
    rng = random.Random(11)
    at = lambda: datetime.datetime(2026, 5, 1, rng.randint(0, 23), rng.choice([0, 30]))
    rows = [(i, rng.choice(["jazz night", "jazz", "", None, "open day"]), at(), rng.choice([1, 2, None]), rng.choice(["Hall", "hall b", "", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, title string, start_at timestamp, place_id long, venue string")
    return frame.filter("id % 3 = 1"), frame.filter("id % 3 <> 1")


def test_known_texts_give_the_same(spark, monkeypatch):
    known = sorted(map(tuple, match.match_events(*_sides(spark)).collect()))
    monkeypatch.setattr(match, "KNOWN_PAIRS", 0)
    assert known == sorted(map(tuple, match.match_events(*_sides(spark)).collect()))


def test_no_pair_goes_to_python(spark):
    plan = match.calibration(match.event_pairs(*_sides(spark)).withColumn("same", match.F.col("c_id") == 1))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]
    assert "ArrowEvalPython" not in above and "Window" not in above
