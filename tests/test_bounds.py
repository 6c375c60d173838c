"""The bound of a similarity holds, and what it leaves unscored changes no match."""

import random

from pyspark.sql import functions as F

from catlake.functions import text
from catlake.operators import match


def titles(rng, n):
    words = ["summer", "concert", "hall", "jazz", "night", "a", "žluť", "2024", "", "night night"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(n)] + ["", "x", "aaaa", "aaab", None]


def test_bound(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a, b in zip(titles(rng, 400), titles(rng, 400), strict=True)] + [(a[::-1], a) for a in titles(rng, 50) if a]
    rows = spark.createDataFrame(pairs, "a string, b string")
    bound = text.similarity_bound(F.col("a"), F.col("b"), text.letter_counts(F.col("a")), text.letter_counts(F.col("b")))
    found = rows.select("a", "b", text.similarity_of(F.col("a"), F.col("b")).alias("s"), bound.alias("u")).collect()
    assert all((r["s"] is None and r["u"] is None) or r["s"] <= r["u"] <= 1 + 1e-8 for r in found)
    assert sum(r["u"] is not None and r["u"] < 0.75 for r in found) > 100  # it does tell pairs apart


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("pq"), t) for i, t in enumerate(titles(rng, 150))]
    frame = spark.createDataFrame(rows, "id long, block string, title_key string")
    candidates, records = frame.filter("id % 3 = 1"), frame.filter("id % 3 <> 1")
    got = {r["c_id"]: (r["r_id"], r["score"], r["decision"]) for r in match.match_candidates(candidates, records, ["block"]).collect()}
    every = match.block_pairs(candidates, records, ["block"])
    score = match.match_score(text.similarity_of(F.col("c_title_key"), F.col("r_title_key")), F.lit(1.0), F.lit(None).cast("double"))
    best = every.withColumn("score", score).groupBy("c_id").agg(F.min_by(F.struct("r_id", "score"), F.struct(-F.col("score"), "r_id")).alias("r")).select("c_id", "r.*")
    want = {r["c_id"]: (r["r_id"], r["score"]) for r in best.collect()}
    assert {c: v[:2] for c, v in got.items() if want[c][1] is not None} == {c: v for c, v in want.items() if v[1] is not None} and got.keys() == want.keys()


def test_events_with_and_without_bounds(spark):
    import datetime

    rng = random.Random(7)
    at = lambda: datetime.datetime(2026, 5, 1 + rng.randint(0, 1), rng.randint(0, 23), 30)
    rows = [(i, t, at(), rng.choice([1, 2, None]), rng.choice(["Hall", "hall b", "", None])) for i, t in enumerate(titles(rng, 120))]
    frame = spark.createDataFrame(rows, "id long, title string, start_at timestamp, place_id long, venue string")
    sides = frame.filter("id % 3 = 1"), frame.filter("id % 3 <> 1")
    assert sorted(map(tuple, match.match_events(*sides).collect())) == sorted(map(tuple, match.match_events(*sides, bounded=True).collect()))
