"""Titles are compared cell by cell: the arrays give the plain similarity, pairs are never shuffled, and a null title beats no scored one."""

import random

import numpy as np
from pyspark.sql import functions as F

from catlake.functions import alike
from catlake.functions.text import similarity
from catlake.operators import match


def test_arrays_give_the_similarity_to_the_last_bit():
    rng = random.Random(1)
    for letters in ("ab", "abcdefgh ", "žluťab😀"):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 8, 20, 90]))) for _ in range(40)]
        made = alike.Letters(texts, alike.alphabet(texts))
        for i, a in enumerate(texts):
            found = alike.similarities(made, i, made, np.arange(len(texts)))
            assert found.tolist() == [similarity(a, b) for b in texts]
            assert (alike.at_most(made, i, made) >= found - 1e-12).all()
            at, s = alike.nearest(made, i, made, lambda x: np.round(x, 2), most=200)
            assert s == found[at] and at == np.argmax(np.round(found, 2))


def test_cells_give_each_pair_once_and_shuffle_none(spark):
    side = lambda start, n: spark.range(start, start + n).select("id", F.lit("en").alias("lang"), F.concat(F.lit("title "), "id").alias("title_key"))
    pairs = match.title_pairs(side(0, 1500), side(10000, 2100), ["lang"])
    assert pairs.count() == pairs.distinct().count() == 1500 * 2100
    plan = match.match_candidates(side(0, 1500), side(10000, 2100), ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_null_titles_come_last(spark):
    rows = spark.createDataFrame([(1, "b", "hall"), (2, "b", None), (3, "b", "hall b"), (4, "b", None), (5, "c", "x"), (6, "c", None)], "id long, block string, title_key string")
    got = {r["c_id"]: (r["r_id"], r["title_similarity"]) for r in match.match_candidates(rows.filter("id IN (1, 4, 5)"), rows.filter("id IN (2, 3, 6)"), ["block"]).collect()}
    assert got[1][0] == 3 and got[4] == (2, None) and got[5] == (6, None)


def test_only_texts_whose_bound_reaches_the_best_are_scored(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(20, 200))) for _ in range(600)]
    made, scored, plain = alike.Letters(texts, alike.alphabet(texts)), [], alike.similarities
    asked = alike.Letters([texts[7][:-3] + "tea", texts[9][::-1]], alike.alphabet(texts))
    monkeypatch.setattr(alike, "similarities", lambda a, i, b, rows: scored.append((rows, plain(a, i, b, rows))) or scored[-1][1])
    for i in range(2):
        scored.clear()
        bound, best = alike.at_most(asked, i, made), -1.0
        alike.nearest(asked, i, made, lambda x: x)
        for rows, found in scored:
            assert best < 0 or (bound[rows] + 1e-9 >= best).all()
            best = max(best, found.max())
    assert len(scored[0][0]) == 32


def test_letters_far_apart_or_very_many(monkeypatch):
    """Texts whose letters are bunched leave each other's reach; a letter may be there more often than two bytes hold."""
    texts = ["a" * 300 + "b" * 300, "b" * 300 + "a" * 300, "ab" * 300, "z" + "ab" * 40 + "q", "q" + "ba" * 40 + "z", "a" * 66_000 + "b", "b" + "a" * 66_000, "ab"]
    made = alike.Letters(texts, alike.alphabet(texts))
    for i, a in enumerate(texts):
        for rows in (np.arange(len(texts)), np.array([6, 1, 3])):
            found = alike.similarities(made, i, made, rows)
            assert found.tolist() == [similarity(a, texts[j]) for j in rows]
        assert (alike.at_most(made, i, made)[rows] >= found - 1e-12).all()
