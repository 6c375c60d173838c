"""Ids that clash lose no group of near duplicates."""

from catlake.llm import simhash

TEXTS = ["the river runs past the old mill and on to the sea", "a quarterly report lists figures that nobody has checked", "seven lamps burn in the harbour while the ships sleep"]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(docs, simhash.near_duplicates(docs)).collect())


def test_one_id_for_several_groups(spark):
    assert kept(spark, [(1, t) for t in TEXTS] * 2 + [(2, TEXTS[0])]) == sorted((1, t) for t in TEXTS)


def test_an_id_is_kept_only_for_the_groups_it_stands_for(spark):
    assert kept(spark, [(1, TEXTS[0]), (2, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[2]), (3, TEXTS[2])]) == sorted([(1, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[2])])
    assert kept(spark, [(0, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[1]), (0, TEXTS[2])]) == sorted([(0, TEXTS[0]), (0, TEXTS[2]), (1, TEXTS[1])])
