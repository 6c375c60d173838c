"""Null and repeated keys keep their rows; payloads have one canonical form."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catlake.operators import health, match, normalize
from catlake.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_upserts_know_every_source(spark):
    customers = spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey")
    for name in ("health_upsert", "seed_state"):
        rows = QUERIES[name](spark, DIR)
        assert customers.join(rows, F.col("c_custkey") == F.col("source"), "left_anti").isEmpty()


def test_seeds_fill_only_what_is_empty(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", 3)], "source long, x string, y int")
    seeds = spark.createDataFrame([(1, "s", 1), (2, "s", None), (9, "s", 9)], "source long, x string, y int")
    got = {tuple(r) for r in health.seed_state(stored, seeds, ["x", "y"]).collect()}
    assert got == {(1, "a", 1, False), (2, "s", None, False), (3, "c", 3, False), (9, "s", 9, True)}


def test_members_with_null_blocks(spark):
    rows = spark.createDataFrame([(1, "en", "s", "t"), (2, None, "s", "t"), (3, None, "s", "t"), (4, "en", None, "t"), (5, "en", "s", None), (6, "en", "s", "t")], "id long, lang string, source string, title_key string")
    got = {r["id"]: r["representative"] for r in match.title_members(rows, ["lang", "source"]).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 1}
    pairs = match.salted_pairs(rows.filter("id < 4"), rows, ["lang", "source"]).select("c_id", "r_id").collect()
    assert {tuple(r) for r in pairs} == {(1, 1), (1, 5), (1, 6)}


def test_candidates_with_repeated_and_null_ids(spark):
    schema = "id long, source string, uid string, title string, when string, url string, base_url string, price string, place string, source_place string"
    one = ("s", "u", "T", "1. 5. 2024 od 19:30", "/e", "https://e.org/", "zdarma", "Brno", None)
    items = spark.createDataFrame([(1, *one), (1, *one), (1, *one), (None, *one), (2, *one[:7], None, "nowhere")], schema)
    places = spark.createDataFrame([(7, "Brno")], "place_id long, name string")
    got = normalize.normalize_candidates(items, places, places.limit(0), "Europe/Prague").collect()
    assert sorted((r["id"] or 0, r["place_id"], r["reasons"]) for r in got if r["place_id"]) == [(0, 7, ""), (1, 7, ""), (1, 7, ""), (1, 7, "")]
    assert [(r["place_id"], r["reasons"]) for r in got if r["id"] == 2] == [(None, "unknown-place")]
    assert len(got) == 5 and len({r["candidate_id"] for r in got}) == 1
    assert all(r["provenance"] == sorted(set(r["provenance"])) and len(r["provenance"]) == 3 for r in got)


def test_one_text_for_equal_values(spark):
    nested = T.StructType().add("b", T.ArrayType(T.StructType().add("y", "double").add("x", "string"))).add("a", T.MapType(T.StringType(), T.LongType()))
    turned = T.StructType().add("a", T.MapType(T.StringType(), T.LongType())).add("b", T.ArrayType(T.StructType().add("x", "string").add("y", "double")))
    text = 'q"\\\n\tž'
    one = spark.createDataFrame([(([(1.0, text), (2.5, None)], {"k": 1, "a": None}),), ((None, None),)], T.StructType().add("r", nested))
    two = spark.createDataFrame([(({"a": None, "k": 1}, [(text, 1.0), (None, 2.5)]),), ((None, None),)], T.StructType().add("r", turned))
    texts = [[r[0] for r in df.select(normalize.canonical_row(df)).collect()] for df in (one, two)]
    assert texts[0] == texts[1]
    assert texts[0][0] == json.dumps({"r": {"a": {"a": None, "k": 1}, "b": [{"x": text, "y": 1}, {"x": None, "y": 2.5}]}}, ensure_ascii=False, separators=(",", ":"))
    assert texts[0][1] == '{"r":{"a":null,"b":null}}'
