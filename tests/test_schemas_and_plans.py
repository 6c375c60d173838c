"""One broken field gives one finding, a sound record none; plans keep every limit and pass over what doesn't fit."""

import copy

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catlake.operators import health, schemas

STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2}|Z)$"
SCHEMA = {
    "type": "object",
    "required": ["id", "title", "start_at", "end_at", "all_day", "categories", "price", "parts"],
    "$defs": {"stamp": {"type": "string", "pattern": STAMP}, "part": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}}},
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z0-9]+(-[a-z0-9]+)*$"},
        "title": {"type": "string", "minLength": 1},
        "start_at": {"$ref": "#/$defs/stamp"},
        "end_at": {"anyOf": [{"$ref": "#/$defs/stamp"}, {"type": "null"}]},
        "all_day": {"type": "boolean"},
        "categories": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": ["music", "film"]}},
        "price": {"type": "object", "required": ["type"], "properties": {"type": {"enum": ["free", "paid"]}, "amount": {"type": ["number", "null"], "minimum": 0, "maximum": 100}}},
        "parts": {"type": "array", "items": {"$ref": "#/$defs/part"}},
        "version": {"const": 1},
    },
}
RECORD = (
    T.StructType().add("id", "string").add("title", "string").add("start_at", "string").add("end_at", "string").add("all_day", "string").add("categories", T.ArrayType(T.StringType()))
    .add("price", T.StructType().add("type", "string").add("amount", "string")).add("parts", T.ArrayType(T.StructType().add("name", "string").add("tags", T.ArrayType(T.StringType())))).add("version", "integer")
)
SOUND = {
    "id": "a-1", "title": "T", "start_at": "2024-05-01T10:00:00+02:00", "end_at": None, "all_day": "true", "categories": ["music", "film"], "price": {"type": "free", "amount": None},
    "parts": [{"name": "p", "tags": ["x"]}, {"name": "q", "tags": None}], "version": 1,
}
BROKEN = {
    "id pattern": {"id": "A b"}, "id required": {"id": None}, "title minLength": {"title": ""}, "start_at pattern": {"start_at": "2024-05-01"}, "end_at pattern": {"end_at": "soon"}, "all_day type": {"all_day": "yes"},
    "categories minItems": {"categories": []}, "categories uniqueItems": {"categories": ["film", "film"]}, "categories[1] enum": {"categories": ["film", "sport"]}, "categories required": {"categories": None},
    "price.type enum": {"price": {"type": "dear", "amount": None}}, "price.type required": {"price": {"type": None, "amount": None}}, "price.amount type": {"price": {"type": "paid", "amount": "much"}},
    "price.amount minimum": {"price": {"type": "paid", "amount": "-1"}}, "price.amount maximum": {"price": {"type": "paid", "amount": "100.5"}}, "price required": {"price": None},
    "parts[1].name minLength": {"parts": [{"name": "p", "tags": None}, {"name": "", "tags": None}]}, "parts[0].tags[1] enum": {"parts": [{"name": "p", "tags": ["y", "z"]}]}, "version const": {"version": 2},
}


def test_one_finding_a_fault(spark):
    rows = [("sound", SOUND), ("empty", None)] + [(m, copy.deepcopy(SOUND) | change) for m, change in BROKEN.items()]
    frame = spark.createDataFrame(rows, T.StructType().add("key", "string").add("r", RECORD))
    found = [(r["key"], r["message"]) for r in schemas.schema_findings(frame, "key", "r", SCHEMA).collect()]
    assert sorted(found) == sorted([(m, m) for m in BROKEN] + [("empty", "required")])


def test_columns_that_a_schema_lacks_or_has_more(spark):
    frame = spark.createDataFrame([(1, (1.5, "x"))], T.StructType().add("key", "integer").add("r", T.StructType().add("n", "double").add("more", "string")))
    schema = {"type": "object", "required": ["n", "gone"], "additionalProperties": False, "properties": {"n": {"type": "integer"}, "gone": {"type": "string"}, "may": {"type": "string"}}}
    found = {r["message"] for r in schemas.schema_findings(frame, "key", "r", schema).collect()}
    assert found == {"n type", "gone required", ".more additionalProperties"}
    with pytest.raises(ValueError):
        schemas.schema_findings(frame, "key", "r", {"type": "object", "oneOf": []})


def places(spark, rows):
    """(place, tier, district, region, queries, candidates, new_sources, priority in hundredths)"""
    names = "place long, tier int, district string, region string, queries int, candidates int, new_sources int, days_since_check double"
    frame = spark.createDataFrame([(*r[:7], r[7] / 40) for r in rows], names)
    return frame.select("*", *[F.lit(0.0).alias(f) for f in health.FACTORS if f != "days_since_check"])


def test_a_dear_place_doesn_t_end_the_plan(spark):
    rows = [(1, 1, "a", "x", 5, 1, 0, 30), (2, 1, "a", "x", 90, 1, 0, 29), (3, 2, "a", "x", 5, 1, 0, 28), (4, 3, "a", "x", 5, 99, 0, 27), (5, 3, "a", "x", 5, 1, 9, 26), (6, 3, "a", "x", 5, 1, 0, 25)]
    got = health.plan_batch(places(spark, rows), health.Limits(places=10, queries=50, candidates=20, new_sources=3, districts=1)).collect()
    assert [(r["place"], r["spent"]) for r in got] == [(1, 5), (3, 10), (6, 15)]


def test_regions_and_districts_come_first(spark):
    rows = [(i, 1 + i % 3, "a", "x", 1, 1, 0, 40 - i) for i in range(1, 20)] + [(50, 1, "b", "y", 1, 1, 0, 2), (51, 2, "c", "x", 1, 1, 0, 3), (52, 3, "d", "x", 1, 1, 0, 1), (53, 3, "e", "x", 1, 1, 0, 0)]
    got = health.plan_batch(places(spark, rows), health.Limits(places=6, districts=4)).collect()
    assert {r["region"] for r in got} == {"x", "y"} and {r["district"] for r in got} == {"a", "b", "c", "d"}
    tiers = [r["tier"] for r in got]
    assert len(got) <= 6 and all(tiers.count(t) <= int(s * 6 + 0.5) for t, s in health.SHARES.items())
    assert health.plan_batch(places(spark, rows).limit(0)).count() == 0


def test_a_plan_that_looks_further(spark, monkeypatch):
    """Rows that don't fit fill the first rounds; the plan goes on behind them."""
    monkeypatch.setattr(health, "AT_ONCE", 3)
    rows = [(i, 1, "a", "x", 10 if i < 12 else 1, 1, 0, 40) for i in range(1, 30)]
    got = health.plan_batch(places(spark, rows), health.Limits(places=30, queries=15, districts=1)).collect()
    assert [r["place"] for r in got] == [1, 12, 13, 14, 15, 16]
