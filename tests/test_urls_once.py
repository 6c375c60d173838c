"""A URL's parts are taken by one match, with the same results at the edges of the pattern."""

from pyspark.sql import functions as F

from catlake.functions.urls import canonical_url


def test_parts_are_taken_once(spark):
    plan = spark.createDataFrame([("",)], "u string").select(canonical_url(F.col("u")))._jdf.queryExecution().analyzed().toString()
    # The plan's text showed ten of them when each part had its own match.
    assert 1 <= plan.count("://(") <= 2


def test_edges(spark):
    cases = {
        "http://e.org/a#x ": "https://e.org/a", "http://e.org/a#!x ": "https://e.org/a#!x", "http://e.org/a#x  ": None, "http": None, "https": None, "http://": None, "http://e.org/a\nb": None,
        "http://e.org?b=2&a=1&&utm_x=1": "https://e.org/?a=1&b=2", "http://e.org?UTM_A": "https://e.org/", "<http://e.org/$1>": "https://e.org/$1", "http://e.org/a|b?é": "https://e.org/a%7Cb?%C3%A9",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases
