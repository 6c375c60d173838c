"""The given tables seen as the library's model: a catalogue, its categories, run history and titles.

Every view has a twin in SQL (see queries/views.py), so each query can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: id, title, start_at, start_day, end_day (null for every fifth), place, region, price, status."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    day = F.to_date("o_orderdate")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws(" ", F.col("o_orderpriority"), F.col("c_mktsegment")).alias("title"),
            F.col("o_orderdate").cast("timestamp").alias("start_at"),
            day.alias("start_day"),
            F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, (F.col("o_orderkey") % 15).cast("int"))).alias("end_day"),
            F.col("n_nationkey").alias("place_id"),
            F.col("n_name").alias("place"),
            F.col("r_name").alias("region"),
            F.when(F.col("o_totalprice") < 50000, "free").when(F.col("o_totalprice") < 300000, "paid").alias("price_type"),
            F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("archived").alias("status"),
        )
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).filter("status = 'published'")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, axis, category): the kinds and audiences of each record, each once."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    both = F.explode(F.array(F.struct(F.lit("kind").alias("axis"), F.col("p_type").alias("category")), F.struct(F.lit("audience").alias("axis"), F.col("p_brand").alias("category"))))
    return rows.select(F.col("l_orderkey").alias("id"), both.alias("c")).select("id", "c.axis", "c.category").distinct()


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, week_start): every week that a published record touches."""
    from .operators.intervals import explode_weeks

    return explode_weeks(published(spark, sf_dir).select("id", "start_day", "end_day")).select("id", "week_start")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history, one row an attempt: source, id, fetched_at, status, ok, items, hash, title_fill."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 304).otherwise(200)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        status.alias("status"),
        (status < 400).alias("ok"),
        F.when(status < 400, k % 7).alias("items"),
        F.floor(F.col("value") / 20).cast("long").alias("hash"),
        F.when((status < 400) & (k % 7 > 0), F.round((k % 10) / 10, 4)).alias("title_fill"),
    )


def matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, customer, title, start_at with a time of day, place_id, venue (null for every fourth), status): orders as events and candidates."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 1440).cast("int"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        (F.col("o_orderdate").cast("timestamp") + minutes).alias("start_at"), F.col("c_nationkey").alias("place_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("c_mktsegment")).alias("venue"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("archived").alias("status"),
    )


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, lang, source, title_key): the whole first line of each document, to be matched in blocks of its language and more."""
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), "lang", "source", fold(title).alias("title_key"))
