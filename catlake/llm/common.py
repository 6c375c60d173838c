"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anonymous(df: DataFrame) -> DataFrame:
    """The same columns under names by position, _c0 and so on, so that no name of the caller's clashes with one of ours."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def column(df: DataFrame, name: str) -> Column:
    """The first column of exactly this name, as a column of ``anonymous(df)``."""
    return F.col(f"_c{df.columns.index(name)}")


def with_made(df: DataFrame, source: str, to: str, made: Callable[[Column], Column]) -> DataFrame:
    """``df`` with one more column, made of its column ``source``; a column that is already called ``to`` gives way to it."""
    out = anonymous(df).withColumn("_made", made(column(df, source)))
    stay = [i for i, name in enumerate(df.columns) if name != to]
    return out.select(*[f"_c{i}" for i in stay], "_made").toDF(*[df.columns[i] for i in stay], to)


def kept_by(df: DataFrame, source: str, made: Callable[[Column], Column], condition: str) -> DataFrame:
    """The rows of ``df`` for which ``condition`` holds of ``_made``, a column made of ``source``; columns and names as they were."""
    return anonymous(df).withColumn("_made", made(column(df, source))).filter(condition).drop("_made").toDF(*df.columns)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever other columns are called.

    Extra columns whose names clash (another case, or the same name twice) don't
    make the reference ambiguous: the first column of the exact name is taken.
    """
    return anonymous(df).select(*[column(df, n).alias(n) for n in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may go without it.

    There it is a folder below the warehouse, which one machine has for itself.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catlake-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that is no longer needed."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/catlake-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` different rows at most, those with the least hashes; all different ones, if there are fewer.

    The same rows each time, on any cluster; repeated rows count once, so neither one id
    nor a null id that very many rows share decides what is in it. A threshold, set by the
    estimated number of different rows, keeps all but about ``rows`` away from the sort.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns, F.lit("sample")))
    there = hashed.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    if there > rows:
        hashed = hashed.filter(F.col("_hash") < int(-(1 << 63) + min(0.99, 1.1 * rows / there) * (1 << 64)))
    return hashed.dropDuplicates(["_hash"]).orderBy("_hash").limit(rows).drop("_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of ``rows`` labelled ids at most.

    The ids are sampled first, from the narrow table; at most ``rows`` of them are sent to
    the tasks, so no text is shuffled. An id with several labels has its least; an id may
    have several texts, so whoever collects what is made of them drops repeats and takes
    ``rows`` at most in the order of a hash.
    """
    ids = pick(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = bounded_sample(ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")), rows)
    return pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")
