"""How filters of documents interact: what each removes at each place of each order.

One pass of a table-driven byte transducer over the UTF-8 of whole texts counts words,
capitals, code points and symbols, and marks the words' spans; the spans go into a verified
hash table (``spans.py``), whose entries of a row are its different words. Each row becomes a
few numbers and a SHA-256, so no text is shuffled. A text that other rows share is found by
its digest, combined before the shuffle; only digests of repeated texts take part in the
join, and labels join by id.

Whether a document fails each filter is one bit mask. Rows are counted by (part, mask,
labels), at most 2^filters masks a part, and every figure of every order follows from these
counts: a filter removes at its place the rows that fail it and none before it, and over
all orders a row that fails k filters is removed by each of them in 1/k of the orders.

Edge cases: a null text is empty; null is the part '' together with an empty one; repeated
rows are documents of their own, and rows of one id don't make each other copies; a null id
has no smaller one, is no smaller one and has no labels; where an id has several labels, it
is good or toxic if any of them says so; parts without documents don't exist, so an empty
table gives an empty result; extra columns, also with clashing names, are ignored; texts
are read whole, however long.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pieces
from .common import materialize, pick
from .spans import BEGIN, CAPITAL, POINT, SYMBOL, SpanTable, buffer_of, word_transducer

#: Letter of each filter -> when a document fails it, over the columns of ``facts`` and ``first_id``.
FILTERS: Mapping[str, str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_points",
    "D": "n_symbols > 0",
    "E": "first_id < doc_id",
}
SYMBOLS = "#$%&*|"


def measure(texts: pa.Array, symbols: str = SYMBOLS) -> list[pa.Array]:
    """Words, different words, capitals, code points, symbols and SHA-256 of each text."""
    machine = word_transducer(symbols)
    data, ends = buffer_of(texts)
    out, n = machine.run(data, ends), len(texts)
    begin = np.flatnonzero(out & BEGIN)
    inside = machine.after[data] == 1
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = ends[1:] > ends[:-1]
    last[ends[1:][full] - 1] = inside[ends[1:][full] - 1]
    stop = np.flatnonzero(last) + 1
    row = np.searchsorted(ends, begin, "right") - 1
    words = np.bincount(row, minlength=n)
    table = SpanTable(len(begin))
    table.number(data, begin, stop - begin, row)
    different = np.bincount(table.group[: table.count], minlength=n)

    def counted(bit: int) -> np.ndarray:
        at = np.searchsorted(np.flatnonzero(out & bit), ends)
        return at[1:] - at[:-1]

    digests = [hashlib.sha256(data[a:b]).digest() for a, b in itertools.pairwise(ends.tolist())]
    numbers = (words, different, counted(CAPITAL), counted(POINT), counted(SYMBOL))
    return [*(pa.array(x.astype(np.int64)) for x in numbers), pa.array(digests, pa.binary())]


def facts(docs: DataFrame, part: str = "source", symbols: str = SYMBOLS) -> DataFrame:
    """(doc_id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, digest) of every row's whole text."""
    rows = pick(docs, "doc_id", part, "text").toDF("doc_id", "part", "text")
    rows = rows.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), "text")
    counts = [T.StructField(x, T.LongType()) for x in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")]
    schema = T.StructType([rows.schema["doc_id"], rows.schema["part"], *counts, T.StructField("digest", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(2), pc.binary_length(batch.column(2))):
                ids = [batch.column(i).slice(at, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *measure(texts, symbols)], schema.names)
                at += len(texts)

    return rows.mapInArrow(scan, schema)


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row; bit k of the mask is set if the k-th filter fails."""
    measured = materialize(facts(docs, part), "facts")
    copies = measured.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = materialize(copies, "copies")  # a join of two tables, so that adaptive execution may split a text with very many copies
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    marks = marks.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    mask = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, rule in enumerate(filters.values())), F.lit(0))
    none = F.lit(False)
    return (
        measured.join(copies, "digest", "left")
        .select("doc_id", "part", mask.cast("int").alias("mask"))
        .join(marks, "doc_id", "left")
        .select("doc_id", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    )


def audit(failed: DataFrame, letters: str = "".join(FILTERS)) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic) of every document.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, which is the
    filter's removed summed over all orders.
    """
    size, orders = len(letters), math.factorial(len(letters))
    counts = failed.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # At most 2^filters entries a part; all orders read the same few numbers.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    bits = F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)])
    bit = lambda letter: F.element_at(bits, letter)
    rows = parts.select("part", "masks", F.explode(steps).alias("filter_order"))
    rows = rows.select("part", "masks", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    rows = rows.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), bit(F.substring("filter_order", k, F.lit(1)))).otherwise(0))
    rows = rows.withColumn("before", before)

    def total(what: str, when) -> Column:
        return F.aggregate(F.filter("masks", when), F.lit(0).cast("long"), lambda s, m: s + m[what])

    own, prior = F.col("own"), F.col("before")
    fails = lambda m: m["mask"].bitwiseAND(own) != 0
    gone = lambda m: m["mask"].bitwiseAND(prior) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda s, m: s + m["n"] * F.floor(F.lit(orders) / F.bit_count(m["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m["mask"] == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
