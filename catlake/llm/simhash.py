"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from word shingles; two texts link if their 64-bit fingerprints
differ in ``distance`` (2) bits at most. Equal fingerprints collapse first, so a group
of exact copies, however large, is one node from then on.

Search: the fingerprint has two segments, its upper and its lower half. If two
fingerprints differ in at most 2 bits, either the upper halves differ in at most one
bit, or the lower halves are equal. So each fingerprint probes the table of upper halves
with the Hamming ball of radius 1 about its own (only with bits that it lacks, as the
partner has the ball's other half), and the table of lower halves with its own; complete
distances are verified.

Buckets with more than ``bucket`` fingerprints would give pairs by their square. Whoever
probes such a bucket is searched with the ball of radius 1 about the complete
fingerprint instead: two fingerprints at distance 2 or less share a point of their balls,
and at most 65 fingerprints share one point. This is exact too.

Edge cases: a text that is null or has no word has fingerprint 0 and links as any other;
repeated rows and ids each get their row; a null doc_id keeps its row, and its component
is the smallest id among those reachable (null if there is none); empty tables give empty
results; extra columns stay where rows are returned whole and are ignored elsewhere, also
with clashing names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import anonymous, column, materialize, pick, with_made
from .components import connected_components

#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both are ASCII only
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    first, last = start[: len(words) - size + 1].tolist(), (start + length)[size - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        part = zip(first[k : k + _BLOCK], last[k : k + _BLOCK], strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), "<u8", min(_BLOCK, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """Every row with the fingerprint of its whole text."""

    @F.pandas_udf("long")
    def simhashes(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x) for x in texts], dtype="int64")

    return with_made(docs, text, to, simhashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    return with_fingerprint(pick(docs, "doc_id", "text")).select("doc_id", "fp")


def _ball(bits: str, width: int, unset_only: bool) -> str:
    """SQL: the array of the value itself and the values that differ from it in one bit."""
    steps = f"transform(sequence(0, {width - 1}), b -> shiftleft(1L, b))"
    if unset_only:
        steps = f"filter({steps}, m -> ({bits} & m) = 0)"
    return f"concat(array({bits}), transform({steps}, m -> {bits} ^ m))"


def near_pairs(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints fp; each within distance 2.

    Every pair within distance 2 is linked directly, or, where it comes from a bucket of
    more than ``bucket`` fingerprints, through others that are within distance 2 of both.
    """
    halves = fps.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("hi"), F.expr("fp & 4294967295L").alias("lo"))
    table = halves.selectExpr("fp AS other", "inline(array(struct(0 AS seg, hi AS key), struct(1 AS seg, lo AS key)))")
    probes = halves.selectExpr(
        "fp",
        f"inline(concat(transform({_ball('hi', 32, True)}, k -> struct(0 AS seg, k AS key, k <> hi AS flipped)),"
        " array(struct(1 AS seg, lo AS key, false AS flipped))))",
    )
    count = table.groupBy("seg", "key").count()
    full = count.filter(F.col("count") > bucket).drop("count")
    small = table.join(count.filter(F.col("count") <= bucket).drop("count"), ["seg", "key"])
    found = (
        probes.join(small, ["seg", "key"])
        .filter("(flipped OR fp < other) AND fp <> other AND bit_count(fp ^ other) <= 2")
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    hot = probes.join(full, ["seg", "key"], "left_semi").select("fp").distinct()
    points = hot.selectExpr("fp", f"explode({_ball('fp', 64, False)}) AS point")
    met = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = (
        met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
        .filter("a <> b AND bit_count(a ^ b) <= 2")
    )
    return found.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row: the smallest doc_id reachable by links, and a fingerprint that names the component."""
    rows = materialize(fingerprints(docs), "fingerprints")
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = connected_components(near_pairs(reps.select("fp"), bucket)).withColumnRenamed("node", "fp")
    linked = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = linked.join(least, "root").select("fp", "component_id", "root")
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id", "root")


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group of ``near_duplicates``, with the columns it had.

    Of a group, the row stays that is first in the order of doc_id (null last), fingerprint
    and text; of rows that agree in all three, one of the least other columns. Where each id
    has one row, ids alone tell which. Rows whose id is null or repeated are told apart by
    their fingerprints, made again for them alone, so an id that stands for several groups
    keeps a row of each and no group loses its only row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    firsts = groups.groupBy("root").agg(F.min(order).alias("f")).select("f.doc_id", "f.fp")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"))
    single, several = ids.filter("n = 1 AND doc_id IS NOT NULL").select("doc_id"), ids.filter("n > 1 OR doc_id IS NULL").select("doc_id")
    rows, doc_id = anonymous(docs), column(docs, "doc_id")
    named = lambda x: x.select(F.col("doc_id").alias("_want"), *[c for c in x.columns if c != "doc_id"])
    if not several.limit(1).count():
        return rows.join(named(firsts.select("doc_id")), doc_id == F.col("_want"), "left_semi").toDF(*docs.columns)
    kept = rows.join(named(firsts.select("doc_id").join(single, "doc_id", "left_semi")), doc_id == F.col("_want"), "left_semi")
    # Written before their fingerprints are made, so that no other row gets one again.
    apart = materialize(rows.join(named(several), doc_id.eqNullSafe(F.col("_want")), "left_semi"), "repeated-ids")
    marked = with_fingerprint(apart, f"_c{docs.columns.index('text')}", "_fp")
    found = marked.join(named(firsts), doc_id.eqNullSafe(F.col("_want")) & (F.col("_fp") == F.col("fp")), "left_semi")
    others = [F.col(f.name) if isinstance(f.dataType, T.AtomicType) else F.to_json(f.name) for f in rows.schema.fields]
    first = F.row_number().over(Window.partitionBy(doc_id, "_fp").orderBy(column(docs, "text"), *others))
    chosen = found.withColumn("_row", first).filter("_row = 1").drop("_row", "_fp")
    return kept.unionByName(chosen).toDF(*docs.columns)
