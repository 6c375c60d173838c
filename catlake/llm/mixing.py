"""Mixing sources to target weights by entropy balancing.

Targets: the sources in the order of their code points, null last, weigh 5, 2, 1 and so
on; they share ``total`` times all words by weight, none above ``most`` times its own,
with the excess reshared by weight.

Rates: each document's rate stays as near to 1 in relative entropy as the sources' word
targets allow, and at most ``most``; the convex dual has one multiplier a source, and
gives rates min(most, exp(multiplier * size / mean size)). Newton steps, kept inside a
bracket, run as Spark jobs over the histogram of (source, size), which is what the sums
need of the documents; its rows are bounded by the distinct sizes, not by documents.

Copies: rates are rounded per (source, size) from the largest size down, each class
taking up the words by which those before it missed, so a source misses its target by
about one smallest document. Within a class, the rows with the smallest hashes of their
ids get one copy more. Rows that agree in source, size and id are counted, not ranked, so
an id that very many rows share is one entry; ranks in large classes are counted in parts.

Edge cases: a null or blank text has size 0 and takes no words; null is a source of its
own; repeated rows are documents of their own: where only some rows of one id, source and
size get another copy, ``mix`` returns as many of them as that, and ``apply_mix`` chooses
them by their place in the table, so no row exceeds ``most`` copies and no source its
target; an empty table gives an empty result; a source without words has target 0; extra
columns stay where rows are returned whole and are ignored elsewhere, also with clashing
names. The whole of a text is counted, however long.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, anonymous, column, discard, materialize, pick

#: Rows of a class whose ranks are counted in one part, and copies of one row that are made in one go.
PART = 4096


def _source(source: Column) -> Column:
    """The source with a mark before it, so that null has a value of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size) of every row."""
    return pick(docs, "doc_id", "source", "text").select("doc_id", _source(F.col("source")).alias("src"), _size(F.col("text")).alias("size"))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, most: int = 2) -> DataFrame:
    """(src, source_size, target) from a written table (src, source_size): one row a source, however many.

    Places in the order of sources come from ranges, each numbered by itself, and the
    numbers of rows in the ranges before. The level of the shares is the root of a concave
    function of it, sum of min(cap, weight * level) = total, found by Newton steps from
    below: each is one sum over the sources, and each but the last holds more of them at
    their caps.
    """
    # "~" comes after every "s" and what follows it, so null is last.
    at = F.monotonically_increasing_id()
    ranged = materialize(sources.repartitionByRange("src").sortWithinPartitions("src").select("src", "source_size", F.shiftright(at, 33).alias("range"), at.bitwiseAND((1 << 33) - 1).alias("row")), "ranges")
    counts = sorted(map(tuple, ranged.groupBy("range").count().collect()))  # one row a partition
    before = dict(zip([r for r, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    place = F.col("row") + (F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("range")) if before else F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = ranged.select("src", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    level, held = 0.0, None
    while True:
        full = F.col("cap") <= F.col("weight") * level if held is not None else F.lit(False)
        words, caps, share, n = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n == held or not share:
            break
        held, level = n, (total * words - (caps or 0)) / share
    return rows.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def multipliers(histogram: DataFrame, goals: DataFrame, most: int = 2, steps: int = 60, near: float = 1e-6) -> DataFrame:
    """(src, scale, rate_all, multiplier): the dual's solution for each source.

    ``histogram`` is (src, size, n); ``goals`` (src, source_size, n_docs, target). rate_all is set where
    every document has the same rate: 0 for a target of 0, ``most`` for one at its cap.
    """
    scale = F.col("source_size") / F.col("n_docs")
    now = materialize(
        goals.select(
            "src",
            "target",
            scale.alias("scale"),
            F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size"), float(most)).alias("rate_all"),
            F.lit(0.0).alias("multiplier"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        ),
        "dual",
    )
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("multiplier") * x, F.lit(50.0)))
        live = histogram.filter("size > 0").join(now.filter("rate_all IS NULL AND NOT done"), "src")
        sums = live.groupBy("src").agg(
            F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(most)))).alias("words"),
            F.sum(F.when(tilt < most, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
        )
        # The bracket's ends are unknown (null) until a multiplier on that side has been tried.
        stepped = now.join(sums, "src", "left").withColumn("gap", F.col("words") - F.col("target")).withColumns({
            "low": F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high")),
        })
        newton = F.col("multiplier") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        # Without both ends, a step may double the multiplier (plus 1) at most; with both, it must stay between them.
        reach = 1 + 2 * F.abs("multiplier")
        held = F.coalesce(F.least(F.greatest(newton, F.col("multiplier") - reach), F.col("multiplier") + reach), F.col("multiplier") - F.signum("gap") * reach)
        middle = (F.col("low") + F.col("high")) / 2
        step = F.when((held > F.col("low")) & (held < F.col("high")), held).otherwise(F.coalesce(middle, held))
        settled = F.coalesce(F.abs("gap") <= near * F.greatest("target", F.lit(1.0)), F.lit(True))
        new = stepped.select(
            "src", "target", "scale", "rate_all",
            F.when(settled, F.col("multiplier")).otherwise(step).alias("multiplier"), "low", "high", settled.alias("done"),
        )
        new = materialize(new, "dual")
        discard(now)
        now = new
        if not now.filter("NOT done").limit(1).count():
            break
    return now.select("src", "target", "scale", "rate_all", "multiplier")


def _round(most: int):
    def copies(group: pd.DataFrame) -> pd.DataFrame:
        """Copies per size of one source, largest first, so that words taken follow words due."""
        group = group.sort_values("size", ascending=False)
        due, taken, out = 0.0, 0, []
        for size, n, rate in zip(group["size"], group["n"], group["rate"], strict=True):
            due += size * n * rate
            k = int(min(most * n, max(0, round((due - taken) / size)))) if size else 0
            taken += k * size
            out.append(k)
        return group.assign(copies=np.asarray(out, "int64"))[["src", "size", "n", "copies"]]

    return copies


def shares(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, most: int = 2) -> DataFrame:
    """(src, size, doc_id, n, source_size, target, copies, more): every row of n equal ones gets ``copies``, and ``more`` of them one more."""
    rows = materialize(sizes(docs).groupBy("src", "size", "doc_id").agg(F.count("*").alias("n")), "sizes")
    histogram = materialize(rows.groupBy("src", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = materialize(histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), "sources")
    goals = materialize(
        targets(sources.select("src", "source_size"), weights, total, most).join(sources.select("src", "n_docs"), "src"), "goals"
    )
    dual = multipliers(histogram, goals, most)
    rate = F.coalesce("rate_all", F.least(F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(most))))
    rated = histogram.join(dual, "src").select("src", "size", "n", rate.alias("rate"))
    # One group a source: as many rows as it has different sizes, however many documents.
    classes = materialize(
        rated.groupBy("src").applyInPandas(_round(most), "src string, size long, n long, copies long"), "classes"
    ).join(goals, "src").withColumnRenamed("n", "of")
    parted = rows.join(classes, ["src", "size"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("of") / PART).cast("long")))
    key = ["src", "size", "part"]
    large = parted.filter(F.col("of") > PART).groupBy(*key).agg(F.sum("n").alias("count"))
    offsets = large.select(
        *key,
        (F.sum("count").over(Window.partitionBy("src", "size").orderBy("part")) - F.col("count")).alias("offset"),
    )
    ordered = Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit("mix")), "doc_id")
    before = F.coalesce("offset", F.lit(0)) + F.sum("n").over(ordered) - F.col("n")
    more = F.least(F.greatest(F.col("copies") % F.col("of") - F.col("before"), F.lit(0)), F.col("n"))
    return parted.join(offsets, key, "left").withColumn("before", before).select(
        "src", "size", "doc_id", "n", "source_size", "target", F.floor(F.col("copies") / F.col("of")).alias("copies"), more.alias("more")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row."""
    found = shares(docs, weights, total, most)
    # n equal rows in lots of at most PART, the first ``more`` of them with one copy more.
    lots = found.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART).cast("long"))))
    rows = lots.withColumn("row", F.explode(F.sequence("lot", F.least(F.col("lot") + PART, F.col("n")) - 1)))
    return rows.withColumn("own", F.col("copies") + (F.col("row") < F.col("more")).cast("long")).select(
        "doc_id", "size", "source_size", "target", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``found``, the result of ``shares``, says, with the columns it had."""
    rows = anonymous(docs)
    key = ["_src", "_size", "_id"]
    given = found.select(F.col("src").alias("_src"), F.col("size").alias("_size"), F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("copies").alias("_copies"), F.col("more").alias("_more"))
    given = materialize(given.filter("_copies > 0 OR _more > 0"), "shares")
    sized = rows.withColumns({"_src": _source(column(docs, "source")), "_size": _size(column(docs, "text")), "_id": column(docs, "doc_id")})
    same = lambda a, b: (a["_src"] == b["_src"]) & (a["_size"] == b["_size"]) & a["_id"].eqNullSafe(b["_id"])
    whole = given.filter("_more = 0 OR _more = _n").withColumn("_copies", F.col("_copies") + (F.col("_more") > 0).cast("long"))
    out = sized.join(whole, same(sized, whole)).select(*rows.columns, "_copies")
    split = given.filter("_more > 0 AND _more < _n")
    if split.limit(1).count():
        # Of these equal rows only some get one copy more: their places are numbered in lots, one a partition of the table.
        lots = materialize(sized.join(split, same(sized, split), "left_semi").withColumn("_lot", F.spark_partition_id()), "lots")
        number = lots.groupBy(*key, "_lot").agg(F.count("*").alias("_in"))
        number = number.withColumn("_before", F.sum("_in").over(Window.partitionBy(*key).orderBy("_lot")) - F.col("_in"))
        ranked = lots.withColumn("_row", F.row_number().over(Window.partitionBy(*key, "_lot").orderBy(column(docs, "text"))))
        left, right = ranked.alias("l"), number.alias("r")
        placed = left.join(right, (F.col("l._lot") == F.col("r._lot")) & (F.col("l._src") == F.col("r._src")) & (F.col("l._size") == F.col("r._size")) & F.col("l._id").eqNullSafe(F.col("r._id")))
        placed = placed.select("l.*", (F.col("l._row") + F.col("r._before")).alias("_at"))
        some = placed.join(split, same(placed, split)).select(*rows.columns, (F.col("_copies") + (F.col("_at") <= F.col("_more")).cast("long")).alias("_copies"))
        out = out.unionByName(some)
    made = out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return made.select(*rows.columns).toDF(*docs.columns)
