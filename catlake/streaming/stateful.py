"""Incremental forms of the per-source state machines, on Structured Streaming.

State stays small: the last attempts of each source, or a few counters. Sources share state
by groups, which are worked on as whole columns. The rows of a group pass through in pieces,
so a micro-batch of one group needn't fit into memory; what a piece leaves behind doesn't
depend on the order of the pieces.

Every stream runs in a folder that the caller names: its checkpoint and its committed rows
or versions lie there. Called again with the same folder, after an end, a stop or a crash, it
goes on where it was: a micro-batch that was not committed is repeated under its number, and
its output replaces what the first try may have written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState

from ..functions.urls import canonical_url
from ..operators.health import BASELINE_RUNS, BROKEN_AFTER, DEGRADED_RATIO, DRIFT_RATIO, LOOKBACK, LOW_BASELINE, STALE_DAYS
from ..operators.merge import merge_by_key
from ..sources.files import numbered, remove, work_folder

#: Micro-batches after which the rows of a stream are brought together.
COMPACT_AFTER = 20
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(spark: SparkSession, sf_dir: str, arrivals: int = 3) -> DataFrame:
    """The attempts of the table ``events`` as a stream of files that arrive in the order of their days, in about ``arrivals`` micro-batches."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = work_folder(spark, "arrivals")
    part = F.ntile(arrivals).over(Window.orderBy("day"))  # over the days, of which there are few
    days = rows.groupBy(F.to_date("ts").alias("day")).count().select("day", part.alias("arrival"))
    dealt = rows.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day").drop("day")
    for k in range(1, arrivals + 1):  # one after another, as files arrive
        dealt.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return read_runs(spark, folder, rows.schema, max(1, -(-files // arrivals)))


def read_runs(spark: SparkSession, folder: str, schema, files_a_batch: int = 1000) -> DataFrame:
    """The files of a folder, with the columns of ``events``, as a stream of attempts."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    return stream.select(
        F.col("user_id").alias("source"), (k % 3).alias("item"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"), ok.alias("ok"),
        F.when(ok, k % 7).cast("long").alias("items"), F.floor(F.col("value") / 20).cast("long").alias("hash"), F.when(ok & (k % 7 > 0), F.round((k % 10) / 10, 4)).alias("fill"),
    )


@contextmanager
def _state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """List state and timers need the state store that spills to disk."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def drain(spark: SparkSession, stream: DataFrame, mode: str, folder: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over what has arrived since the last call with this folder; returns its rows so far, of repeated keys (update mode) the last."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def so_far(last: int | None = None) -> DataFrame:
        whole = max((n for n in numbered(spark, f"{folder}/whole", "upto") if last is None or n <= last), default=-1)
        parts = [n for n in numbered(spark, f"{folder}/rows", "batch") if n > whole and (last is None or n <= last)]
        rows = spark.createDataFrame([], f"{schema}, _batch long")
        if whole >= 0:
            rows = rows.unionByName(spark.read.schema(f"{schema}, _batch long").parquet(f"{folder}/whole/upto={whole}"))
        for n in parts:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/rows/batch={n}").withColumn("_batch", F.lit(n).cast("long")))
        if mode != "update":
            return rows
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"), F.max("_batch").alias("_batch")).select(*keys, "_r.*", "_batch")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if number % COMPACT_AFTER == COMPACT_AFTER - 1:
            # What came before this batch is committed; this one may yet be repeated.
            so_far(number - 1).write.mode("overwrite").parquet(f"{folder}/whole/upto={number - 1}")
            for n in numbered(spark, f"{folder}/rows", "batch"):
                if n < number - COMPACT_AFTER:
                    remove(spark, f"{folder}/rows/batch={n}")

    with _state_in_rocks(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return so_far().drop("_batch").select(*stream.columns)


#: Groups of sources that share one value of state, so that Python and the state store meet once a group and not once a source; fixed, as stored states depend on it.
GROUPS = 256


def _group(source: str) -> Column:
    """The group of a source; null sources have one of their own, so that the ids of the others stay whole numbers."""
    return F.when(F.col(source).isNull(), -1).otherwise(F.pmod(F.xxhash64(source), F.lit(GROUPS))).cast("int")


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: ValueState) -> pd.DataFrame | None:
    return pa.ipc.open_stream(state.get()[0]).read_pandas() if state.exists() else None


_ATTEMPT = ["at", "event_id", "ok", "items", "hash", "fill"]
_NEWEST_FIRST = {"by": ["source", "at", "event_id"], "ascending": [True, False, False], "kind": "stable"}


def judge_all(attempts: pd.DataFrame, future: pd.DataFrame) -> pd.DataFrame:
    """(source, failures, items, unchanged_days, state) of each source, in the order of their last attempts, which lie together, each source's newest first.

    ``failures`` are those in a row, ``items`` the newest; ``future`` tells of each source whether it still announces something.
    """
    source, at, ok = attempts["source"], attempts["at"].to_numpy() // 1_000_000, attempts["ok"].to_numpy(bool)
    items, hashes, fill = (attempts[c].to_numpy(float) for c in ("items", "hash", "fill"))
    first = np.flatnonzero(~source.duplicated().to_numpy())
    count = np.diff(np.append(first, len(attempts)))
    group, place = np.repeat(np.arange(len(first)), count), np.arange(len(attempts)) - np.repeat(first, count)
    until = lambda stops: np.minimum.reduceat(np.where(stops, place, count[group]), first)
    failures, now = until(ok), items[first]
    with np.errstate(invalid="ignore"):
        usable = (place >= 1) & (items > 0)
    nth = np.cumsum(usable)
    usable &= nth - np.repeat(nth[first] - usable[first], count) <= BASELINE_RUNS
    median = lambda values: pd.Series(values[usable]).groupby(group[usable]).median().reindex(range(len(first))).to_numpy(float)
    base, base_fill = median(items), median(fill)
    same = np.where(np.isnan(hashes[first]), 0, until(hashes != hashes[first][group]))
    days = np.where(same >= 2, (at[first] - at[first + np.maximum(same, 1) - 1]) // 86400, np.nan)
    with np.errstate(invalid="ignore"):  # what isn't known is compared to nothing
        judged = base >= LOW_BASELINE
        state = np.select(
            [
                failures >= BROKEN_AFTER,
                judged & (now == 0),
                judged & (now < DEGRADED_RATIO * base),
                (now != 0) & ~np.isnan(now) & (base_fill > 0) & (fill[first] < DRIFT_RATIO * base_fill),
                (days > STALE_DAYS) & ~future["future"].to_numpy(bool),
            ],
            ["broken", "suspect", "degraded", "schema-drift", "stale"], "healthy",
        )
    whole = lambda x: pd.array(x, "Float64").astype("Int64")
    return pd.DataFrame({"source": source.iloc[first].array, "failures": failures, "items": whole(now), "unchanged_days": whole(days), "state": state.astype(object)})


def judge(attempts: pd.DataFrame, future: bool) -> tuple[int, int | None, int | None, str]:
    """Failures in a row, newest items, days unchanged and the state, from the last attempts of one source, the newest first."""
    row = judge_all(attempts.assign(source=0), pd.DataFrame({"source": [0], "future": [future]})).iloc[0]
    return int(row["failures"]), *(None if pd.isna(row[c]) else int(row[c]) for c in ("items", "unchanged_days")), row["state"]


class _Health(StatefulProcessor):
    """The last attempts of a group's sources as one value of state, and a timer that tells when the next of them is overdue."""

    def __init__(self, overdue: timedelta | None) -> None:
        self.overdue = None if overdue is None else int(overdue.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("attempts", "rows binary")
        #: One row a source: whether it announces something, and whether it has been told to be overdue.
        self.sources = handle.getValueState("sources", "rows binary")

    def _judged(self, attempts: pd.DataFrame, sources: pd.DataFrame, overdue: bool) -> pd.DataFrame:
        return judge_all(attempts, sources).assign(overdue=overdue).astype({"source": "Int64"})

    def _wait(self, sources: pd.DataFrame) -> None:
        """The timer is that of the source which is overdue next."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        rest = sources.loc[~sources["told"], "at"]
        if len(rest):
            self.handle.registerTimer(int(rest.min() // 1000 + self.overdue))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, sources, met = _unpacked(self.past), _unpacked(self.sources), []
        for piece in rows:
            piece = piece.assign(at=piece["at"].astype("datetime64[us]").astype("int64"), ok=piece["ok"].astype(bool)).astype({c: float for c in _ATTEMPT[3:]})
            met.append(piece["source"].unique())
            newest = piece.sort_values(["source", "at"], kind="stable")[["source", "at", "future"]].assign(told=False)
            # Of the same time, what came later counts.
            sources = (newest if sources is None else pd.concat([sources, newest])).sort_values(["source", "at"], kind="stable").drop_duplicates("source", keep="last")
            piece = piece[["source", *_ATTEMPT]]
            attempts = (piece if attempts is None else pd.concat([attempts, piece])).sort_values(**_NEWEST_FIRST)
            attempts = attempts[attempts.groupby("source", dropna=False).cumcount() < LOOKBACK]
        here = sources["source"].isin(np.concatenate(met))
        sources.loc[here, "told"] = False
        self.past.update((_packed(attempts),))
        self.sources.update((_packed(sources),))
        if self.overdue is not None:
            self._wait(sources)
        yield self._judged(attempts[attempts["source"].isin(np.concatenate(met))], sources[here], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, sources = _unpacked(self.past), _unpacked(self.sources)
        late = ~sources["told"] & (sources["at"] // 1000 + self.overdue <= timerValues.getCurrentWatermarkInMs())
        sources.loc[late, "told"] = True
        self.sources.update((_packed(sources),))
        self._wait(sources)
        if late.any():
            yield self._judged(attempts[attempts["source"].isin(sources.loc[late, "source"])], sources[late], True)

    def close(self) -> None:
        pass


def source_health(runs: DataFrame, with_future: DataFrame, overdue: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """(source, failures, items, unchanged_days, state, overdue) after each micro-batch, from the last attempts kept in state.

    ``with_future`` has the sources that still announce something. A source is overdue once
    the watermark, ``late`` behind the newest attempt of all, is ``overdue`` past its last
    attempt; the next attempt ends that.
    """
    known = with_future.select("source").distinct().withColumn("future", F.lit(True))
    rows = runs.join(known, "source", "left").select(_group("source").alias("group"), "source", *_ATTEMPT, F.coalesce("future", F.lit(False)).alias("future"))
    timed = overdue is not None
    rows = rows.withWatermark("at", late) if timed else rows
    return rows.groupBy("group").transformWithStateInPandas(
        _Health(overdue), "source long, failures long, items long, unchanged_days long, state string, overdue boolean", "Update", "EventTime" if timed else "None"
    )


class _Missing(StatefulProcessor):
    """The absences of a group's items as one value of state."""

    KEYS = ["source", "item"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("missing", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order, never, seen, absent = ["at", "event_id"], np.iinfo("int64").min, None, None
        for piece in rows:
            piece = piece.assign(at=piece["at"].astype("datetime64[us]").astype("int64"), item=piece["item"].astype(float))
            here = piece["event_type"].isin(("view", "click"))
            met = piece.assign(**{c: piece[c].where(here, never) for c in order})[[*self.KEYS, *order]]
            seen = (met if seen is None else pd.concat([seen, met])).sort_values(order).drop_duplicates(self.KEYS, keep="last")
            new = piece.loc[~here & piece["ok"].astype(bool), [*self.KEYS, *order]]
            absent = (new if absent is None else pd.concat([absent, new])).merge(seen, on=self.KEYS, suffixes=("", "_seen"))
            after = (absent["at"] > absent["at_seen"]) | ((absent["at"] == absent["at_seen"]) & (absent["event_id"] > absent["event_id_seen"]))
            absent = absent.loc[after, [*self.KEYS, *order]]
        counted = seen.merge(absent.groupby(self.KEYS, dropna=False).size().rename("missing").reset_index(), on=self.KEYS, how="left")
        before = _unpacked(self.counts)
        if before is not None:
            past = counted[self.KEYS].merge(before, on=self.KEYS, how="left")["missing"].fillna(0)
            counted["missing"] = counted["missing"].fillna(0) + past.where(counted["at"] == never, 0)
        counted = counted.assign(missing=counted["missing"].fillna(0).astype("int64"))[[*self.KEYS, "missing"]]
        self.counts.update((_packed(counted if before is None else pd.concat([before, counted]).drop_duplicates(self.KEYS, keep="last")),))
        yield counted.astype({"source": "Int64", "item": "Int32"})

    def close(self) -> None:
        pass


def missing_runs(runs: DataFrame) -> DataFrame:
    """(source, item, missing): absences in a row, in the order of micro-batches and in each by time and id; a sighting resets them, failed attempts don't count."""
    rows = runs.select(_group("source").alias("group"), "source", "item", "at", "event_id", "event_type", "ok")
    return rows.groupBy("group").transformWithStateInPandas(_Missing(), "source long, item int, missing long", "Update", "None")


def inbox_dedup(runs: DataFrame) -> DataFrame:
    """(url): each submitted URL once; repeats within two days are dropped by the watermark."""
    urls = runs.select(F.concat_ws("/", F.to_date("at").cast("string"), F.col("source").cast("string")).alias("url"), "at")
    return urls.withWatermark("at", "2 days").dropDuplicatesWithinWatermark(["url"]).select("url")


def retry_queue(runs: DataFrame, most: int = 3) -> DataFrame:
    """(source, state): candidate once a purchase is seen, failed after ``most`` failures without one, else new."""
    tried = runs.groupBy("source").agg(F.count_if(~F.col("ok")).alias("failures"), F.bool_or(F.col("event_type") == "purchase").alias("done"))
    return tried.select("source", F.when(F.col("done"), "candidate").when(F.col("failures") >= most, "failed").otherwise("new").alias("state"))


def versions(spark: SparkSession, stream: DataFrame, folder: str, schema: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``merged(table, batch)`` of each micro-batch is the next version of a table in ``folder``; the last is returned, an empty one if there was none.

    A micro-batch that is repeated after a crash starts from the version before it again; older versions than that one go.
    """

    def version(last: int | None = None) -> DataFrame:
        known = [n for n in numbered(spark, folder, "version") if last is None or n <= last]
        return spark.read.schema(schema).parquet(f"{folder}/version={max(known)}") if known else spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        merged(version(number - 1), batch).write.mode("overwrite").parquet(f"{folder}/version={number}")
        for n in numbered(spark, folder, "version"):
            if n < number - 1:
                remove(spark, f"{folder}/version={n}")

    stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return version()


def catalog_ingest(spark: SparkSession, runs: DataFrame, folder: str) -> DataFrame:
    """Each micro-batch is merged into the next version of the table (source, last_id, events); the last version is returned."""
    rules = {"last_id": F.greatest("o.last_id", "n.last_id"), "events": F.coalesce("o.events", F.lit(0)) + F.coalesce("n.events", F.lit(0))}

    def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("source").agg(F.max("event_id").alias("last_id"), F.count("*").alias("events"))
        return merge_by_key(old, new, ["source"], rules).drop("outcome")

    return versions(spark, runs, folder, "source long, last_id long, events long", merged)


def inbox_notes(spark: SparkSession, submitted: DataFrame, folder: str) -> DataFrame:
    """(url, note) of submissions (url, note, at, id): one row a canonical URL, its different note lines in the order they came in, joined by newlines.

    URLs that have no canonical form are left to the caller. Lines are trimmed, and a line that is there already isn't
    added; the note is null where no submission had one. Lines are combined before the shuffle.
    """
    # A submission without a note is a null line, which keeps its URL.
    lines = F.coalesce(F.filter(F.transform(F.split("note", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    known = submitted.select(canonical_url(F.col("url")).alias("url"), lines.alias("lines"), "at", "id").filter("url IS NOT NULL")
    rows = known.select("url", F.posexplode_outer("lines").alias("k", "line"), "at", "id")
    first = rows.select("url", "line", F.struct("at", "id", F.coalesce("k", F.lit(0)).alias("k")).alias("first"))

    def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
        return old.unionByName(batch).groupBy("url", "line").agg(F.min("first").alias("first"))

    table = versions(spark, first, folder, "url string, line string, first struct<at:timestamp,id:long,k:int>", merged)
    ordered = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("first", "line"))))
    return table.groupBy("url").agg(F.nullif(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("")).alias("note"))
