"""Streams that stop, crash and go on give what one run without a break gives."""

import collections
import datetime
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catlake.streaming import stateful as st

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY = datetime.datetime(2024, 1, 1)


def events(spark, folder, rows):
    """One file of events (id, day, source, kind, k, value), which a stream takes as one micro-batch."""
    made = [(i, DAY + timedelta(days=d), u, kind, v, f'{{"k": {k}}}') for i, d, u, kind, k, v in rows]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def parts():
    kinds = ["view", "signup", "error", "purchase", "click", "signup"]
    rows = [(i, i // 20, i % 7, kinds[(i * 5 + i // 11) % 6], (i * 13) % 10, 20.0 * (i // 90)) for i in range(600)]
    return [rows[:250], rows[250:300], rows[300:470], rows[470:]]


JOBS = {
    "health": (lambda r: st.source_health(r, r.sparkSession.createDataFrame([(3,)], "source long"), timedelta(days=2)), ("source",)),
    "missing": (st.missing_runs, ("source", "item")),
    "retry": (st.retry_queue, ("source",)),
}


def run(spark, job, arrived, folder, spark_schema):
    made, keys = JOBS[job]
    return sorted(map(tuple, st.drain(spark, made(st.read_runs(spark, arrived, spark_schema, 1)), "update", folder, keys).collect()), key=str)


@pytest.mark.parametrize("job", JOBS)
def test_stop_and_resume(spark, tmp_path, parts, job):
    """Files that arrive between three calls, against one call over all of them."""
    schema = spark.createDataFrame([], EVENTS).schema
    for k, rows in enumerate(parts):
        events(spark, f"{tmp_path}/all", rows)
        events(spark, f"{tmp_path}/some", rows)
        if k != 1:
            found = run(spark, job, f"{tmp_path}/some", f"{tmp_path}/resumed", schema)
    assert found == run(spark, job, f"{tmp_path}/all", f"{tmp_path}/whole", schema)
    assert found == run(spark, job, f"{tmp_path}/some", f"{tmp_path}/resumed", schema)  # nothing new: the same rows


@pytest.mark.parametrize("job", ["health", "missing"])
def test_crash_after_a_batch_s_output(spark, tmp_path, parts, job, monkeypatch):
    """The second micro-batch's rows are written, then the run breaks off before they are committed; the next run repeats them."""
    schema = spark.createDataFrame([], EVENTS).schema
    for rows in parts:
        events(spark, f"{tmp_path}/in", rows)
    made, keys = JOBS[job]

    class Crash(Exception):
        pass

    with monkeypatch.context() as m:
        numbered = st.numbered

        def crash(spark, folder, name):
            if name == "batch" and 1 in numbered(spark, folder, name):
                raise Crash
            return numbered(spark, folder, name)

        m.setattr(st, "numbered", crash)
        m.setattr(st, "COMPACT_AFTER", 2)
        with pytest.raises(StreamingQueryException):
            st.drain(spark, made(st.read_runs(spark, f"{tmp_path}/in", schema, 1)), "update", f"{tmp_path}/broken", keys)
    found = run(spark, job, f"{tmp_path}/in", f"{tmp_path}/broken", schema)
    assert found == run(spark, job, f"{tmp_path}/in", f"{tmp_path}/whole", schema)


def test_rows_are_brought_together(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(st, "COMPACT_AFTER", 2)
    schema = spark.createDataFrame([], EVENTS).schema
    for rows in parts:
        for k in range(0, len(rows), 100):
            events(spark, f"{tmp_path}/in", rows[k : k + 100])
    found = run(spark, "missing", f"{tmp_path}/in", f"{tmp_path}/often", schema)
    assert st.numbered(spark, f"{tmp_path}/often/whole", "upto") and 0 not in st.numbered(spark, f"{tmp_path}/often/rows", "batch")
    monkeypatch.setattr(st, "COMPACT_AFTER", 1000)
    assert found == run(spark, "missing", f"{tmp_path}/in", f"{tmp_path}/seldom", schema)


def test_versions_go_on(spark, tmp_path, parts):
    schema = spark.createDataFrame([], EVENTS).schema
    counts, last = collections.Counter(), {}
    for rows in parts:
        events(spark, f"{tmp_path}/in", rows)
        for i, _, source, *_ in rows:
            counts[source] += 1
            last[source] = max(i, last.get(source, -1))
        got = st.catalog_ingest(spark, st.read_runs(spark, f"{tmp_path}/in", schema), f"{tmp_path}/table").collect()
        assert {r["source"]: (r["last_id"], r["events"]) for r in got} == {s: (last[s], n) for s, n in counts.items()}
    assert len(st.numbered(spark, f"{tmp_path}/table", "version")) == 2


def test_overdue_and_back(spark, tmp_path):
    """A source without an attempt is overdue once the others' time has gone on; the next attempt ends that."""
    schema = spark.createDataFrame([], EVENTS).schema
    events(spark, f"{tmp_path}/in", [(1, 0, 1, "view", 5, 0.0), (2, 0, 2, "view", 5, 0.0)])
    health = lambda: {r[0]: r[-1] for r in run(spark, "health", f"{tmp_path}/in", f"{tmp_path}/out", schema)}
    assert health() == {1: False, 2: False}
    events(spark, f"{tmp_path}/in", [(3, 1, 2, "view", 5, 0.0), (4, 9, 2, "view", 5, 0.0)])
    assert health() == {1: True, 2: False}
    events(spark, f"{tmp_path}/in", [(5, 10, 1, "view", 5, 0.0)])
    assert health() == {1: False, 2: False}


def test_judge_at_the_bounds():
    def judged(ok=(True,) * 5, items=(5.0,) * 5, days=(0,) * 5, hashes=None, fill=(1.0,) * 5, future=False):
        hashes = hashes or [float(i) for i in range(len(ok))]
        at = [-int(d * 86_400_000_000) for d in days]
        return st.judge(pd.DataFrame({"at": at, "event_id": range(len(ok)), "ok": ok, "items": items, "hash": hashes, "fill": fill}), future)

    nan = float("nan")
    assert judged() == (0, 5, None, "healthy")
    assert judged(ok=(False, False, True, True, True), items=(nan, nan, 5.0, 5.0, 5.0))[3] == "healthy"
    assert judged(ok=(False, False, False, True, True), items=(nan, nan, nan, 5.0, 5.0))[::3] == (3, "broken")
    assert judged(items=(0.0, 3.0, 3.0, 3.0, 0.0))[3] == "suspect" and judged(items=(0.0, 2.0, 2.0, 2.0, 0.0))[3] == "healthy"
    assert judged(items=(1.0, 5.0, 5.0, 5.0, 5.0))[3] == "degraded" and judged(items=(2.0, 5.0, 5.0, 5.0, 5.0))[3] == "healthy"
    assert judged(fill=(0.79, 1.0, 1.0, 1.0, 1.0))[3] == "schema-drift" and judged(fill=(0.8, 1.0, 1.0, 1.0, 1.0))[3] == "healthy"
    same = [7.0] * 5
    assert judged(days=(0, 10, 20, 30, 31), hashes=same)[2:] == (31, "stale")
    assert judged(days=(0, 10, 20, 25, 30), hashes=same)[2:] == (30, "healthy")
    assert judged(days=(0, 10, 20, 30, 31), hashes=same, future=True)[2:] == (31, "healthy")
