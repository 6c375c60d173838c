"""Sources that share state by groups are judged as each by itself."""

from statistics import median

import numpy as np
import pandas as pd

from catlake.streaming import stateful as st


def plainly(a, future):
    """The rules of a source's state, attempt by attempt."""
    ok, items, hashes, fill, at = (a[c].tolist() for c in ("ok", "items", "hash", "fill", "at"))
    failures = next((n for n, x in enumerate(ok) if x), len(ok))
    usable = [i for i in range(1, len(ok)) if items[i] > 0][: st.BASELINE_RUNS]
    base, fills = (median([items[i] for i in usable]) if usable else None), [fill[i] for i in usable if fill[i] == fill[i]]
    base_fill, now = (median(fills) if fills else 0), (items[0] if items[0] == items[0] else None)
    same = next((n for n, x in enumerate(hashes) if x != hashes[0]), len(hashes)) if hashes[0] == hashes[0] else 0
    days = (at[0] // 1_000_000 - at[same - 1] // 1_000_000) // 86400 if same >= 2 else None
    judged = base is not None and base >= st.LOW_BASELINE and now is not None
    state = "broken" if failures >= st.BROKEN_AFTER else "suspect" if judged and now == 0 else "degraded" if judged and now < st.DEGRADED_RATIO * base else \
        "schema-drift" if now and base_fill > 0 and fill[0] < st.DRIFT_RATIO * base_fill else "stale" if days is not None and days > st.STALE_DAYS and not future else "healthy"
    return failures, None if now is None else int(now), days, state


def test_many_sources_at_once():
    rng, nan, parts, futures = np.random.default_rng(7), float("nan"), [], []
    for source in range(400):
        n = int(rng.integers(1, 61))
        ok = rng.random(n) < rng.choice([0.3, 0.9, 1.0])
        items = np.where(ok, rng.integers(0, rng.choice([2, 5, 40]), n).astype(float), nan)
        fill = np.where(ok & (items > 0), rng.choice([0.0, 0.5, 1.0], n), nan)
        hashes = np.where(rng.random(n) < 0.05, nan, rng.integers(0, rng.choice([1, 3]), n).astype(float))
        at = np.sort(rng.integers(0, 90 * 86_400_000_000, n))[::-1]
        parts.append(pd.DataFrame({"source": source, "at": at, "event_id": range(n), "ok": ok, "items": items, "hash": hashes, "fill": fill}))
        futures.append(source % 5 == 0)
    got = st.judge_all(pd.concat(parts, ignore_index=True), pd.DataFrame({"source": range(400), "future": futures}))
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in got.drop(columns="source").itertuples(index=False)]
    assert rows == [plainly(a, f) for a, f in zip(parts, futures, strict=True)]
    assert len({r[3] for r in rows}) == 6


def test_missing_runs_call_python_once_a_group(spark, tmp_path, monkeypatch):
    """Items of every source, null ones included, in few groups; a sighting in a later micro-batch resets, another absence adds."""
    import datetime

    monkeypatch.setattr(st, "GROUPS", 2)
    kinds, schema = ["view", "signup", "error", "purchase"], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i // 3), None if i % 31 == 0 else 2**60 + i % 31, kinds[(i * 7 + i // 5) % 4], 0.0, "{}" if i % 11 == 0 else f'{{"k": {i % 4}}}') for i in range(900)]
    for part in (rows[:400], rows[400:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.missing_runs(st.read_runs(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1))
    assert "transformWithStateUDF(group" in stream._jdf.queryExecution().toString()
    got = {(r["source"], r["item"]): r["missing"] for r in st.drain(spark, stream, "update", f"{tmp_path}/out", ("source", "item")).collect()}
    expected = {}
    for i, _, source, kind, _, props in rows:
        key = (source, None if props == "{}" else (i % 4) % 3)
        expected[key] = 0 if kind == "view" else expected.get(key, 0) + (kind != "error")
    assert got == expected


def test_retries_are_aggregated_without_python(spark, tmp_path):
    schema = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").schema
    stream = st.retry_queue(st.read_runs(spark, str(tmp_path), schema))
    assert "transformWithState" not in stream._jdf.queryExecution().toString()
