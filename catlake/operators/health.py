"""Health of sources from their run history, and what absence implies.

A history has one row an attempt: source, id, fetched_at, ok, items, hash and fill rates.
Only the last ``LOOKBACK`` attempts of each source count; the rank filter is pushed
before the shuffle, so a source with very many attempts doesn't gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import elapsed_days
from .merge import merge_by_key

#: Limits of the rules; fixed values.
LOOKBACK, BASELINE_RUNS, BROKEN_AFTER, LOW_BASELINE = 60, 10, 3, 3
DEGRADED_RATIO, DRIFT_RATIO, STALE_DAYS, MISSING_RUNS, OVERDUE_FACTOR = 0.4, 0.8, 30, 2, 2.0
#: States from the worst to the best; fixed values.
SEVERITY = ("broken", "suspect", "degraded", "schema-drift", "stale", "healthy", "unchecked")


def fetch_ok(status: Column, error: Column) -> Column:
    return F.coalesce(status.between(200, 399) & (error.isNull() | (error == "")), F.lit(False))


def run_history(runs: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The last attempts of each source with their rank ``n``, the newest first."""
    newest = Window.partitionBy("source").orderBy(F.desc("fetched_at"), F.desc("id"))
    return runs.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= lookback)


def signals(runs: DataFrame, fills: list[str]) -> DataFrame:
    """One row a source: failures in a row, last success and items, baselines, drifted fields, unchanged runs and days.

    All windows share one partitioning and order, so there is one shuffle.
    """
    down = Window.partitionBy("source").orderBy("n")
    usable = (F.col("n") > 1) & (F.col("items") > 0)
    rows = (
        run_history(runs)
        .withColumn("k", F.when(usable, F.sum(F.when(usable, 1).otherwise(0)).over(down)))
        .withColumn("other", F.max((~F.col("hash").eqNullSafe(F.first("hash").over(down))).cast("int")).over(down))
    )
    newest = F.col("n") == 1
    same = F.col("other") == 0
    base = lambda c: F.median(F.when(F.col("k") <= BASELINE_RUNS, F.col(c)))
    out = rows.groupBy("source").agg(
        F.count("*").alias("runs"),
        F.max("fetched_at").alias("checked_at"),
        F.coalesce(F.min(F.when(F.col("ok"), F.col("n"))) - 1, F.max("n")).cast("long").alias("failures"),
        F.max(F.when(F.col("ok"), F.col("fetched_at"))).alias("last_success_at"),
        F.max(F.when(F.col("items") > 0, F.col("fetched_at"))).alias("last_item_at"),
        F.max(F.when(newest, F.col("items"))).alias("items"),
        base("items").alias("baseline"),
        F.count_if(same & F.col("hash").isNotNull()).alias("unchanged_runs"),
        F.max(F.when(same & F.col("hash").isNotNull(), F.col("fetched_at"))).alias("_last"),
        F.min(F.when(same & F.col("hash").isNotNull(), F.col("fetched_at"))).alias("_first"),
        *[base(c).alias(f"base_{c}") for c in fills],
        *[F.max(F.when(newest, F.col(c))).alias(f"now_{c}") for c in fills],
    )
    drifted = [F.when((F.col("items") > 0) & (F.col(f"base_{c}") > 0) & (F.col(f"now_{c}") < DRIFT_RATIO * F.col(f"base_{c}")), F.lit(c)) for c in fills]
    return out.withColumn("drifted", F.array_compact(F.array(*drifted))).withColumn(
        "unchanged_days", F.when(F.col("unchanged_runs") >= 2, elapsed_days(F.col("_first"), F.col("_last")))
    ).drop("_first", "_last")


def decide(future: Column) -> Column:
    """The state from the signals, by the first rule that fits."""
    judged = F.coalesce(F.col("baseline") >= LOW_BASELINE, F.lit(False))
    return (
        F.when(F.coalesce(F.col("runs"), F.lit(0)) == 0, "healthy")
        .when(F.col("failures") >= BROKEN_AFTER, "broken")
        .when(judged & (F.col("items") == 0), "suspect")
        .when(judged & (F.col("items") < DEGRADED_RATIO * F.col("baseline")), "degraded")
        .when(F.size("drifted") > 0, "schema-drift")
        .when((F.col("unchanged_days") > STALE_DAYS) & ~future, "stale")
        .otherwise("healthy")
    )


def reason(state: Column) -> Column:
    """Why a source has its state, from the signals; null for a healthy one."""
    usual = F.round("baseline").cast("long").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(state == "broken", text(F.col("failures"), " failed attempts in a row"))
        .when(state == "suspect", text("no items, usually ", usual))
        .when(state == "degraded", text(F.col("items"), " items, usually ", usual))
        .when(state == "schema-drift", text("fields filled less than usual: ", F.array_join("drifted", ", ")))
        .when(state == "stale", text("unchanged for ", F.col("unchanged_days"), " days, nothing ahead"))
    )


def source_health(runs: DataFrame, fills: list[str], with_future: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Signals, state and its reason of every source; ``with_future`` has the sources that still announce something.

    ``seeds`` (source, baseline) gives a baseline to sources whose own history has none yet; a seeded source
    without any attempt is a row without signals, and healthy.
    """
    marked = signals(runs, fills)
    if seeds is not None:
        seeded = seeds.groupBy("source").agg(F.max("baseline").alias("_seed"))
        marked = marked.join(seeded, "source", "full_outer").withColumns({
            "baseline": F.coalesce("baseline", "_seed"), "runs": F.coalesce("runs", F.lit(0).cast("long")), "drifted": F.coalesce("drifted", F.array().cast("array<string>")),
        }).drop("_seed")
    marked = marked.join(with_future.select("source").distinct().withColumn("_f", F.lit(True)), "source", "left")
    return marked.withColumn("future", F.coalesce("_f", F.lit(False))).drop("_f").withColumn("state", decide(F.col("future"))).withColumn("reason", reason(F.col("state")))


def first_alerted_at(old_state: Column, old_alert: Column, state: Column, now: Column) -> Column:
    """None while healthy; the time of leaving health, kept until it returns."""
    return F.when(state == "healthy", None).when(old_alert.isNull() | (old_state == "healthy"), now).otherwise(old_alert)


def health_upsert(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """The next version of the stored health (source, state, last_success_at, last_item_at, baseline, first_alerted_at)."""
    alert = F.when(F.col("n._new").isNull(), F.col("o.first_alerted_at")).otherwise(first_alerted_at(F.col("o.state"), F.col("o.first_alerted_at"), F.col("n.state"), now))
    rules = {"state": "new", "last_success_at": "coalesce_new_old", "last_item_at": "coalesce_new_old", "baseline": "coalesce_new_old", "first_alerted_at": alert}
    return merge_by_key(stored, fresh, ["source"], rules)


def seed_state(stored: DataFrame, seeds: DataFrame, fields: list[str]) -> DataFrame:
    """Stored rows with only their empty fields filled from the seeds; a seed of an unknown source is listed as skipped, as it stands."""
    merged = merge_by_key(stored, seeds, ["source"], {f: "coalesce_old_new" for f in fields})
    return merged.select("source", *fields, (F.col("outcome") == "created").alias("skipped"))


def severity(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), state)


def health_report(sources: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """All sources (source, interval), also those never checked, with days since items and check, and whether a check is overdue."""
    rows = sources.join(health, "source", "left")
    since = elapsed_days(F.col("checked_at"), now)
    return rows.select(
        "source",
        F.when(F.col("checked_at").isNull(), "unchecked").otherwise(F.col("state")).alias("state"),
        elapsed_days(F.col("last_item_at"), now).alias("days_since_item"),
        since.alias("days_since_check"),
        F.coalesce(since > OVERDUE_FACTOR * F.col("interval"), F.lit(False)).alias("overdue"),
    )


def repair_queue(report: DataFrame) -> DataFrame:
    """Sources that need work: the worst state first, then the longest without items."""
    return report.filter("state NOT IN ('healthy', 'unchecked')").orderBy(severity(F.col("state")), F.desc_nulls_last("days_since_item"), "source")


def due_sources(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Enabled sources that were never tried, or whose interval has passed since the last attempt."""
    last = runs.groupBy("source").agg(F.max("fetched_at").alias("last"))
    passed = F.unix_timestamp("last") + F.col("interval") * 86400 <= F.unix_timestamp(now)
    return sources.join(last, "source", "left").filter(F.col("enabled") & (F.col("last").isNull() | passed))


def missing_runs(sightings: DataFrame) -> DataFrame:
    """(source, item, missing): absences since the item was last seen, counted over healthy runs only.

    ``sightings`` has a row for each item and run: source, item, id, seen, healthy.
    """
    last = sightings.groupBy("source", "item").agg(F.max(F.when(F.col("seen") & F.col("healthy"), F.col("id"))).alias("_last"))
    since = sightings.filter(F.col("healthy") & ~F.col("seen")).join(last, ["source", "item"])
    absent = since.filter(F.col("_last").isNull() | (F.col("id") > F.col("_last"))).groupBy("source", "item").agg(F.count("*").alias("missing"))
    return last.select("source", "item").join(absent, ["source", "item"], "left").select("source", "item", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"))


def fetched_window(links: DataFrame, today: Column) -> DataFrame:
    """(source, first, last): today to the farthest day a source still announces; none if there is nothing ahead.

    ``links`` has source, item, day and missing.
    """
    ahead = links.groupBy("source").agg(F.max(F.when(F.col("missing") == 0, F.col("day"))).alias("last"))
    return ahead.filter(F.col("last") >= today).select("source", today.alias("first"), "last")


def derive_cancellations(links: DataFrame, states: DataFrame, today: Column) -> DataFrame:
    """Every decision on items that are missing: cancelled only for a healthy source, a day inside its window and enough absences."""
    rows = links.filter("missing > 0").join(states.select("source", "state"), "source", "left").join(fetched_window(links, today), "source", "left")
    reason = (
        F.when(~F.col("state").eqNullSafe("healthy"), "source-unhealthy")
        .when(F.col("last").isNull(), "no-window")
        .when(~F.col("day").between(F.col("first"), F.col("last")), "outside-window")
        .when(F.col("missing") < MISSING_RUNS, "too-few-absences")
        .otherwise("cancelled")
    )
    return rows.select("source", "item", "missing", reason.alias("reason"), (reason == "cancelled").alias("cancelled"))


def structure_compare(expected: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, issue) between two shape profiles (keys, field, kinds, fill): missing fields, other kinds, fill rates that dropped."""
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "field")]
    both = expected.alias("e").join(current.alias("c"), on, "full_outer")
    kinds = lambda c: F.split(F.col(c), ",")
    odd = F.size(F.array_except(kinds("c.kinds"), kinds("e.kinds"))) > 0
    issue = F.array_compact(
        F.array(
            F.when(F.col("c.field").isNull() | ((F.col("c.fill") == 0) & (F.col("e.fill") > 0)), F.lit("missing-field")),
            F.when((F.col("e.kinds") != "") & (F.col("c.kinds") != "") & odd, F.lit("incompatible-kinds")),
            F.when((F.col("e.fill") > 0) & (F.col("c.fill") < DRIFT_RATIO * F.col("e.fill")), F.lit("fill-rate-drop")),
        )
    )
    return both.select(*[F.coalesce(f"e.{k}", f"c.{k}").alias(k) for k in (*keys, "field")], F.explode(issue).alias("issue"))


def drift_classify(fixture_matches: Column, extraction_failed: Column, ok: Column, state: Column) -> Column:
    """What a live check means: whose fault it is, or none."""
    return (
        F.when(~fixture_matches, "code-regression")
        .when(extraction_failed, "source-change")
        .when(~ok & (state == "broken"), "source-access-failure")
        .when(~ok, "transient-fetch-failure")
        .when(state.isin("suspect", "degraded", "schema-drift"), "source-change")
        .when(state == "broken", "source-access-failure")
        .when(state == "stale", "source-content-stale")
        .otherwise("healthy")
    )


def output_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): rows added, removed or changed between two extractions."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields])), ",")
    change = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(changed != "", "changed")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), F.when(change == "changed", changed).alias("fields")).filter("change IS NOT NULL")


#: Weights of a plan's factors and shares of its tiers; fixed values.
FACTORS = {"days_since_check": 0.40, "event_yield": 0.20, "season": 0.15, "gap": 0.15, "new_source": 0.10}
SHARES = {1: 0.35, 2: 0.35, 3: 0.30}


#: Rows that one round of the plan looks at.
AT_ONCE = 1000


@dataclass(frozen=True)
class Limits:
    """What a plan may take at most, and the districts it needs at least; every region has to be among its places."""

    places: int = 30
    queries: int = 180
    candidates: int = 120
    new_sources: int = 25
    districts: int = 4


def plan_batch(places: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(place, tier, district, region, queries, candidates, new_sources, priority, spent) of the places to visit, in the order of choice.

    ``places`` has these columns but the last two, and the factors, each between 0 and 1. The
    best place of each region comes first, then the best of each of the best districts, then
    the others by priority. A place is taken if its tier's share and every limit still hold
    with it, and passed over if not, so a dear place doesn't end the plan. Each round takes
    from Spark the first rows of those that still fit one by one, so it chooses at least
    one, and there are as many rounds as places at most.
    """
    score = sum(F.col(f) * w for f, w in FACTORS.items())
    columns = ["place", "tier", "district", "region", "queries", "candidates", "new_sources"]
    rated = places.select(*columns, F.round(score, 6).alias("priority"))
    best = lambda by: rated.groupBy(by).agg(F.min_by(F.struct("place", "priority"), F.struct(-F.col("priority"), F.col("place"))).alias("b"))
    firsts = best("region").select(F.col("b.place").alias("_first"), F.lit(0).alias("_ahead"))
    top = best("district").orderBy(F.desc("b.priority"), "district").limit(limits.districts).select(F.col("b.place").alias("_first"), F.lit(1).alias("_ahead"))
    seeds = firsts.unionByName(top).groupBy("_first").agg(F.min("_ahead").alias("_ahead"))
    rated = rated.join(seeds, F.col("place") == F.col("_first"), "left").withColumn("_ahead", F.coalesce("_ahead", F.lit(2))).drop("_first")
    left = {"queries": limits.queries, "candidates": limits.candidates, "new_sources": limits.new_sources}
    quota = {tier: int(share * limits.places + 0.5) for tier, share in SHARES.items()}
    chosen: list[tuple] = []
    last: tuple | None = None
    while len(chosen) < limits.places:
        open_tiers = [t for t, n in quota.items() if n]
        fits = F.col("tier").isin(*open_tiers)
        for c, n in left.items():
            fits = fits & (F.col(c) <= n)
        if last is not None:
            order = F.struct("_ahead", (-F.col("priority")).alias("p"), "place")
            fits = fits & (order > F.struct(F.lit(last[0]).alias("_ahead"), F.lit(-last[1]).alias("p"), F.lit(last[2]).cast(rated.schema["place"].dataType).alias("place")))
        rows = rated.filter(fits).orderBy("_ahead", F.desc("priority"), "place").limit(AT_ONCE).collect() if open_tiers else []
        if not rows:
            break
        for r in rows:
            last = (r["_ahead"], r["priority"], r["place"])
            if len(chosen) < limits.places and quota.get(r["tier"], 0) and all(r[c] <= n for c, n in left.items()):
                quota[r["tier"]] -= 1
                left = {c: n - r[c] for c, n in left.items()}
                chosen.append((*[r[c] for c in columns], r["priority"], limits.queries - left["queries"]))
    schema = T.StructType([rated.schema[c] for c in (*columns, "priority")]).add("spent", "long")
    return places.sparkSession.createDataFrame(chosen, schema)
