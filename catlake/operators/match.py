"""Entity matching in hard blocks, decision bands, and what follows from a decision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alike
from ..functions.text import fold, letter_counts, similarity_bound, similarity_of
from ..sources.files import work_folder
from .merge import merge_by_key

#: Bands and weights; fixed values.
AUTO, REVIEW = 0.92, 0.75
TITLE, TIME, VENUE = 0.70, 0.15, 0.15


def distinct_titles(rows: DataFrame, block: list[str]) -> DataFrame:
    """One row for each title of a block (id: its smallest, copies): equal titles are scored once, however many share them."""
    return rows.groupBy(*block, "title_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def block_pairs(candidates: DataFrame, records: DataFrame, block: list[str]) -> DataFrame:
    """Pairs that agree on every part of the block; a null in it never pairs."""
    c = candidates.select(*[F.col(k) for k in block], *[F.col(k).alias(f"c_{k}") for k in candidates.columns if k not in block])
    r = records.select(*[F.col(k) for k in block], *[F.col(k).alias(f"r_{k}") for k in records.columns if k not in block])
    return c.join(r, block)


def salted_pairs(candidates: DataFrame, records: DataFrame, block: list[str], most: int = 200) -> DataFrame:
    """``block_pairs`` with hot blocks split: the candidates of a block are dealt over parts of about ``most``, its records go to every part."""
    parts = candidates.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    c = candidates.join(parts, block).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    r = records.join(parts, block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return block_pairs(c, r, [*block, "_part"]).drop("_part")


def time_similarity(a: Column, b: Column, reach: int = 180) -> Column:
    """1 for the same minute of the day, down to 0 at ``reach`` minutes; no wrap at midnight; 0 without a time."""
    minutes = lambda t: F.hour(t) * 60 + F.minute(t)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(minutes(a) - minutes(b)) / reach), F.lit(0.0))


def rounded(x: Column, places: int = 4) -> Column:
    """To so many places; the double itself decides a tie, scaled up, and not its shortest decimal form."""
    return F.round(x * 10**places) / 10**places


def match_score(title: Column, time: Column, venue: Column) -> Column:
    """The weighted mean, without the venue where it is null, to four places."""
    both = (TITLE * title + TIME * time + VENUE * venue) / (TITLE + TIME + VENUE)
    return rounded(F.when(venue.isNotNull(), both).otherwise((TITLE * title + TIME * time) / (TITLE + TIME)))


def title_score(title: np.ndarray) -> np.ndarray:
    """``match_score`` of titles alone, as for an equal time and no venue."""
    return np.floor((TITLE * title + TIME) / (TITLE + TIME) * 10000 + 0.5) / 10000


def decision(score: Column) -> Column:
    return F.when(score >= AUTO, "auto-merge").when(score >= REVIEW, "review").otherwise("separate")


def _best(pairs: DataFrame, exact, parts: list[str]) -> DataFrame:
    """(c_id, and of its best pair r_id, score and ``parts``), the highest score first and then the least r_id.

    ``pairs`` has ``bound``, which no score of the pair exceeds. Each candidate's pair of the
    highest bound is scored first; of the others only those whose bound reaches that score
    can be the best, and only they are scored. ``exact`` adds score and parts.
    """
    first = F.max_by(F.struct(*[c for c in pairs.columns if c != "c_id"]), F.struct(F.coalesce("bound", F.lit(2.0)), -F.col("r_id")))
    reached = exact(pairs.groupBy("c_id").agg(first.alias("_p")).select("c_id", "_p.*")).select("c_id", F.col("score").alias("reached"))
    open_ = pairs.join(reached, "c_id").filter(F.col("bound").isNull() | (F.col("bound") >= F.coalesce("reached", F.lit(0.0))))
    best = F.min_by(F.struct("r_id", "score", *parts), F.struct(-F.col("score"), "r_id"))
    return exact(open_).groupBy("c_id").agg(best.alias("_r")).select("c_id", "_r.*")


def _bounded(rows: DataFrame, *texts: str) -> DataFrame:
    """Letter counts beside texts, made once a row and not once a pair or pass, and written, as both passes read them."""
    folder = work_folder(rows.sparkSession, "titles")
    rows.withColumns({f"{t}_n": letter_counts(F.col(t)) for t in texts}).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _bound(text: str) -> Column:
    return similarity_bound(F.col(f"c_{text}"), F.col(f"r_{text}"), F.col(f"c_{text}_n"), F.col(f"r_{text}_n"))


def _cells(candidates: DataFrame, records: DataFrame, block: list[str], judge: Callable, schema: str, most: tuple[int, int], letters: int = 500_000) -> DataFrame:
    """``judge(ids, titles, ids, titles)`` of the candidates and records of every cell of a block.

    A block's candidates and records are both dealt over parts, of about ``most`` rows or ``letters``
    letters at most, and each pair of parts is a cell, so that no block has to fit one task. Rows travel
    once for each part of the other side, pairs never. The tables should be written ones, as they are read twice.
    """
    sides, sizes = (candidates, records), []
    for side, rows, n in zip("cr", sides, most, strict=True):
        parts = F.greatest(F.ceil(F.count("*") / n), F.ceil(F.sum(F.char_length("title_key")) / letters), F.lit(1)).cast("int")
        sizes.append(rows.groupBy(*block).agg(parts.alias(f"_n{side}")))
    cells = sizes[0].join(sizes[1], block)
    # Cells are small and take long, so their tasks are counted and not weighed.
    tasks = int(min(max(cells.agg(F.sum(F.col("_nc").cast("long") * F.col("_nr"))).first()[0] or 1, 8), 4000))
    dealt = []
    for mine, other, rows in (("c", "r", sides[0]), ("r", "c", sides[1])):
        at = F.pmod(F.xxhash64("id"), F.col(f"_n{mine}")).cast("int")
        made = rows.join(cells, block).withColumn(f"_{mine}", at).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1)))
        dealt.append(made.select(*block, "_c", "_r", "id", "title_key").repartition(tasks, *block, "_c", "_r").groupBy(*block, "_c", "_r"))

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        return judge(left["id"], left["title_key"].to_pylist(), right["id"], right["title_key"].to_pylist())

    return dealt[0].cogroup(dealt[1]).applyInArrow(judged, schema)


def _written(rows: DataFrame, block: list[str]) -> DataFrame:
    folder = work_folder(rows.sparkSession, "titles")
    rows.select("id", *block, "title_key").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def title_pairs(candidates: DataFrame, records: DataFrame, block: list[str]) -> DataFrame:
    """(c_id, r_id, similarity) of the titles of every pair of a block; null where a title is."""

    def judge(c_ids, c_titles, r_ids, r_titles):
        known = [t or "" for t in c_titles], [t or "" for t in r_titles]
        letters = alike.alphabet(*known)
        c, r = (alike.Letters(t, letters) for t in known)
        null = np.array([t is None for t in r_titles], bool)
        n, cost = len(r_titles), np.cumsum(r.size)
        found = np.empty((len(c_titles), n))
        for i, title in enumerate(c_titles):
            parts = np.searchsorted(cost + c.size[i] * np.arange(1, n + 1), np.arange(1_000_000, cost[-1] + c.size[i] * n, 1_000_000))
            for rows in np.split(np.arange(n), np.unique(parts)):
                if len(rows):
                    found[i, rows] = alike.similarities(c, i, r, rows)
            found[i, null | (title is None)] = np.nan
        shown = found.ravel()
        return pa.table({
            "c_id": c_ids.take(pa.array(np.repeat(np.arange(len(c_titles)), n))), "r_id": r_ids.take(pa.array(np.tile(np.arange(n), len(c_titles)))),
            "similarity": pa.array(shown, mask=np.isnan(shown)),
        })

    sides = _written(candidates, block), _written(records, block)
    return _cells(*sides, block, judge, f"c_id {_kind(candidates)}, r_id {_kind(records)}, similarity double", (1000, 2000))


def match_candidates(candidates: DataFrame, records: DataFrame, block: list[str]) -> DataFrame:
    """(c_id, r_id, title_similarity, score, decision): the best record for each candidate that has any in its block.

    Titles alone are compared here; times of both count as equal and venues as unknown. Pairs with
    a null title have no score and come after all others; of them the least record is named.
    """

    def judge(c_ids, c_titles, r_ids, r_titles):
        letters = alike.alphabet(c_titles, r_titles)
        c, r = alike.Letters(c_titles, letters), alike.Letters(r_titles, letters)
        found = [alike.nearest(c, i, r, title_score) for i in range(len(c_titles))]
        return pa.table({"c_id": c_ids, "r_id": r_ids.take(pa.array([j for j, _ in found], pa.int64())), "title_similarity": pa.array([s for _, s in found], pa.float64())})

    candidates, records = _written(candidates, block), _written(records, block)
    whole = [rows.filter("title_key IS NOT NULL") for rows in (candidates, records)]
    scored = _cells(*whole, block, judge, f"c_id {_kind(candidates)}, r_id {_kind(records)}, title_similarity double", (500, 4000), 2_000_000)
    least = records.groupBy(*block).agg(F.min("id").alias("r_id"))
    unscored = candidates.join(least, block).select(F.col("id").alias("c_id"), "r_id", F.lit(None).cast("double").alias("title_similarity"))
    rows = scored.unionByName(unscored).withColumn("score", match_score(F.col("title_similarity"), F.lit(1.0), F.lit(None).cast("double")))
    first = F.struct(F.col("score").isNull(), -F.col("score"), "r_id")
    best = rows.groupBy("c_id").agg(F.min_by(F.struct("r_id", "title_similarity", "score"), first).alias("_r")).select("c_id", "_r.*")
    return best.select("c_id", "r_id", F.round("title_similarity", 6).alias("title_similarity"), "score", decision(F.col("score")).alias("decision"))


#: Up to so many pairs of different texts are scored once and sent to the tasks; beyond, each pair of records scores its own.
KNOWN_PAIRS = 250_000


def _event_sides(candidates: DataFrame, events: DataFrame, bounded: bool = False, also: tuple[str, ...] = ()) -> list[DataFrame]:
    """Both sides with day, folded title and venue, written once, as they are read several times."""

    def keyed(rows: DataFrame) -> DataFrame:
        venue = F.nullif(F.trim("venue"), F.lit(""))
        made = rows.select("id", F.to_date("start_at").alias("day"), "place_id", "start_at", F.coalesce(fold(F.col("title")), F.lit("")).alias("title"), fold(venue).alias("venue"), *also)
        if bounded:
            return _bounded(made, "title", "venue")
        folder = work_folder(rows.sparkSession, "events")
        made.write.parquet(folder)
        return rows.sparkSession.read.parquet(folder)

    return [keyed(candidates), keyed(events)]


def _event_blocks(sides: list[DataFrame]) -> DataFrame:
    return salted_pairs(*sides, ["day", "place_id"], most=2000)


def _known(sides: list[DataFrame], text: str) -> DataFrame | None:
    """(c_<text>, r_<text>, <text>): the similarity of every candidate's text with every event's, or none if there are more than KNOWN_PAIRS."""
    c, r = (rows.select(F.col(text).alias(f"{side}_{text}")).filter(F.col(f"{side}_{text}").isNotNull()).distinct() for side, rows in zip("cr", sides, strict=True))
    n = [x.limit(KNOWN_PAIRS + 1).count() for x in (c, r)]
    if n[0] * n[1] > KNOWN_PAIRS:
        return None
    return c.crossJoin(F.broadcast(r)).withColumn(text, similarity_of(F.col(f"c_{text}"), F.col(f"r_{text}")))


def _event_scores(pairs: DataFrame, known: dict[str, DataFrame | None] | None = None) -> DataFrame:
    for text in ("title", "venue"):
        of = (known or {}).get(text)
        if of is None:
            pairs = pairs.withColumn(text, similarity_of(F.col(f"c_{text}"), F.col(f"r_{text}")))
        else:
            pairs = pairs.join(F.broadcast(of), [f"c_{text}", f"r_{text}"], "left")
    made = pairs.withColumn("time", time_similarity(F.col("c_start_at"), F.col("r_start_at")))
    return made.withColumn("score", match_score(F.col("title"), F.col("time"), F.col("venue")))


def event_pairs(candidates: DataFrame, events: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Candidates beside the events of their block, the day of the start and the place, with the parts of the score.

    Both sides have id, title, start_at, place_id and venue. A null day or place pairs with nothing.
    Returns c_id, r_id, title, time, venue (null unless both have one), score, and what ``also`` names of both sides.
    """
    sides = _event_sides(candidates, events, also=also)
    known = {text: _known(sides, text) for text in ("title", "venue")}
    return _event_scores(_event_blocks(sides), known).select("c_id", "r_id", "title", "time", "venue", "score", *[f"{side}_{c}" for side in "cr" for c in also])


def match_events(candidates: DataFrame, events: DataFrame, bounded: bool = False) -> DataFrame:
    """(c_id, r_id, score, decision, title, time, venue): the best event of each candidate that has any in its block, and what its score is made of.

    With ``bounded``, only pairs whose bound reaches their candidate's best are scored, at
    the price of a second pass over the pairs, which pays for long titles. Otherwise one pass
    finds each candidate's highest score, and a second one the pairs that have it, so that pairs are
    neither sorted nor shuffled.
    """
    parts = ["title", "time", "venue"]
    sides = _event_sides(candidates, events, bounded)
    if bounded:
        pairs = _event_blocks(sides)
        bound = match_score(_bound("title"), time_similarity(F.col("c_start_at"), F.col("r_start_at")), _bound("venue"))
        pairs = pairs.select("c_id", "r_id", *[f"{side}_{c}" for side in "cr" for c in ("title", "start_at", "venue")], bound.alias("bound"))
        best = _best(pairs, _event_scores, parts)
    else:
        known = {text: _known(sides, text) for text in ("title", "venue")}
        top = _event_scores(_event_blocks(sides), known).groupBy(F.col("c_id").alias("id")).agg(F.max("score").alias("top"))
        reached = _event_scores(_event_blocks([sides[0].join(top, "id"), sides[1]]), known).filter("score = c_top")
        best = reached.groupBy("c_id").agg(F.min_by(F.struct("r_id", "score", *parts), "r_id").alias("_r")).select("c_id", "_r.*")
    shown = [rounded(F.col(c)).alias(c) for c in parts]
    return best.select("c_id", "r_id", "score", decision(F.col("score")).alias("decision"), *shown)


def store_matches(matches: DataFrame, candidates: DataFrame, links: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the matches have been applied: (links, reviews, candidates); none creates an event.

    links (event_id, url, source_id, first_seen, last_seen): an automatic match adds its candidate's source, or
    moves last_seen; a known source and first_seen stay. reviews (candidate_id, event_id, score, state, created): a
    doubtful match adds a pending row, or renews the score of one that is there. candidates (id, source_id, url,
    state, event_id): an automatic match is imported with its event, a doubtful one needs verification.
    """
    own = matches.join(candidates.select(F.col("id").alias("c_id"), "source_id", "url"), "c_id")
    merged = own.filter("decision = 'auto-merge'").groupBy(F.col("r_id").alias("event_id"), "url").agg(F.min("source_id").alias("source_id"))
    new = merged.withColumns({"first_seen": now, "last_seen": now})
    links = merge_by_key(links, new, ["event_id", "url"], {"source_id": "coalesce_old_new", "first_seen": "old", "last_seen": "new"}).drop("outcome")
    doubtful = matches.filter("decision = 'review'").select(F.col("c_id").alias("candidate_id"), F.col("r_id").alias("event_id"), "score", F.lit("pending").alias("state"), now.alias("created"))
    reviews = merge_by_key(reviews, doubtful, ["candidate_id", "event_id"], {"score": "new", "state": "old", "created": "old"}).drop("outcome")
    decided = matches.filter("decision <> 'separate'").select(F.col("c_id").alias("id"), F.when(F.col("decision") == "auto-merge", "imported").otherwise("needs-verification").alias("state"), F.when(F.col("decision") == "auto-merge", F.col("r_id")).alias("event_id"))
    candidates = merge_by_key(candidates, decided.join(candidates.select("id"), "id", "left_semi"), ["id"], {"source_id": F.col("o.source_id"), "url": F.col("o.url"), "state": "new", "event_id": "coalesce_new_old"}).drop("outcome")
    return links, reviews, candidates


def calibration(pairs: DataFrame) -> DataFrame:
    """(same, decision, n, wrong) of scored pairs whose truth ``same`` is known: positives below the automatic band and negatives above the lowest are wrong."""
    made = pairs.withColumn("decision", decision(F.col("score")))
    wrong = F.when(F.col("same"), F.col("decision") != "auto-merge").otherwise(F.col("decision") != "separate")
    return made.groupBy("same", "decision").agg(F.count("*").alias("n")).withColumn("wrong", wrong)


def title_members(rows: DataFrame, block: list[str]) -> DataFrame:
    """(id, representative): each row with the row that stands for its title in ``distinct_titles``; rows whose block or title is null are members too, of groups that pair with nothing."""
    return _spread(rows, distinct_titles(rows, block).select(*block, "title_key", F.col("id").alias("representative")), [*block, "title_key"]).select("id", "representative")


def expand_matches(matches: DataFrame, candidates: DataFrame, block: list[str]) -> DataFrame:
    """``match_candidates`` for every row of ``candidates``: equal titles of a block share what was decided for the one that was scored."""
    members = title_members(candidates, block)
    rest = [c for c in matches.columns if c != "c_id"]
    return _spread(members, matches.withColumnRenamed("c_id", "representative"), ["representative"]).select(F.col("id").alias("c_id"), *rest)


def _spread(rows: DataFrame, one: DataFrame, keys: list[str], parts: int = 16) -> DataFrame:
    """Join many rows to one of each key, for which the key gives way; the rows of a key are dealt over ``parts``, as one title may have most of them."""
    rest = [c for c in one.columns if c not in keys]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256))  # in place of the keys, which may be long; nulls are left out of the text and so equal each other only
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_key", digest).drop(*keys)
    each = one.select(digest.alias("_key"), *rest).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(each, ["_key", "_part"]).select(*[c for c in rows.columns if c not in keys], *rest)


def apply_matches(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, reviews) that follow: a link for each automatic match, a review row for each doubtful one; a separate one gives nothing."""
    links = matches.filter("decision = 'auto-merge'").select(F.col("r_id").alias("record"), F.col("c_id").alias("candidate"))
    reviews = matches.filter("decision = 'review'").select(F.col("c_id").alias("candidate"), F.col("r_id").alias("record"), "score")
    return links, reviews


def review_gate(matches: DataFrame) -> DataFrame:
    """The state of each candidate after matching."""
    state = F.when(F.col("decision") == "auto-merge", "imported").when(F.col("decision") == "review", "needs-verification").otherwise("new")
    return matches.withColumn("state", state)


def merge_copies(copies: DataFrame, key: str, week: str, fields: list[str]) -> DataFrame:
    """Copies of one record as one row, with the weeks it is in, in order."""
    weeks = F.array_join(F.array_sort(F.collect_set(F.col(week).cast("string"))), ",")
    return copies.groupBy(key).agg(*[F.min_by(f, week).alias(f) for f in fields], weeks.alias("week_ids"))


def identity_conflicts(copies: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose copies differ, and in which fields; nulls are values."""
    differs = [F.when((F.min(f) != F.max(f)) | ((F.count(f) > 0) & (F.count(f) < F.count("*"))), F.lit(f)) for f in fields]
    return copies.groupBy(key).agg(F.array_join(F.array_compact(F.array(*differs)), ",").alias("fields")).filter("fields <> ''")


def semantic_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of equal keys with several ids: how many, and the smallest and largest; nulls group together."""
    return rows.groupBy(*keys).agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).filter("n > 1")


def twin_titles(rows: DataFrame) -> DataFrame:
    """Records that share lower-cased title and start with another one; both are named by the group's smallest id."""
    groups = rows.groupBy(F.lower("title").alias("_t"), F.col("start_day").alias("_s")).agg(F.min("id").alias("twin_of"), F.count("*").alias("_n")).filter("_n > 1")
    on = (F.lower(rows["title"]) == F.col("_t")) & (rows["start_day"] == F.col("_s"))
    return rows.join(groups, on).select("id", "twin_of")
