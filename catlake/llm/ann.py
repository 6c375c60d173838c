"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Index: the distinct rows are dealt to shards by the hash of id and vector; each shard's
graph is built in one task, whose input is bounded by ``shard_rows`` on average. Vectors
join the graph in batches: a greedy beam search over the graph so far proposes neighbours,
relaxed pruning keeps a candidate unless a nearer one that is kept lies ``alpha`` times
nearer to it, and each kept edge is also offered to its end, which prunes again when full.

Search: a task reads a shard's graph once and then lets the queries pass, batch by batch;
the shards' best are merged. As rows are dealt at random, a shard holds few of a query's k
nearest where there are many shards, so a narrow beam may do:
the least one that, measured against brute force on a sample of shards and queries, finds them. Queries travel to every shard, graphs only once for each
``slice_rows`` queries, which are there so that one task's work is bounded. Largest inner
product becomes smallest Euclidean distance by one added coordinate, sqrt(longest norm
squared - own norm squared), so vectors of any length do; for the distances vectors are
scaled, so none overflows. Scores are made in double precision of the original vectors.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part, neither as query nor as candidate; vectors of different lengths are never compared;
equal vectors are one node that carries all their ids, and ties go to the smaller id; rows
that repeat both id and vector count once, and a query's own id is never its candidate; of
a query id with several vectors the least vector asks, and of a candidate id with several
the best counts; fewer candidates than k give all of them; an inner product beyond what a
double holds is infinite; empty tables give empty results; extra columns are ignored, also
with clashing names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pick

_FOUND = "query_id long, vec_id long, score double"


def _kind(vectors: DataFrame) -> str:
    """The elements' type: float where the table has floats, which are exact as doubles, else double."""
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    return "float" if isinstance(element, T.FloatType) else "double"


def _node_schema(kind: str) -> str:
    return f"dim int, shard int, node int, ids array<long>, vector array<{kind}>, links array<int>"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    rows = pick(vectors, "vec_id", "embedding")
    e = F.col("embedding")
    rows = rows.withColumn("embedding", e.cast(f"array<{_kind(rows)}>"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def _beam(points, links, entry, queries, beam):
    """Nearest nodes of each query by beam search, all queries side by side: (ids, distances), nearest first; -1 fills up."""
    n, m = len(queries), len(points)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, m), bool)
    norms = np.einsum("ij,ij->i", points, points)
    start = entry[None, :].repeat(n, 0)
    first = norms[entry][None, :] - 2 * (queries @ points[entry].T)
    k = min(beam, len(entry))
    order = np.argsort(first, 1, kind="stable")[:, :k]
    ids[:, :k], dist[:, :k], open_[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(first, order, 1), True
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        o = open_[live]
        # the two nearest nodes that are not yet expanded
        pos = np.argsort(~o, 1, kind="stable")[:, :2]
        ok = np.take_along_axis(o, pos, 1)
        live, pos, ok = live[ok[:, 0]], pos[ok[:, 0]], ok[ok[:, 0]]
        if not len(live):
            break
        rows = live[:, None]
        open_[rows, pos] = False
        node = np.where(ok, ids[rows, pos], -1)
        near = np.where((node >= 0)[:, :, None], links[node], -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[rows, near]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        d[r, c] = norms[near[r, c]] - 2 * np.einsum("ij,ij->i", queries[live[r]], points[near[r, c]])
        # a node offered twice in one step counts once
        order = np.argsort(near, 1, kind="stable")
        same = np.zeros(near.shape, bool)
        s = np.take_along_axis(near, order, 1)
        np.put_along_axis(same, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        d[same] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_o = np.concatenate([open_[live], np.isfinite(d)], 1)
        best = np.argpartition(all_d, beam - 1, 1)[:, :beam] if all_d.shape[1] > beam else np.arange(all_d.shape[1])[None, :].repeat(len(live), 0)
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), 1, kind="stable"), 1)
        dist[live], ids[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_o))
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def _prune(points, p, candidates, degree, alpha):
    """At most ``degree`` of the candidates, nearest first, without those that a kept one covers."""
    c = np.unique(candidates)
    c = c[(c >= 0) & (c != p)]
    own = points[c]
    norm = np.einsum("ij,ij->i", own, own)
    d = norm + points[p] @ points[p] - 2 * (own @ points[p])
    order = np.argsort(d, kind="stable")
    c, d, own, norm = c[order], d[order], own[order], norm[order]
    kept, alive = [], np.ones(len(c), bool)
    between = alpha * alpha * (norm[:, None] + norm[None, :] - 2 * (own @ own.T)) if len(c) <= 512 else None
    for i in range(len(c)):
        if not alive[i]:
            continue
        kept.append(c[i])
        if len(kept) == degree:
            break
        alive &= (between[i] if between is not None else alpha * alpha * (norm + norm[i] - 2 * (own @ own[i]))) > d
    return np.asarray(kept, np.int32)


def _points(vectors: np.ndarray) -> np.ndarray:
    """The vectors in one scale, with the coordinate that makes them all equally long."""
    v = np.asarray(vectors, np.float64) / np.abs(vectors).max()
    norm = np.einsum("ij,ij->i", v, v)
    return np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1)


def build_graph(vectors, degree: int = 64, beam: int = 96, alpha: float = 1.05, batch: int = 512):
    """(points with the added coordinate, links): the graph over distinct vectors of one shard."""
    points = _points(vectors)
    n = len(points)
    room = degree + degree // 2  # a node's list may grow this long before it is pruned again
    links = np.full((n, room), -1, np.int32)
    entry = entries(n)
    for k, p in enumerate(entry):  # the entries know each other from the start
        others = np.delete(entry, k)[:degree]
        links[p, : len(others)] = others
    order = np.random.default_rng(7).permutation(n)
    done, size = len(entry), 64
    order = order[~np.isin(order, entry)]
    while len(order):
        size = min(batch, max(64, done))  # a batch is no larger than the graph it is searched in
        now, order = order[:size], order[size:]
        found, _ = _beam(points, links, entry, points[now], beam)
        back: dict[int, list[int]] = {}
        for p, f in zip(now.tolist(), found, strict=True):
            kept = _prune(points, p, f, degree, alpha)
            links[p, : len(kept)] = kept  # nothing else has linked from p yet
            for q in kept.tolist():
                back.setdefault(q, []).append(p)
        for q, new in back.items():
            both = np.unique(np.concatenate([links[q][links[q] >= 0], np.asarray(new, np.int32)]))
            if len(both) > room:
                both = _prune(points, q, both, degree, alpha)
            links[q] = -1
            links[q, : len(both)] = both
        done += len(now)
    return points, links


def entries(n: int, most: int = 32) -> np.ndarray:
    """Where searches in a graph of n nodes start: a few spread positions."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int32))


def build_index(vectors: DataFrame, shard_rows: int = 8192, min_shards: int = 8, degree: int = 64, beam: int = 96, alpha: float = 1.05) -> DataFrame:
    """The graphs as a table, one row a node: dim, shard, node, ids, vector, links. Every valid row is in it."""
    rows = valid_vectors(vectors).dropDuplicates()
    shards = max(min_shards, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def graph(key, group):
        v, owner = np.unique(np.stack(group["embedding"].to_numpy()), axis=0, return_inverse=True)
        ids = [np.unique(x) for x in np.split(group["vec_id"].to_numpy()[np.argsort(owner.ravel(), kind="stable")], np.cumsum(np.bincount(owner.ravel()))[:-1])]
        _, links = build_graph(v, degree, beam, alpha)
        return pd.DataFrame({
            "dim": key[0], "shard": key[1], "node": np.arange(len(v), dtype=np.int32), "ids": ids,
            "vector": list(v), "links": [x[x >= 0] for x in links],
        })

    # One partition a shard: shards are small in bytes and long in work, so they must not be coalesced, and hashing would let some share a task.
    return dealt.repartitionById(shards, "shard").groupBy("dim", "shard").applyInPandas(graph, _node_schema(_kind(rows)))


#: Beams that may do, and the share of a shard's nearest that the one taken has to find.
BEAMS, RECALL = (32, 48, 64, 96, 128, 192, 256), 0.97


def share_of(k: int, shards: int) -> int:
    """As many of the k nearest as one of so many shards may hold: the mean and three deviations, as rows are dealt at random."""
    return min(k + 1, math.ceil(k / shards + 3 * math.sqrt(k / shards)))


class _Shard:
    """The graph of one shard in memory: its nodes come first, and then it answers queries."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.points = None

    def ready(self) -> None:
        nodes = pa.Table.from_batches(self.parts).combine_chunks().sort_by("node")
        self.parts = []
        rows = lambda name: nodes[name].combine_chunks()
        self.vectors = rows("vector").flatten().to_numpy().reshape(len(nodes), -1).astype(np.float64)
        self.ids, self.at = rows("ids").flatten().to_numpy(), np.append(0, np.cumsum(rows("ids").value_lengths().to_numpy()))
        many, flat = rows("links").value_lengths().to_numpy(), rows("links").flatten().to_numpy()
        self.links = np.full((len(nodes), max(1, int(many.max()))), -1, np.int32)
        self.links[np.repeat(np.arange(len(nodes)), many), np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
        self.points = _points(self.vectors)

    def near(self, asked: np.ndarray, beam: int) -> np.ndarray:
        wide = np.concatenate([asked / np.abs(asked).max(1, keepdims=True), np.zeros((len(asked), 1))], 1)
        return _beam(self.points, self.links, entries(len(self.points)), wide, beam)[0]

    def enough(self, asked: np.ndarray, most: int) -> int:
        """The least beam that finds RECALL of the ``most`` nearest nodes, which brute force knows, or the widest."""
        with np.errstate(over="ignore", invalid="ignore"):
            true = np.argsort(-(asked @ self.vectors.T), 1, kind="stable")[:, :most]
        for beam in BEAMS:
            found = self.near(asked, beam)
            if np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) >= RECALL:
                break
        return beam

    def answer(self, own: np.ndarray, asked: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        out: list[tuple] = []
        for i in range(0, len(asked), 64):
            for j, nodes in enumerate(self.near(asked[i : i + 64], beam), i):
                nodes = nodes[nodes >= 0]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,j->i", self.vectors[nodes], asked[j])
                # Of equal vectors only the k + 1 smallest ids can be among the k nearest others.
                taken = [(s, x) for n, s in zip(nodes.tolist(), score.tolist(), strict=True) for x in self.ids[self.at[n] : min(self.at[n + 1], self.at[n] + k + 1)].tolist() if x != own[j]]
                taken.sort(key=lambda x: (-x[0], x[1]))
                out += [(own[j], x, s) for s, x in taken[:k]]
        query, vec, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Shard, pa.RecordBatch]]:
    """Each shard with the queries that come after its nodes, batch by batch."""
    now, shard = None, None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)] + [batch.column(3).is_null().to_numpy(zero_copy_only=False).astype(np.int32)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            part, (*group, is_query) = batch.slice(a, b - a), keys[a].tolist()
            if group != now:
                now, shard = group, _Shard()
            if not is_query:
                shard.parts.append(part)
                continue
            if shard.points is None:
                shard.ready()
            yield shard, part


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    return part.column(5).flatten().to_numpy().reshape(len(part), -1).astype(np.float64)


def _met(index: DataFrame, asked: DataFrame, shards: int, slices: int = 1) -> DataFrame:
    """Nodes and queries (vec_id, embedding) by shard and slice, a graph's nodes before its queries."""
    kind = index.schema["vector"].dataType.simpleString()
    there = index.groupBy(F.col("dim").alias("of"), "shard").agg(F.lit(1).alias("one"))
    asked = asked.join(there, F.size("embedding") == F.col("of")).select(
        F.col("of").alias("dim"), "shard", F.pmod(F.xxhash64("vec_id", F.lit("slice")), F.lit(slices)).cast("int").alias("slice"), F.lit(None).cast("int").alias("node"),
        F.array("vec_id").alias("ids"), F.col("embedding").cast(kind).alias("vector"), F.lit(None).cast("array<int>").alias("links"),
    )
    nodes = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # Groups that meet in one partition come one after another.
    key = ["dim", "shard", "slice"]
    mixed = nodes.select(*asked.columns).unionByName(asked)
    return mixed.repartitionById(shards * slices, F.col("shard") * slices + F.col("slice")).sortWithinPartitions(*key, F.col("node").isNull())


def beam_width(index: DataFrame, asked: DataFrame, k: int, shards: int, sample: int = 64) -> int:
    """The widest of the beams that are enough for a sample of the queries in the first three shards; the sample is one row a query, of every length of vectors."""
    if k > BEAMS[-1] // 2:
        return 2 * k
    most = share_of(k, shards)
    few = asked.orderBy(F.xxhash64("vec_id", F.lit("beam")), "vec_id").limit(sample)

    def gauge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in _meetings(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shard.enough(_vectors(part), most)], pa.int32())], ["beam"])

    return _met(index.filter("shard < 3"), few, 3).mapInArrow(gauge, "beam int").agg(F.max("beam")).first()[0] or BEAMS[0]


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int | None = None, slice_rows: int = 1 << 17) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query vector (vec_id, embedding), by ``beam_width`` unless a beam is given."""
    asked = valid_vectors(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    slices = max(1, math.ceil(asked.count() / slice_rows))
    shards = 1 + (index.agg(F.max("shard")).first()[0] or 0)
    width = beam or beam_width(index, asked, k, shards)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in _meetings(batches):
            yield shard.answer(part.column(4).flatten().to_numpy(), _vectors(part), k, width)

    found = _met(index, asked, shards, slices).mapInArrow(find, _FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int | None = None) -> DataFrame:
    """Build the index over ``vectors``, write it to the shared folder, and search it for ``queries``."""
    return search(materialize(build_index(vectors), "graphs"), queries, k, beam)
