"""Best-fit packing of token sequences, with bounds that certify it.

Documents are encoded whole and closed by an end id; those longer than a sequence are cut
into full pieces, the first of which may be shorter. Full pieces are sequences of their own.
The others are dealt evenly into partitions of bounded size, and each partition is packed by
best-fit decreasing. Dual feasible functions of the lengths give lower bounds of the number
of sequences that any packing of the partition needs: where the best bound equals the number
used, the partition is certified and done. Partitions with a gap give the documents of their
sequences that aren't full to new partitions, in which documents of several ones meet, and
best-fit decreasing runs anew; the outcome counts if it takes fewer sequences, and rounds end
when it doesn't, or when no gap is left. ``certificate`` gives the bound over all documents.

Edge cases: a null text is empty, and an empty one is its end id alone; repeated rows and
ids, null ids among them, are documents of their own, dealt by their place in a written table
and not by their id; an empty table gives an empty result; extra columns, also with clashing
names, are ignored; very long texts are encoded in parts that give the ids of the whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pieces
from .common import discard, materialize, pick
from .words_bpe import Encoder

#: Pieces that one partition packs, about.
PARTITION = 16_384
#: Bytes of a text from which it is encoded by itself, in parts.
LONG_TEXT = 1 << 22
ROUNDS = 6


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder; once a worker."""
    return Encoder(path)


def cut(ids: np.ndarray, ends: np.ndarray, size: int, end_id: int) -> dict[str, np.ndarray]:
    """The pieces of rows of ids: row, piece, start, length and CRC-32 of the little-endian ids."""
    closed = np.insert(ids, ends[1:], end_id).astype("<u4")
    total = np.diff(ends) + 1
    base = np.cumsum(total) - total
    n = -(-total // size)
    row = np.repeat(np.arange(len(total)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (total - size * (n - 1))[row]
    start = np.where(piece == 0, 0, first + size * (piece - 1))
    length = np.where(piece == 0, first, size)
    view, at = memoryview(closed.view(np.uint8)), 4 * (base[row] + start)
    crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
    return {"row": row, "piece": piece, "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)}


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row's whole text."""
    rows = pick(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1), pc.binary_length(batch.column(1))):
                long = [i for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()) if n >= LONG_TEXT]
                a = 0
                for i in [*long, len(texts)]:
                    for part, whole in ((texts.slice(a, i - a), False), (texts.slice(i, 1), True)):
                        if not len(part):
                            continue
                        if whole:
                            ids = encoder.encode_long(part[0].as_buffer().to_pybytes())
                            ends = np.array([0, len(ids)])
                        else:
                            ids, ends = encoder.encode(part)
                        out = cut(ids, ends, size, end_id)
                        doc_ids = batch.column(0).slice(at, len(part)).take(pa.array(out.pop("row")))
                        yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(v.astype(k)) for v, k in zip(out.values(), ("i4", "i8", "i8", "i8"), strict=True))], schema.names)
                        at += len(part)
                    a = i + 1

    return rows.mapInArrow(encoded, schema)


@functools.lru_cache(maxsize=4)
def dual_feasible(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the lengths 0 to ``size`` by each dual feasible function, as integers, and what a full sequence weighs at most.

    Three families: lengths as they are, with those below a threshold as nothing and those
    that leave less than it as whole sequences; lengths counted in steps of a threshold,
    from above in the upper half; and lengths rounded to multiples of 1 / (k + 1).
    """
    x = np.arange(size + 1)
    weights, full = [x], [size]
    for e in range(1, size // 2 + 1):
        weights.append(np.where(x > size - e, size, np.where(x < e, 0, x)))
        full.append(size)
        k = size // e
        weights.append(np.where(2 * x > size, 2 * (k - (size - x) // e), np.where(2 * x == size, k, 2 * (x // e))))
        full.append(2 * k)
    for k in range(1, min(size, 100)):
        weights.append(np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size))
        full.append(k * size)
    return np.array(weights, np.int64), np.array(full, np.int64)


def bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs, given how many pieces there are of each length from 0 to the size."""
    weights, full = dual_feasible(len(counts) - 1)
    used = counts > 0
    return int((-(-(weights[:, used] @ counts[used].astype(np.int64)) // full)).max(initial=0))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of each piece and its offset there, and what each sequence leaves.

    Sequences wait in stacks by what they leave; the bits of one number say which stacks hold any.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    open_, left, which, offset = 0, [], [], []
    for n in lengths[order].tolist():
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = stacks[room].pop()
            if not stacks[room]:
                open_ ^= 1 << room
        else:
            room, k = size, len(left)
            left.append(size)
        which.append(k)
        offset.append(size - room)
        left[k] = room = room - n
        if room:
            stacks[room].append(k)
            open_ |= 1 << room
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return np.array(which, np.int64)[back], np.array(offset, np.int64)[back], np.array(left, np.int64)


def _packed(rows: DataFrame, number: int, size: int, turn: int) -> DataFrame:
    """``rows`` (a written table) dealt into ``number`` partitions and packed in each: sequence_id, offset, left in the sequence, and the partition's gap.

    Partitions are numbered within the turn, so ids of sequences never meet.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = rows.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(number)).alias("part"))
    more = T.StructType.fromDDL("sequence_id long, offset long, left long, gap long").fields
    schema = T.StructType([*dealt.select(*names).schema.fields, *more])

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable")
        lengths = frame["length"].to_numpy()
        which, offset, left = best_fit_decreasing(lengths, size)
        gap = len(left) - bound(np.bincount(lengths, minlength=size + 1))
        base = (turn << 56) | (int(key[0]) << 24)
        return frame[names].assign(sequence_id=base + which, offset=offset, left=left[which], gap=gap)

    return dealt.groupBy("part").applyInPandas(pack, schema)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, partition: int = PARTITION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack_pieces(materialize(pieces_of(docs, path, size, end_id), "pieces"), size, partition)


def pack_pieces(every: DataFrame, size: int = 1024, partition: int = PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """The pieces of a written table with the sequence and the offset that each is packed at."""
    names = every.columns
    own = every.filter(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = [*names, "sequence_id", "offset"]
    waiting, done, held = every.filter(F.col("length") < size), [own], None
    for turn in range(1, rounds + 2):
        count = waiting.count()
        if not count:
            break
        new = materialize(_packed(waiting, max(1, round(count / partition)), size, turn), "packed")
        if held is not None:
            before, after = (x.filter("offset = 0").count() for x in (waiting, new))
            if after >= before:
                discard(new)
                break
        gives = F.col("gap").cast("boolean") & (F.col("left") > 0)
        done.append(new.filter(~gives).select(*names))
        waiting = held = new.filter(gives)
    if held is not None:
        done.append(waiting.select(*names))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def certificate(packed: DataFrame, size: int = 1024) -> tuple[int, int]:
    """Sequences of a packing, and how many any packing of these pieces needs."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():  # at most ``size`` rows
        counts[length] = n
    return packed.filter("offset = 0").count(), bound(counts)
