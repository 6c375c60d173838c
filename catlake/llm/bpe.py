"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A file of ranks (base64 token, rank) becomes a BPE model: its bytes are written as
printable characters by a fixed rule, and the merges are derived from the ranks, as each
token's last merge is what the lower ranks leave of it. Texts are split by ``pattern``
and each match is encoded by itself, without special tokens.

Decoding reverses the byte table: each token of the tokenizer's vocabulary, a string of
printable characters, becomes the bytes that these characters stand for, so a character
that is split over several tokens comes back whole once their bytes are joined. The ends
of tokens in the text's UTF-8 bytes are the running sums of their lengths.

``round_trip`` encodes, decodes and digests in one Python worker, so bytes that were only
made to be compared never travel; ``encode`` and ``decode`` are its halves.

Edge cases: a null text counts as empty and has no ids; null ids decode to no bytes; an
unknown id is an error; texts of any length are encoded whole; batches are cut into
pieces of bounded size; repeated rows, null and repeated ids and empty tables are no
matter; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick

#: Bytes handed to the tokenizer, or ids decoded, at once.
PIECE = 1 << 20


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of two or more bytes, in the order of ranks."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            options = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            low, i = min(options)
            if low >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def tokenizer_of(path: str, pattern: str | None = None):
    """The BPE model as a tokenizer of texts that it splits by ``pattern``, or of single matches."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_characters()
    text = lambda token: token.decode("latin-1").translate(char)
    out = Tokenizer(models.BPE({text(t): r for t, r in ranks.items()}, [(text(a), text(b)) for a, b in merges_of(ranks)]))
    plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out.pre_tokenizer = plain if pattern is None else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), plain])
    return out


@functools.lru_cache(maxsize=4)
def whole_tokenizer(path: str, pattern: str):
    """The tokenizer of whole texts, which knows offsets; once a worker."""
    return tokenizer_of(path, pattern)


@functools.lru_cache(maxsize=4)
def single_tokenizer(path: str):
    """The tokenizer of single matches; once a worker."""
    return tokenizer_of(path)


@functools.lru_cache(maxsize=4)
def matches_of(path: str, pattern: str) -> Matches:
    """The encoder of matches; once a worker."""
    return Matches(single_tokenizer(path), pattern)


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The bytes of each id at its place (null: no such id): the vocabulary's characters by the reversed byte table; once a worker."""
    byte = {ord(c): b for b, c in byte_characters().items()}
    vocabulary = single_tokenizer(path).get_vocab(with_added_tokens=False)
    out: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for token, rank in vocabulary.items():
        out[rank] = token.translate(byte).encode("latin-1")
    return pa.array(out, pa.binary())


class Matches:
    """Ids of texts by their matches of the pattern; each different match is encoded once, as long as it is remembered."""

    LONGEST, MOST, AT_ONCE = 64, 250_000, 2000

    def __init__(self, tokenizer, pattern: str) -> None:
        self.tokenizer, self.find, self.known = tokenizer, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.find(x) for x in texts]
        if len(self.known) > self.MOST:
            self.known = {}
        known = self.known
        new = list({m for f in found for m in f} - known.keys())
        for k in range(0, len(new), self.AT_ONCE):
            part = new[k : k + self.AT_ONCE]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(coded.ids, "<i4").tobytes()
            at = (4 * np.searchsorted(np.asarray(coded.word_ids), np.arange(len(part) + 1))).tolist()
            for i, m in enumerate(part):
                known[m] = ids[at[i] : at[i + 1]]
        out = [np.frombuffer(b"".join(map(known.__getitem__, f)), "<i4") for f in found]
        for m in new:
            if len(m) > self.LONGEST:
                del known[m]
        return out


def pieces(batch: pa.Array, length: pa.Array) -> Iterator[pa.Array]:
    """The rows of a batch in order, in slices of about PIECE units of ``length`` (null: 0)."""
    part = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(batch)).tolist()
    for a, b in zip([0, *ends], ends):
        if b > a:
            yield batch.slice(a, b - a)


def _pieces_of_texts(batch: pa.Array) -> Iterator[list[str]]:
    for part in pieces(batch, pc.binary_length(batch)):
        yield [x or "" for x in part.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of every row's whole text. Each piece of a batch goes out by itself, so that workers stay small."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matches = matches_of(path, pattern)
        for batch in batches:
            for texts in _pieces_of_texts(batch):
                out = matches.encode(texts)
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out), pa.int32()))

    return pick(docs, "doc_id", "text").select("doc_id", ids("text").alias("ids"))


def encode_with_offsets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, starts, ends, byte_ends): also the span of characters, and the end in UTF-8 bytes, of each token.

    Where a character is split over tokens, each of them has that whole character as its span.
    """

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>, byte_ends array<int>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = whole_tokenizer(path, pattern)
        size_of = pc.binary_length(token_bytes(path)).fill_null(0).to_numpy(zero_copy_only=False)
        for batch in batches:
            out = []
            for part in _pieces_of_texts(pa.array(batch, pa.string())):
                for e in tokenizer.encode_batch(part, add_special_tokens=False):
                    at = np.asarray(e.offsets, np.int32).reshape(-1, 2)
                    sizes = size_of[np.asarray(e.ids, np.int64)]
                    out.append((np.asarray(e.ids, np.int32), at[:, 0], at[:, 1], np.cumsum(sizes, dtype=np.int32)))
            yield pd.DataFrame(out, columns=["ids", "starts", "ends", "byte_ends"], dtype=object)

    return pick(docs, "doc_id", "text").select("doc_id", spans("text").alias("s")).select("doc_id", "s.*")


def decoded(path: str, ids: pa.Array, rows: pa.Array) -> pa.Array:
    """The bytes of rows of ids: ``ids`` one after another, and how many belong to each row."""
    tokens = token_bytes(path).take(ids)
    if tokens.null_count:
        raise ValueError("an id is not in the file of ranks")
    # Taken one after another, the tokens' bytes are already joined; rows only need other ends.
    at = np.append(0, np.cumsum(pc.binary_length(tokens).to_numpy(), dtype=np.int64))
    ends = at[np.append(0, np.cumsum(rows.fill_null(0).to_numpy()))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), tokens.buffers()[2]])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes of the ids of every row."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in pieces(batch, pc.list_value_length(batch)):
                yield decoded(path, part.flatten(), pc.list_value_length(part))

    return pick(encoded, "doc_id", "ids").select("doc_id", "ids", joined("ids").alias("bytes"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_bytes, decoded_sha256) of every row: its ids, the end of the last one in bytes, and the digest of what they decode to."""
    rows = pick(docs, "doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("ids array<int>, n_bytes long, decoded_sha256 string").fields])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = matches_of(path, pattern)
        for batch in batches:
            at = 0
            for texts in _pieces_of_texts(batch.column(1)):
                found = matches.encode(texts)
                length = pa.array(list(map(len, found)), pa.int64())
                ids = pa.array(np.concatenate(found), pa.int32())
                back = decoded(path, ids, length)
                ends = pa.array(np.append(0, np.cumsum(length.to_numpy())).astype(np.int32))
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in back]
                columns = [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(ends, ids), pc.binary_length(back).cast(pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                at += len(texts)

    return rows.mapInArrow(both, schema)


def decode_text(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, text): decoded as UTF-8; bytes that are no whole character become U+FFFD."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return decode(encoded, path, pattern).select("doc_id", "ids", text.alias("text"))
