"""Packing against the tokenizers library, the rules of a packing, and exact numbers of sequences of small sets."""

import collections
import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catlake.llm import packing
from catlake.llm.words_bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "it's 'sting we'll  go\n\n\tNow'", "x's't <|endoftext|> <|endoftext|>", "日本語 ²٣ 🙂 é", "　 　a \x85\x1c b", "hello world " * 900, "q" * 3000, "word " * 1023, "word" + " word" * 1022]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@functools.cache
def atoms():
    return ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "a", "Z", "1", "٣", "é", "日", "🙂", "!", "'s", "　", "\x85", "\x1c", "<|endoftext|>", "<|", "²", "_", "​", "́"]


def test_ids_are_the_library_s(library):
    rng, encoder = random.Random(8), Encoder(PATH)
    encoder.MOST = 300  # so that it forgets
    for _ in range(6):
        texts = ["".join(rng.choice(atoms()) for _ in range(rng.randrange(14))) for _ in range(800)]
        ids, ends = encoder.encode(pa.array(texts))
        for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[ends[i] : ends[i + 1]].tolist() == e.ids, texts[i]
    text = " ".join(texts) * 20
    assert encoder.encode_long(text.encode(), 999).tolist() == library.encode(text, add_special_tokens=False).ids
    encoder = Encoder(PATH, added=False)
    library.encode_special_tokens = True
    ids, ends = encoder.encode(pa.array(texts))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == e.ids
    library.encode_special_tokens = False


def test_every_character_is_split_as_the_library_does(library):
    """Each code point between letters, digits and spaces begins matches where the library says."""
    encoder = Encoder(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 50_000):
        text = "".join(f"a{c}1{c} {c}" for c in every[k : k + 50_000])
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def needed(lengths, size):
    """The least number of sequences, by search."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, room):
        if i == len(lengths):
            return True
        for k in range(len(room)):
            if room[k] >= lengths[i] and room[k] not in room[:k]:
                room[k] -= lengths[i]
                if fits(i + 1, room):
                    return True
                room[k] += lengths[i]
        return False

    return next(n for n in range(len(lengths) + 1) if fits(0, [size] * n))


def test_bounds_hold_and_certify():
    rng, exact = random.Random(2), 0
    for _ in range(150):
        size = rng.choice([7, 12, 30])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(1, 11))])
        which, offset, left = packing.best_fit_decreasing(lengths, size)
        low, least = packing.bound(np.bincount(lengths, minlength=size + 1)), needed(lengths.tolist(), size)
        assert low <= least <= len(left)
        exact += low == least
        for k in range(len(left)):
            at = sorted(zip(offset[which == k].tolist(), lengths[which == k].tolist(), strict=True))
            assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist()
            assert sum(n for _, n in at) == size - left[k] <= size
    assert exact > 140
    weights, full = packing.dual_feasible(12)
    for w, f in zip(weights, full, strict=True):  # no full sequence weighs more than one
        most = np.zeros(13, np.int64)
        for room in range(1, 13):
            most[room] = max(w[n] + most[room - n] for n in range(1, room + 1))
        assert most[12] <= f


def test_pack(spark, library):
    docs = [(i % 9 if i % 4 else None, t, 0) for i, t in enumerate(TEXTS * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, TEXT int").repartition(4)
    found = packing.pack(frame, PATH, partition=8).collect()
    expected = collections.Counter()
    for doc_id, text, _ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == expected
    at = collections.defaultdict(list)
    for r in found:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in at.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    assert packing.pack(frame.filter("false"), PATH).collect() == []


def test_exchange_saves_sequences(spark):
    """Partitions of few documents leave gaps, which meeting documents of others closes; each turn's outcome counts only if it saves."""
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 1023), rng.randint(200, 500)]), 0) for i in range(3000)]
    every = packing.materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "test")
    turns = [packing.pack_pieces(every, partition=100, rounds=k) for k in (0, 1, 6)]
    used = [packing.certificate(x) for x in turns]
    low = used[0][1]
    assert used[0][0] > used[1][0] >= used[2][0] >= low
    for x in turns:
        assert x.select("doc_id").distinct().count() == x.count() == 3000
        assert x.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0


def test_certificate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used, low = packing.certificate(packing.pack(docs, PATH))
    assert low <= used <= low + 3
