"""Filter audit against a plain version, and the span table against a dictionary."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from catlake.llm import audit, spans

GAP = re.compile(r"[\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "a", "A A A", "Ärger über Öl 🙂 über", "word " * 60, "one two " * 40, "X" * 40_000, "ABC def $", "a\x0bb\x0cc\rd", "\x1ca\x85b c", "é " + "w" * 513 + " " + "w" * 513 + " " + "w" * 512 + "v"]


def plain_facts(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def test_measure():
    found = [c.to_pylist() for c in audit.measure(pa.array(TEXTS, pa.string()))]
    for i, text in enumerate(TEXTS):
        assert tuple(c[i] for c in found[:5]) == plain_facts(text)
        assert found[5][i] == hashlib.sha256((text or "").encode()).digest()
    part = [c.to_pylist() for c in audit.measure(pa.array(TEXTS, pa.string()).slice(4, 5))]
    assert part == [c[4:9] for c in found]


def test_equal_spans_have_one_number():
    rng, table, known = random.Random(5), spans.SpanTable(4), {}
    for _ in range(4):
        words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 8, 9, 17, 600]))) for _ in range(900)]
        groups = [rng.randrange(2) for _ in words]
        size = np.array([len(w) for w in words])
        found = table.number(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, groups).tolist()
        for w, g, x in zip(words, groups, found, strict=True):
            assert known.setdefault((w, g), x) == x and table.bytes_of(x) == w
        assert len(set(known.values())) == len(known) == table.count


def test_equal_hashes_stay_apart():
    """With all hashes equal, only the comparison of bytes keeps words apart."""

    class OneHash(spans.SpanTable):
        def _hashes(self, start, length, group):
            return super()._hashes(start, length, group)[0], np.zeros(len(start), np.uint64)

    words = [w.encode() for w in ("same head one", "same head two", "same head one", "short", "a", "shorter", "same head two!")]
    size = np.array([len(w) for w in words])
    found = OneHash().number(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    assert found[0] == found[2] and len(set(found.tolist())) == len(set(words))


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, part, text in docs:
        n, different, capitals, points, symbols = plain_facts(text)
        copy = any((t or "") == (text or "") and i is not None and doc_id is not None and i < doc_id for i, _, t in docs)
        fails = dict(A=n < 50, B=100 * different < 65 * n, C=100 * capitals > 5 * points, D=symbols > 0, E=copy)
        rows.append((part or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[1][letter]]
                left = [r for r in left if not r[1][letter]]
                all_fail = [r for r in rows if r[0] == part and r[1][letter]]
                shapley[part, letter] += len(gone)
                only = sum(sum(r[1].values()) == 1 for r in all_fail)
                out[part, order, step] = [len(left), len(gone), len(all_fail) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_a_plain_version(spark):
    docs = [(i, ("s", "t", None)[i % 3], t) for i, t in enumerate(TEXTS * 2)]
    docs += [(None, "s", "a"), (3, "s", "a"), (3, "s", "a"), (99, "", "a B $ " * 60)]
    labels = [(3, 1, 0), (3, None, 1), (None, 1, 1), (20, 1, 1), (99, 0, None), (500, 1, 1)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, TEXT int").repartition(3)
    found = audit.audit(audit.failures(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == plain_audit(docs, labels)
    assert len(found) == 600 * 3
    empty = audit.failures(frame.filter("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.audit(empty).collect() == []
