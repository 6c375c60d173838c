"""The training-data operators against brute force, round trips and held-out labels, and on edge cases."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from catlake.llm import ann, bpe, chat, langid, mixing, ngram_ratio, quality, queries, simhash, toxicity, warc
from catlake.llm.common import materialize
from catlake.llm.components import connected_components

DIR = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, " \t\n", "en", "", 3), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (5, "one", "en", "s", 3),
    (None, "a null id has this text", "de", "s", 1), (None, None, None, None, None), (6, "é́\U0001f600 “x”   z\x00y", "fr", "t", 9), (7, "word " * 60_000, "en", "s", 1), (8, "x" * 300_000, None, "t", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with those that operators make."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit("extra") for c in ("size", "fp", "TEXT2", "score", "language", "row", "weights", "bucket", "copies", "hi")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {key: fingerprint}; the smallest key reachable for each."""
    root = {k: k for k in fps}
    for a in fps:
        for b in fps:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = root[a], root[b]
                if x != y:
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_simhash_components(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    for text in ["", "a", "A b", "The quick brown Fox jumps", "x y z " * 40, None, "É é\x0bq"]:
        assert simhash.simhash(text) & (2**64 - 1) == brute_simhash(text)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {1}


@pytest.mark.parametrize("bucket", [2, 64])
def test_near_pairs_lose_no_link(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = list({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) for c in centres for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = connected_components(simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)).collect()
    got = {r["node"]: r["root"] for r in found}
    want = brute_components(dict(zip(signed, fps, strict=True)))
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (1000, 1001)], "a long, b long")
    assert {(r["node"], r["root"]) for r in connected_components(edges).collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_mix(spark, odd, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in rows)
    rows = queries.QUERIES["op1_mix_entropy_balancing"](spark, DIR).toPandas()
    source = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source").toPandas()
    by = rows.merge(source, on="doc_id").groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (by["size"] == by["own"]).all()
    weight, level = np.array([(5, 2, 1)[i % 3] for i in range(len(by))]), 1.5 * by["size"].sum()
    cap, target = 2 * by["size"].to_numpy(), np.zeros(len(by))
    full = np.zeros(len(by), bool)
    while True:  # reshare the excess until none is above
        target = np.where(full, cap, weight * (level - cap[full].sum()) / max(1, weight[~full].sum()))
        if not (over := ~full & (target > cap)).any():
            break
        full |= over
    assert np.allclose(by["target"], target)
    assert ((by["taken"] - by["target"]).abs() <= 30 + 0.01 * by["target"]).all()


def test_bpe(spark, odd):
    ranks = bpe.read_ranks(PATH)
    tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [(i, r[1]) for i, r in enumerate(ODD)] + [(100, "it's  'll\n\n  x <|endoftext|> naïve 日本語🙂"), (101, "".join(map(chr, range(1, 700))))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    spans = {r["doc_id"]: r for r in bpe.encode_with_offsets(docs, PATH, PATTERN).collect()}
    for r in rows:
        text = dict(texts)[r["doc_id"]] or ""
        if len(text) <= 1000:
            assert r["ids"] == tik.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode()
        s = spans[r["doc_id"]]
        assert s["ids"] == r["ids"] and (not text or s["byte_ends"][-1] == len(text.encode()))
    split = spark.createDataFrame([(1, tik.encode_ordinary("🙂")[:1])], "doc_id long, ids array<int>")
    assert "�" in bpe.decode_text(split, PATH, PATTERN).first()["text"]
    assert bpe.encode(odd.limit(0), PATH, PATTERN).count() == 0


def test_warc(spark, tmp_path):
    data = [(1, "http://b.example.org/x", "<p>é"), (0, "http://b.example.org/x", "<p>é"), (2, "http://a.example.org/", "<p>é"), (3, None, None), (4, "odd\turl", ""), (5, "http://a.example.org/", "z" * 200_000), (None, "http://c.org/q", "<p>é"), (5, "http://a.example.org/", "z" * 200_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha", F.lit("extra"))
    archive = warc.write_archive(pages, str(tmp_path / "w"), block=2)
    rows = warc.read_records(archive, warc.index_captures(archive)).collect()
    got = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    n = len("<p>é".encode())
    assert got == collections.Counter([(2, "response", None, n), (1, "revisit", 2, n), (0, "revisit", 2, n), (None, "revisit", 2, n), (4, "response", None, 0), (3, "revisit", 4, 0), (5, "response", None, 200_000), (5, "response", None, 200_000)])
    assert {bytes(r["payload"]) for r in rows if r["page_id"] == 2} == {"<p>é".encode()}
    found = warc.lookup(archive, spark.createDataFrame([("http://A.example.org/",), ("http://none.org/",)], "url string"))
    assert sorted(r["page"] for r in found.collect()) == ["2", "5", "5"]
    every = warc.lookup(archive, pages)  # tabs, nulls and keys that fill several blocks among them
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, warc.index_captures(archive).collect()))
    assert every.count() == len(data) and archive.files.agg(F.sum("blocks")).first()[0] >= 4
    # Of two attempts of one task, the captures name the files of one only.
    again = warc.write_archive(pages, str(tmp_path / "w"), block=2)
    assert not {r["file"] for r in again.captures.collect()} & {r["file"] for r in archive.captures.collect()}
    assert warc.read_records(archive, warc.lookup(archive, pages)).count() == len(data)
    none = warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_records(none, warc.index_captures(none)).count() == 0


def brute_rules(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {k for k, n in collections.Counter(windows).items() if n > 1}
    covered = {j for i, k in enumerate(windows) if k in many for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_scores(docs, trusted, buckets=1 << 16):
    def grams(text):
        t = re.findall(ngram_ratio.TOKEN.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), text or "")
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in t]
        return [x % buckets for x in h] + [xxhash.xxh64_intdigest(b.encode(), seed=a) % buckets for a, b in zip(h, t[1:], strict=False)]

    raw, target = np.ones(buckets), np.ones(buckets)
    each = [(d, grams(x)) for d, x in docs]
    for d, g in each:
        np.add.at(raw, g, 1)
        if d in trusted:
            np.add.at(target, g, 1)
    w = np.log(target / target.sum() / (raw / raw.sum()))
    return {d: w[g].mean() for d, g in each if g}


def test_rules_and_ratio(spark, odd, empty, labels):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    known = spark.read.parquet(f"{DIR}/labels.parquet").filter("quality = 1").select("doc_id")
    rows = ngram_ratio.ratio_scores(docs, known).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_scores(texts, {r["doc_id"] for r in known.collect()})
    for r in rows:
        base = brute_rules(dict(texts)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.2)
    rows = ngram_ratio.ratio_scores(odd, labels.select("doc_id")).collect()
    assert collections.Counter((r["n_words"], r["n_repeat_words"]) for r in rows) == collections.Counter((len(words(t[1])), brute_rules(t[1])[4]) for t in ODD)
    assert ngram_ratio.ratio_scores(empty, labels.select("doc_id")).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) or r["score"] is None for r in ngram_ratio.ratio_scores(odd, labels.limit(0).select("doc_id")).collect())


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "a\\b\\\\<\\|im_end|>", "", None, "<|im_<|im_end|>end|>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, "odd\nrole <|", "y"), (None, 1, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("extra"))
    formatted = chat.format_conversations(table)
    marks = {r["conv_id"]: (r["valid"], r["wrong_turn"]) for r in formatted.collect()}
    assert marks == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, 0)}
    back = {r["conv_id"]: r for r in chat.parse_conversations(formatted).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user" if i % 2 == 0 else "assistant", t or "") for i, t in enumerate(texts)]
    assert back[1]["loss_text"] == "".join((t or "") for t in texts[1::2]) and back[2]["loss_text"] == "xx"
    assert [(t["role"], t["text"]) for t in back[3]["turns"]] == [("odd\nrole <|", "y")]
    assert back[1]["formatted"].count("<|im_start|>") == len(texts)
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_machine_is_on_the_path_of_op9(spark):
    found = queries.op9_chat_template(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(state in plan for state in chat.CHAT.machine) and {"valid", "wrong_turn"} <= set(found.columns)
    probe = found.filter("conv_id = -1").first()
    assert (probe["valid"], probe["wrong_turn"]) == (True, None)


def test_chat_machine_against_a_plain_one(spark):
    rng, rows = np.random.default_rng(6), []
    for c in range(60):
        roles = rng.choice(["user", "assistant", "system", "tool"], rng.integers(1, 7), p=[0.45, 0.45, 0.08, 0.02]).tolist()
        roles = roles if c % 2 else (["system"] if c % 4 else []) + ["user", "assistant"] * len(roles) + roles[:1]
        rows += [(c, i, r, f"<|im_end|>{i}\\") for i, r in enumerate(roles)]
    for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        state, wrong = "begin", None
        for i, role in [x[1:3] for x in rows if x[0] == r["conv_id"]]:
            state = chat.CHAT.machine.get(state, {}).get(role, "")
            wrong = i if wrong is None and not state else wrong
        assert (r["valid"], r["wrong_turn"]) == (state in chat.CHAT.accepts, wrong)
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == [s["text"] for s in r["segments"] if s["loss"]]


def test_chat_of_very_many_turns(spark):
    """Work grows with the turns: sixteen times the turns of one conversation don't take the square of it."""
    n = 40_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é <|im_end|> "), F.col("id")).alias("text"))
    began = time.time()
    r = chat.parse_conversations(chat.format_conversations(rows)).first()
    assert time.time() - began < 30
    assert (len(r["turns"]), r["valid"]) == (n, True) and r["loss_text"] == "".join(f"é <|im_end|> {i}" for i in range(1, n, 2))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, (1200, 1))
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in np.float32(r)], 0) for i, r in enumerate(v)] + [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [1.0, None], 0), (40, [1.0, 2.0], 0), (7, [float(x) for x in np.float32(v[7])], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("extra"))
    found = ann.nearest(table, table.filter("vec_id % 20 = 0 AND vec_id <> 40"), 20).toPandas()
    w, hit = np.float32(v).astype(float), 0
    assert set(found["query_id"]) == set(range(0, 1200, 20)) - {40}
    for q, part in found.groupby("query_id"):
        s = w @ w[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -s))[:20]
        part = part.sort_values("rank")
        hit += len(set(best) & set(part["vec_id"]))
        assert np.allclose(part["score"], s[part["vec_id"]], rtol=1e-12) and list(part["rank"]) == list(range(1, 21))
        if 100 <= q < 140:  # forty equal vectors tie at every rank: the smaller ids come first
            assert list(part["vec_id"]) == [x for x in range(100, 140) if x != q][:20]
    assert hit / (20 * found["query_id"].nunique()) >= 0.97
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_neighbours_in_double_precision(spark):
    rows = [(0, [0.3, 0.7]), (1, [1.0, 0.1]), (2, [1e-60, 1e200]), (3, [-0.2, 0.1]), (20, [0.3, 0.7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): (r["rank"], r["score"]) for r in ann.nearest(table, table.filter("vec_id % 20 = 0")).collect()}
    assert found[0, 1] == (3, 0.3 * 1.0 + 0.7 * 0.1) and found[0, 2] == (1, 0.7e200) and found[20, 0] == (2, 0.3 * 0.3 + 0.7 * 0.7)
    assert len(found) == 8


@pytest.mark.parametrize("spread", [0.3, None])
def test_recall_on_one_full_shard(spread):
    """As many vectors as a shard has on average, clustered and without any structure."""
    rng, n = np.random.default_rng(0), 8192
    v = rng.normal(size=(n, 64)) if spread is None else rng.normal(size=(64, 64))[rng.integers(64, size=n)] + spread * rng.normal(size=(n, 64))
    points, links = ann.build_graph(v)
    asked = v[:200]
    found, _ = ann._beam(points, links, ann.entries(n), np.concatenate([asked, np.zeros((200, 1))], 1), 256)
    true = np.argsort(-(asked @ v.T), 1)[:, :20]
    exact = np.einsum("qbj,qj->qb", v[found], asked)
    best = np.take_along_axis(found, np.argsort(-exact, 1)[:, :20], 1)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(true, best, strict=True)]) / 20 >= 0.94


def test_a_shard_has_a_task_of_its_own(spark):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    index = ann.build_index(rows, shard_rows=40, min_shards=10)
    tasks = index.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("shard").alias("n")).collect()
    assert [r["n"] for r in tasks] == [1] * 10 and index.agg(F.sum(F.size("ids"))).first()[0] == 400


def test_the_beam_is_as_wide_as_measured(spark):
    """Vectors of one length are found by a narrow beam; others get one as wide as they need; over all shards little is lost."""
    assert ann.share_of(20, 1) == 21 and ann.share_of(20, 75) == 2
    rng, n, shards = np.random.default_rng(4), 16384, 16
    hard = rng.normal(size=(n, 32))
    widths = []
    for v in (np.float32(hard / np.linalg.norm(hard, axis=1)[:, None]), np.float32(hard)):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
        index = materialize(ann.build_index(rows, shard_rows=n // shards), "graphs")
        asked = rows.filter("vec_id % 128 = 0")
        widths.append(ann.beam_width(index, asked, 20, shards))
        found = ann.search(index, asked, 20).toPandas().groupby("query_id")["vec_id"].agg(set)
        hit = []
        for q, ids in found.items():
            s = v.astype(float) @ v[q].astype(float)
            s[q] = -np.inf
            hit.append(len(ids & set(np.argsort(-s)[:20].tolist())) / 20)
        assert len(hit) == n // 128 and np.mean(hit) >= 0.95
    assert widths[0] < 128 and widths[0] <= widths[1]


def test_classifiers_on_odd_rows(spark, odd, empty, labels):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))
    for f, name in ((quality.classify, "quality"), (toxicity.classify, "toxic")):
        rows = f(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows), name
        assert f(empty, labels).count() == 0 and f(odd, labels.limit(0)).count() == len(ODD)
    assert langid.identify(empty).count() == 0


def test_held_out_accuracy(spark):
    far = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{far}/documents.parquet").select("doc_id", "lang")
    known = spark.read.parquet(f"{far}/labels.parquet")
    rows = queries.QUERIES["op3_language_id"](spark, far).join(docs, "doc_id").filter("held_out")
    assert rows.selectExpr("avg(int(lang = lang_pred))").first()[0] > 0.97
    rows = queries.QUERIES["op8_pairwise_quality"](spark, far).join(known, "doc_id").filter("held_out")
    assert rows.selectExpr("avg(int(quality = predicted))").first()[0] > 0.93
    rows = queries.QUERIES["op10_toxicity_fm"](spark, far).join(known, "doc_id").filter("held_out AND toxic = 0")
    assert rows.selectExpr("avg(predicted)").first()[0] < 0.05


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    step = {name: f for name, f in corpus_pipeline.STAGES}
    kept = materialize(step["language"](spark, docs, DIR), "t")
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    kept = materialize(step["quality"](spark, kept, DIR), "t")
    assert kept.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    root = brute_components({k: brute_simhash(t) for k, t in before.items()})
    kept = materialize(step["dedup"](spark, kept, DIR), "t")
    assert {r["doc_id"] for r in kept.collect()} == set(root.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    kept = materialize(step["mix"](spark, kept, DIR), "t")
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter({k: n for k, n in copies.items() if n})
    rows = step["encode"](spark, kept, DIR).collect()
    assert len(rows) == kept.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in rows)
    strange = odd.select(*docs.columns)
    for name, f in corpus_pipeline.STAGES:
        assert materialize(f(spark, strange, DIR), "t").count() <= 2 * len(ODD), name
