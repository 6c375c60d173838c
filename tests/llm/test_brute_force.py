"""Trained models against plain predictors, the mixture's dual against bisection, and the pipeline on strange tables."""

import collections
import itertools
import math
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from catlake.llm import bpe, characters, langid, mixing, quality, simhash, toxicity
from catlake.llm.common import materialize

DIR = "/root/testdata/sf0.001"
M = 1 << 32
TEXTS = ["Der schnelle Fuchs, 12 Hunde!", "a", "a b", "naïve É\n\nline one\nline one\nno no no no", "x" * 70_000, "word pair " * 20_000, "日本語 text 🙂", "#*$ {}|<> == ??", "  "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def letters(text):
    """Lower-cased runs of letters and marks, between single spaces."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" and unicodedata.category(c) != "Me" else " " for c in text.lower())
    return " " + " ".join(kept.split(" ")).strip() + " " if kept.strip(" ") else " "


def single_spaced(text):
    return " " + " ".join(x for x in letters(text).split(" ") if x) + " "


def plain_language(model, text):
    if not any(unicodedata.category(x)[0] == "L" for x in text):
        return "und", 0.0
    c = [ord(x) for x in single_spaced(text)]
    if len(c) < 3:
        return "und", 0.0
    counts = collections.Counter()
    for i in range(len(c)):
        h = 0
        for n in range(1, 5):
            if i + n > len(c):
                break
            h = c[i] if n == 1 else (h * 0x01000193 % M) ^ c[i + n - 1]
            counts[((h + n * 0x51ED27) % M * 2654435769 % M) >> (32 - langid.BITS)] += 1
    total = sum(counts.values())
    z = [(sum(n / total * float(model.logits[b, k]) for b, n in counts.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
    e = [math.exp(x - max(z)) for x in z]
    return model.langs[int(np.argmax(e))], max(e) / sum(e)


def test_language_by_a_plain_predictor(spark, docs):
    model = langid.train(docs)
    short = [t for t in TEXTS if len(t) < 1000] + ["\u0301", "\u093e 12", "12 \u0301\u0301 \u0bbe!", "e\u0301t\u0301"] + [r["text"][:600] for r in docs.limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(short)) + [(0, short[0])], "doc_id long, text string")
    found = langid.predict(rows, model).collect()
    assert len(found) == len(short) + 1
    for r in found:
        lang, score = plain_language(model, short[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)
        assert r["rejected"] == (lang == "und" or r["score"] < model.reject)
    # Blocks end between words, so a long text of repeated words is its words, however it is cut.
    once, often = (model.predict("guten Morgen liebe Welt " * n) for n in (10, 20_000))
    assert once[0] == often[0] and once[1] == pytest.approx(often[1], abs=0.02)


def plain_quality(model, text):
    kinds = characters.classes()
    grams = collections.Counter()
    for block in characters.blocks(text):
        k = [int(kinds[ord(x)]) for x in block]
        grams.update((a * 12 + b) * 12 + c for a, b, c in zip(k, k[1:], k[2:], strict=False))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    longest = max((len(list(g)) for _, g in itertools.groupby(words)), default=1)
    n, total = max(1, len(words)), max(1, sum(grams.values()))
    more = [sum(a == b for a, b in itertools.pairwise(words)) / n, (len(words) - len(set(words))) / n * 0.1, (len(lines) - len(set(lines))) / max(1, len(lines)), min(1.0, (longest - 1) / 8) ** 2]
    z = sum(float(model.weights[g]) * math.sqrt(v / total) for g, v in grams.items()) + sum(float(model.weights[1728 + i]) * math.sqrt(x) for i, x in enumerate(more))
    return 1 / (1 + math.exp(-max(-40, min(40, z - model.threshold))))


def test_quality_by_a_plain_predictor(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.train(quality.known_labels(docs, labels, sample=100), sample=100)
    rows = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0])], "doc_id long, text string")
    for r in quality.score(rows, model).collect():
        assert r["score"] == pytest.approx(plain_quality(model, TEXTS[r["doc_id"]]), abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.5)


def plain_terms(text):
    def number(word):
        return sum(ord(c) * pow(0x01000193, min(i, 63), M) for i, c in enumerate(word)) % M

    found = set()
    for word in single_spaced(text).split():
        found |= {number(word) * 3 % M} | {(number(word[:k]) + k) % M for k in (4, 5, 6)}
    return sorted(x - M if x >= M // 2 else x for x in found)


def plain_toxicity(model, text):
    place = {int(t): i for i, t in enumerate(model.chosen)}
    at = [place[t] for t in plain_terms(text) if t in place]
    z = model.bias + sum(float(model.weights[i]) for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(at, 2))
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_toxicity_by_a_plain_predictor(spark):
    far = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{far}/documents.parquet"), spark.read.parquet(f"{far}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")).filter("label IS NOT NULL")
    model = toxicity.train(rows)
    assert len(model.chosen)
    texts = TEXTS[:4] + TEXTS[5:] + [r["text"] for r in rows.filter("label = 1").limit(10).collect()]
    table = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    for r in toxicity.score(table, model).collect():
        assert r["score"] == pytest.approx(plain_toxicity(model, texts[r["doc_id"]]), abs=1e-6)
    assert toxicity.terms("Bad bad WORDS").tolist() == plain_terms("Bad bad WORDS")


def test_toxicity_learns_pairs(spark):
    """Either word alone is toxic and both together are not, which no sum of single weights can say."""
    kinds = {"bragor": 1, "velmik": 1, "bragor velmik": 0, "": 0}
    many = {"bragor": 300, "velmik": 300, "bragor velmik": 120, "": 600}
    rows = [(i, f"{k} plain filler text {i % 7}", kinds[k]) for i, k in enumerate(k for k, n in many.items() for _ in range(n))]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    for k, label in kinds.items():
        assert (model.score(f"{k} plain filler text") >= 0.5) == bool(label), k
    additive = toxicity.Model(model.chosen, model.bias, model.weights, np.zeros_like(model.factors))
    assert any((additive.score(f"{k} plain filler text") >= 0.5) != bool(label) for k, label in kinds.items())


def test_toxicity_held_out(spark):
    far = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{far}/labels.parquet")
    rows = toxicity.classify(spark.read.parquet(f"{far}/documents.parquet"), known).join(known, "doc_id").filter("held_out")
    caught = {r["toxic"]: r["p"] for r in rows.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert caught[1] >= 0.8 and caught[0] <= 0.01


def test_mixture_by_bisection(spark, docs):
    """The multipliers solve the dual, and a mix does not depend on how its table is dealt out."""
    rows = mixing.sizes(docs)
    histogram = materialize(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "t")
    sources = materialize(histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), "t")
    goals = mixing.targets(sources, (5, 2, 1)).join(sources.select("src", "n_docs"), "src")
    dual = mixing.multipliers(histogram, goals).toPandas()
    assert dual["rate_all"].isna().any()
    for r in dual[dual["rate_all"].isna()].itertuples():
        own = histogram.filter(F.col("src") == r.src).toPandas()
        words = lambda m: (own["n"] * own["size"] * np.minimum(2, np.exp(np.minimum(m * own["size"] / r.scale, 50)))).sum()  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < r.target else (low, middle)
        assert words(r.multiplier) == pytest.approx(r.target, rel=1e-5) and r.multiplier == pytest.approx(low, abs=1e-3)
    once, again = (sorted(map(tuple, mixing.mix(x).collect())) for x in (docs, docs.repartition(7, "text")))
    assert once == again


def test_mixture_of_repeated_ids(spark):
    data = [(i % 3, "w " * (1 + i % 2), "ab"[i % 5 == 0], i) for i in range(200)] + [(None, "one two", None, i) for i in range(20)] + [(7, None, "a", 0)]
    rows = spark.createDataFrame(data, "doc_id long, text string, source string, _copies int").repartition(5)
    found = materialize(mixing.shares(rows), "t")
    out = mixing.apply_mix(rows, found)
    assert out.columns == rows.columns
    made = collections.Counter(map(tuple, out.collect()))
    assert max(made.values()) <= 2 and set(made) <= set(data)
    want = collections.Counter()
    for r in mixing.mix(rows).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = collections.Counter()
    for (doc_id, text, _, _), n in made.items():
        got[doc_id, len((text or "").split())] += n
    assert got == +want


def test_long_texts_encode_as_tiktoken_does(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tik = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [None, "", "word " * 60_000, "x" * 3000, "naïve 日本語🙂 \n\n  " * 5000, "".join(map(chr, range(1, 50_000))), "same", "same"]
    rows = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == tik.encode_ordinary(text) and r["n_bytes"] == len(text.encode())
    table = bpe.token_bytes(path).to_pylist()
    assert all(table[rank] == token for token, rank in bpe.read_ranks(path).items())


def test_groups_keep_a_row_where_ids_and_names_clash(spark):
    a, b = "the river runs past the old mill and on to the sea", "a quarterly report lists figures that nobody has checked"
    rows = spark.createDataFrame([(3, a, 1, "p"), (3, b, 2, "q"), (5, b, 3, "r"), (3, b, 2, "a"), (None, a, 4, "n"), (None, "quite another text without an id", 5, "n")], "doc_id long, text string, fp int, TEXT string")
    kept = simhash.keep_first(rows, simhash.near_duplicates(rows))
    assert kept.columns == rows.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.filter("fp = 1 OR fp = 5").collect() + [r for r in rows.collect() if r[2] == 2 and r[3] == "a"]))


NAMES = ("TEXT", "DOC_ID", "fp", "_copies", "_made", "_c0", "_first", "_language", "copies", "size", "_size", "_row", "root")


def test_stages_keep_columns_whose_names_clash(spark, docs):
    wide = docs.select(*docs.columns, *[F.lit(f"own {n}").alias(f"x{i}") for i, n in enumerate(NAMES)]).toDF(*docs.columns, *NAMES)
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, DIR)
        assert got.columns == wide.columns, name
        ids = lambda x: sorted(r[0] for r in x.collect())
        assert ids(got) == ids(stage(spark, plain, DIR)), name
        assert tuple(got.first())[len(docs.columns):] == tuple(f"own {n}" for n in NAMES)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, DIR).count() == docs.count()


def test_pipeline_on_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 0 < out.count() <= 2 * docs.count()
