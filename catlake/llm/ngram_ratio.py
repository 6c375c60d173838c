"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Rules count words, symbols, repeated lines and repeated five-word windows of each whole
text. The ratio compares two multinomials over hashed n-grams (single tokens and pairs of
neighbours; a token is a run of letters, digits, _ and characters beyond ASCII, or a run of ASCII signs): that of
the trusted target and that of the raw corpus. A document's score is the mean over its
n-grams of log(target / raw); it is kept if no rule fails and the score is at least
``least``.

Edge cases: a null or empty text has no words and fails the rules; a trusted id that has
no document counts for nothing; without trusted documents the target equals the smoothing
alone, so every score is far from the target and the ratio is taken as 0 (rules alone
decide); repeated rows count as often as they occur; null ids have results too; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, materialize, pick

TOKEN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-\^`{-~]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def _repeat_words(words: Column, window: int = 5) -> Column:
    """Words that lie in windows found twice or more; ``words`` is a variable of ``let``."""

    def covered(grams: Column) -> Column:
        # Equal windows are neighbours once sorted; then each repeated one covers up to the next.
        def marked(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["gram"] == x["gram"])) | F.coalesce(F.get(s, i + 1)["gram"] == x["gram"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["at"]))

        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))
        places = let(ordered, marked)
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.coalesce(F.get(p, i + 1) - at, F.lit(window)), F.lit(window))), F.lit(0), lambda a, n: a + n))

    def spelled(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.array_join(F.slice(w, i, window), " "))
        return let(grams, covered)

    # Equal windows have equal hashes: only texts in which hashes repeat need the windows themselves.
    last = F.size(words) - window
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spelled(words)))
    return F.when(last < 1, F.lit(0)).otherwise(repeated).cast("long")


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = pick(docs, "doc_id", "text").select(
        "doc_id",
        "text",
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("counted"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "text", "counted.n_words", "word_chars", "n_symbols", "n_dup_lines", "counted.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def grams(text: Column, buckets: int) -> Column:
    """The buckets of the text's tokens and of its pairs of neighbours."""

    def both(t: Column) -> Column:
        one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(t, i), x), F.lit(buckets)).cast("int"))
        return F.concat(one, two)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), both)


def weights(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = 1.0) -> DataFrame:
    """(bucket, weight): log(target share / raw share); at most ``buckets`` rows.

    ``trusted`` has a column doc_id. Counts are combined in each task, so its shuffle has a
    row for each task and bucket at most. The join with the ids is a merge join at every
    size, as their number grows with the corpus.
    """
    ids = pick(trusted, "doc_id").distinct().withColumn("trust", F.lit(1))
    marked = pick(docs, "doc_id", "text").join(ids.hint("merge"), "doc_id", "left")
    each = marked.select(F.explode(grams(F.col("text"), buckets)).alias("bucket"), F.coalesce("trust", F.lit(0)).alias("trust"))
    counts = materialize(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trust").alias("target")), "ngrams")
    all_raw, all_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = lambda n, of: (F.col(n) + smoothing) / (of + smoothing * buckets)
    ratio = F.log(share("target", all_target) / share("raw", all_raw)) if all_target else F.lit(0.0)
    return counts.select("bucket", ratio.alias("weight"))


def ratio_scores(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 16, least: float = -0.2) -> DataFrame:
    """The rules' columns of every row with its score (null without tokens) and kept.

    The weights reach the tasks as one array of ``buckets`` numbers, by a scalar subquery;
    scoring then needs no shuffle.
    """
    spark = docs.sparkSession
    known = weights(docs, trusted, buckets)
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(known, "bucket", "left")
    pairs = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    table = every.agg(F.transform(pairs, lambda p: p["weight"]).alias("weights")).scalar()
    score = let(
        grams(F.col("text"), buckets),
        lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda total, b: total + F.get(F.col("weights"), b)) / F.size(g)),
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(False))
    return rules(docs).withColumn("weights", table).withColumn("score", score).drop("text", "weights").withColumn("kept", kept)
