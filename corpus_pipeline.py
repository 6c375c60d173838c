"""From raw documents to token ids: five stages over the table ``documents``.

1. language: documents whose language is rejected go (no letter, or a calibrated probability that is too low);
2. quality: documents that the pairwise ranking puts below its threshold go;
3. dedup: of each group of SimHash near-duplicates the document with the smallest id stays;
4. mix: documents are repeated or dropped so that each source takes its target of words;
5. encode: byte-level BPE ids of every row that is left, decoded again to check them.

Each stage gets what the one before it has kept, written as Parquet and read again.

Edge cases, alike for every stage: an empty table gives an empty one; columns beside those
of ``documents`` stay as they are, whatever their names, up to the last stage, which has
columns of its own; texts are read whole, however long. Null and empty texts are rejected
by the first stage; later stages, given any, score them, group them (fingerprint 0), give
them no copies (size 0), and encode them as no ids. A null id is an id like any other,
and null is a source of its own. Of repeated rows the third stage keeps one; the fourth
makes copies of each row by itself. Ties: equal scores share their decision; of a group
the least (doc_id, fingerprint, text) stays; of one source and size, rows with the least
hashes of their ids get the larger number of copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catlake.llm import bpe, langid, mixing, quality, simhash
from catlake.llm.common import materialize, table

TOKENIZER = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(quality.known_labels(docs, table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.shares(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids of every row, and the digest of what they decode to."""
    back = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("language", language), ("quality", quality_filter), ("dedup", dedup), ("mix", mix), ("encode", encode)]

#: SQL can't express the trained models, the fingerprints or the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
