"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, chat, langid, mixing, ngram_ratio, packing, quality, simhash, toxicity, warc, whitening
from .common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op1_mix_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        "decoded_sha256",
        "n_bytes",
    )


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return ngram_ratio.ratio_scores(table(spark, sf_dir, "documents"), trusted)


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Both texts of an added conversation; they hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text")))
    back = chat.parse_conversations(chat.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "wrong_turn",
    )


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_mix_entropy_balancing, op2_graph_neighbours, op3_language_id, op4_simhash_near_duplicates, op5_byte_bpe,
    op6_warc_index, op7_ngram_ratio_rules, op8_pairwise_quality, op9_chat_template, op10_toxicity_fm,
    op11_filter_audit, op12_best_fit_packing, op13_whitening,
)}


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CHAT.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha, {10 * k + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31 AS BIGINT) + 1, 1)"
    for k in range(4)
    for j in range(8)
)

_LETTERS = [f"SELECT '{c}' AS c{{0}}, {1 << k} AS b{{0}}" for k, c in enumerate("ABCDE")]
_EACH = " UNION ALL ".join(_LETTERS)

ORACLE_SQL = {
    "op11_filter_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
             m AS (SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS first_id,
                          regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM d),
             l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
             f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                          (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
                          + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
                          + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
                          + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                          + (CASE WHEN first_id < m.doc_id THEN 16 ELSE 0 END) AS mask
                   FROM m LEFT JOIN l ON m.doc_id = l.doc_id),
             c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
             o AS (SELECT c1 || c2 || c3 || c4 || c5 AS filter_order, [b1, b2, b3, b4, b5] AS bits
                   FROM {", ".join(f"({_EACH.format(k)}) t{k}" for k in range(1, 6))}
                   WHERE b1 | b2 | b3 | b4 | b5 = 31),
             s AS (SELECT filter_order, step, bits[step] AS own, CAST(list_sum(list_slice([0] || bits, 1, step)) AS INTEGER) AS prior
                   FROM o, (SELECT unnest(range(1, 6)) AS step) x),
             r AS (SELECT part, filter_order, step, own,
                          CAST(coalesce(sum(n) FILTER (WHERE mask & (prior | own) = 0), 0) AS BIGINT) AS kept,
                          CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
                          CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & prior <> 0), 0) AS BIGINT) AS redundant,
                          CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
                          CAST(coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost,
                          CAST(coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost
                   FROM c, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
    "op6_warc_index": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
             b AS (SELECT page_id, html, sha, max(page_id) OVER (PARTITION BY sha) AS best FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < best THEN best END AS refers_to
        FROM b""",
    "op9_chat_template": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
             p AS (SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS past,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
                   FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
             v AS (SELECT *, CASE WHEN past IS NULL THEN role IN ('system', 'user') WHEN past = 'user' THEN role = 'assistant'
                                  ELSE past IN ('system', 'assistant') AND role = 'user' END AS right_turn FROM p),
             c AS (SELECT conv_id, count(*) AS n_turns, min(place) FILTER (WHERE NOT right_turn) AS wrong_turn,
                          bool_and(right_turn) AND bool_or(final AND role = 'assistant') AS valid,
                          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                          coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
                          CAST(sum({len(chat.CHAT.start) + 1 + len(chat.CHAT.end)} + length(role) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
                   FROM v GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars, valid, wrong_turn
        FROM c""",
}
