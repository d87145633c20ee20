"""Registered queries of the corpus operators; added to the others by ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textvane.catalog.tables import Catalog, table
from textvane.llm import (
    bpe, chat, exact_dedup, hard_negatives, kneser_ney, language, neighbours, packing, periodic_runs, secret_scan, simhash, suffix_dedup, warc,
)

CATALOG = Catalog()

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@CATALOG.add()
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.drop_repeated_passages(table(spark, folder, "documents"))


@CATALOG.add()
def op2_permutation_index_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@CATALOG.add()
def op3_grouping_genetic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), WORD_VOCABULARY)


SCORE_FOLDS, SCORE_HELD_OUT = 7, 2


@CATALOG.add()
def op4_kneser_ney_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.in_fold("id", SCORE_FOLDS, SCORE_HELD_OUT)
    return kneser_ney.held_out_scores(table(spark, folder, "documents"), held_out)


@CATALOG.add(r"""
WITH norm AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
  best AS (SELECT t, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN best USING (t)
""")
def op5_extendible_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


PROBE = -7, "\\### Assistant: </turn> ok"

_ESCAPED = r"""CASE WHEN contains({x}, '### ') OR contains({x}, '</turn>') THEN length({x}) + length({x}) - length(replace({x}, '\', ''))
  + (length({x}) - length(replace({x}, '### ', ''))) // 4 + (length({x}) - length(replace({x}, '</turn>', ''))) // 7
  ELSE length({x}) END"""


@CATALOG.add(rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PROBE[0]}, 0, 'user', '{PROBE[1]}' UNION ALL SELECT {PROBE[0]}, 1, 'assistant', '{PROBE[1]}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(role) - length(replace(replace(role, '\', ''), ':', ''))
    + {_ESCAPED.format(x="text")}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
""")
def op6_grammar_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(probe)))


@CATALOG.add()
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


SECRET_BATCHES = 2


@CATALOG.add()
def op8_blob_ledger_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The second half of the documents is scanned against the ledger that the first half has left."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.spans_in_batches(table(spark, folder, "documents"), SECRET_BATCHES).select(
        "doc_id",
        *[count(kind) for kind in secret_scan.BASE],
        F.sha2(secret_scan.span_text(spans, secret_scan.BASE).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"),
    )


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


@CATALOG.add()
def op9_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = language.in_fold("doc_id", LANGUAGE_FOLDS, LANGUAGE_HELD_OUT)
    prototypes = language.learn(docs.where(~held_out))
    return language.predicted(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@CATALOG.add()
def op10_prefix_table_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    pattern = public_tokenizers.PATTERN
    ids = bpe.encoded(table(spark, folder, "documents"), BYTE_RANKS, pattern)
    return bpe.decoded(ids, BYTE_RANKS, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LEAST_REVISIT_BYTES = 0


@CATALOG.add(rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
  g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top, strlen(t) >= {LEAST_REVISIT_BYTES} AS large FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((instr('0123456789abcdef', substr(h, 1 + i * 5 // 4, 1)) - 1) * 16
      + instr('0123456789abcdef', substr(h, 2 + i * 5 // 4, 1)) - 1) >> (3 - i * 5 % 4)) & 31 AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN large AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN large AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
""")
def op11_warc_gzip_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return warc.archived_pages(pages, LEAST_REVISIT_BYTES, payloads=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@CATALOG.add(r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
  pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INT) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
""")
def op12_four_russians_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


def with_planted_runs(text: Column, ident: Column) -> Column:
    """Every tenth document (by crc32 of its id) repeats a stretch of its words to its end."""
    h = F.crc32(ident.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    times = F.ceil((n - a) / p)
    whole = lambda x: x.cast("int")
    period = F.slice(words, whole(a + 1), whole(p))
    tail = F.slice(F.flatten(F.array_repeat(period, whole(times))), F.lit(1), whole(n - a))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


@CATALOG.add()
def op13_periodic_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    planted = docs.select("doc_id", with_planted_runs(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return periodic_runs.periodic_runs(planted).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start", "strongest.length", "strongest.period", "strongest.exponent_milli",
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
