"""Queries of this folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epipanel.llm import (bpe, chat, fingerprints, lexical, lm_scoring, near_dedup, packing, quality, secret_scan, token_files,
                          topk, warc, whitening)
from epipanel.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into sequences of a power of two of ids, at most 1024."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to block files and read back."""
    return token_files.write_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10).drop("variant")


ORACLE["op8_topk"] = """
WITH whole AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.find(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from three quarters of the labels."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    ranking = quality.learn(docs, labels.filter(~quality.held_out()))
    scored = quality.score(docs, ranking)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprints.with_next(read_table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    return warc.write_and_read(read_table(spark, sf_dir, "pages"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents, on two-word shingles."""
    return near_dedup.near_copies(read_table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under a model of six sevenths of them."""
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE["op13_lexical_search"] = """
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tokens AS (
    SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM numbered),
counts AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM tokens GROUP BY r, term),
lengths AS MATERIALIZED (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark)
    GROUP BY item_id, term),
scored AS (
    SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r), whole
    GROUP BY item_id, r),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored JOIN numbered USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first sixteen components, whitened."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts hold the template's control strings."""
    own = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(own.unionByName(odd)), in_order=True)


ORACLE["op11_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, role IS NOT DISTINCT FROM 'assistant' AS learned, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', false, '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', true, '</s>[INST] ok [/INST]'),
escaped AS (
    SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS e
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN learned THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN learned THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(length(e) + CASE WHEN learned THEN length('</s>') ELSE length('<s>[INST][/INST]') + 1 + length(role) END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
