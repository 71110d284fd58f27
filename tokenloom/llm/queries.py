"""Registered queries of the subpackage: each applies one operator to its whole intended table."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tokenloom.llm.byte_bpe import encode_bytes
from tokenloom.llm.chat import round_trip
from tokenloom.llm.decontaminate import find_leaks
from tokenloom.llm.hard_negatives import hard_negatives
from tokenloom.llm.hash_index import nearest
from tokenloom.llm.language_id import identify, train
from tokenloom.llm.near_dup import near_duplicates
from tokenloom.llm.resample import resample
from tokenloom.llm.secret_scan import scan_secrets
from tokenloom.llm.stage import read
from tokenloom.llm.token_file import read_token_file, write_token_file
from tokenloom.llm.token_spans import attribute_tokens
from tokenloom.llm.toxicity import score_toxicity
from tokenloom.llm.warc import derive, responses
from tokenloom.session import stage_dir


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``."""
    return scan_secrets(read(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, written as token files and read back."""
    path = stage_dir(spark, "token-file")
    write_token_file(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_token_file(spark, path)


def op3_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of ``embeddings`` to each row whose id is divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


PROBE_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted ``conversations`` and the probe conversation -7, written and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    return round_trip(rows.unionByName(probe), stage_dir(spark, "chat"))


_ESCAPED = "replace(text, '\\', '\\\\')"
for _control in ("<|turn|>", "</turn>", "<|image:", "<|audio:", "<|document:"):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '\\l{_control[1:]}')"

CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + length(role) + 17) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that hold items of ``benchmark``, re-parameterised ones too."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of ``documents``, learned from ``labels``."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page of ``pages``."""
    return derive(responses(read(spark, sf_dir, "pages")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text of ``documents``, and their decoded bytes."""
    return encode_bytes(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every whole text of ``documents``."""
    return attribute_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` (3-word shingles, Jaccard of 0.85 or more)."""
    return near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", k=3, percent=85)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn by word weights towards ``benchmark``, exactly ranked."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, most=1, buckets=10_000,
                    seed=2024, least_words=20)


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

RESAMPLE_SQL = f"""
WITH crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: {_CRC_STEP}) ORDER BY i) AS t FROM range(256) r(i)),
feats AS (SELECT 0 AS side, doc_id AS id, unnest({_WORDS}) AS word FROM documents
  UNION ALL SELECT 1, NULL, unnest({_WORDS}) FROM benchmark),
words AS (SELECT word, encode(word) AS raw FROM (SELECT DISTINCT word FROM feats)),
buckets AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(raw)),
      lambda i: ('0x' || substr(hex(raw), CAST(2 * i + 1 AS INT), 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, crc),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM feats JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, totals),
weights AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM feats JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
    count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM ranked
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for the anchors whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, scale=256, positives=5,
                          negatives=5, low_percent=80)


HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
    list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from its labelled rows."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_file, op3_hash_search, op4_chat_format, op5_decontaminate, op6_toxicity, op7_warc_derivatives, op8_byte_bpe,
                                   op9_token_spans, op10_minhash_near_dup, op11_resample, op12_hard_negatives, op13_language_id)}

ORACLES: dict[str, str] = {"op4_chat_format": CHAT_SQL, "op11_resample": RESAMPLE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
