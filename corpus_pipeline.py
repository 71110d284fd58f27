"""Corpus pipeline over ``documents``: each stage applies one operator and is written before the next.

Every stage but the last returns the columns of ``documents``; a stage that takes documents out leaves the
others as they are.  Rows with a null id are never taken out for what another row holds.

Every stage has the session hand texts to Python in batches of 1,000 rows at most (``bounded_batches``), as the stages
share their executors, and begins with freeing what the stages before it left on the driver (``let_go``) and in the
executors' heaps (``let_go_on_executors``); no result depends on any of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.joins import broadcast_if_small
from tokenloom.llm.byte_bpe import encode_bytes
from tokenloom.llm.decontaminate import find_leaks
from tokenloom.llm.near_dup import near_duplicates
from tokenloom.llm.secret_scan import redact_column
from tokenloom.llm.stage import bounded_batches, let_go, let_go_on_executors, read, staged
from tokenloom.llm.toxicity import ToxicityModel

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _begin(spark: SparkSession) -> None:
    bounded_batches(spark)
    let_go(spark)
    let_go_on_executors(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    _begin(spark)
    model = ToxicityModel(docs, read(spark, sf_dir, "labels"))
    return model.score(docs, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids`` (distinct, not null); broadcast only below the size limit."""
    return docs.join(broadcast_if_small(ids, bytes_per_row=16), "doc_id", "left_anti").select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id (5 words, 0.8).

    Of rows that repeat the kept id with the same text, one stays.
    """
    _begin(spark)
    rows = staged(near_duplicates(docs, "doc_id", "text", k=5, percent=80), "near-dup")
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = staged(ids.where("n > 1 or not kept"), "near-dup-ids")
    left = _without(docs, ids.select("doc_id"))
    again = ids.where("kept").select("doc_id")
    if again.isEmpty():
        return left
    w = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*COLUMNS)
    repeated = docs.join(broadcast_if_small(again, bytes_per_row=16), "doc_id", "left_semi")
    return left.unionByName(repeated.withColumn("r", F.row_number().over(w)).where("r = 1").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _begin(spark)
    leaks = find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, staged(leaks, "leaks"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text where it changed."""
    _begin(spark)
    new = docs.withColumn("clean", redact_column(F.col("text")))
    n = F.when(F.col("clean").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("clean").cast("long"))
    return new.select("doc_id", F.col("clean").alias("text"), "lang", "source", n.alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the decoded bytes."""
    _begin(spark)
    return encode_bytes(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_dup", near_dup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]

# Sketches, trained trees and tokenizer merges are outside SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored and read back as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
