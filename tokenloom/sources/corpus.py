"""Corpus lines for vocabulary training.

The trainer reads one sentence per line and skips lines longer than
``max_sentence_length`` bytes; empty lines carry no sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_lines(df: DataFrame, key: str, text: str = "text", max_bytes: int = 2000) -> DataFrame:
    """``(key, line_no, line)``: non-empty lines of at most ``max_bytes`` UTF-8 bytes."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.where((F.col("line") != "") & (F.octet_length("line") <= max_bytes))


def text_file_lines(spark, path: str, max_bytes: int = 2000) -> DataFrame:
    """Lines of text files (the trainer's own input form), same length rule."""
    df = spark.read.text(path)
    return df.where((F.col("value") != "") & (F.octet_length("value") <= max_bytes)) \
             .withColumnRenamed("value", "line")
