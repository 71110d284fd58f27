"""Concatenate the tokens of each batch of rows and cut them into
full blocks; the remainder of every batch is dropped, a batch shorter than one
block gives nothing.

Plan (offset form): ids of every row (``encode.encode_rows``) -> one window per batch (bounded by
``batch_rows`` rows) for running offsets and the batch total -> every row's ids cut where blocks begin
-> group by ``(batch, block)``.  Every shuffle group holds at most ``block`` tokens or
``batch_rows`` rows, so no group grows with the corpus or with a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Subwords
from .encode import encode_rows
from .vocab import Vocabulary


def batch_offsets(df: DataFrame, ordinal: str, n_col: str, batch_rows: int,
                  groups: list[str] | None = None, batch_col: str | None = None) -> DataFrame:
    """``_batch``, ``_off`` (tokens before the row in its batch), ``_tot`` (batch total).

    ``groups`` packs each group separately (e.g. one input file or dataset per group);
    the ordinal then counts rows inside its group.  With ``batch_col`` the batch is
    given and ``ordinal`` only orders rows inside it (any sortable key).
    """
    g = list(groups or [])
    if batch_col is not None:
        d = df.withColumn("_batch", F.col(batch_col))
    else:
        d = df.withColumn("_batch", (F.col(ordinal) / F.lit(batch_rows)).cast("bigint"))
    w = Window.partitionBy(*g, "_batch").orderBy(ordinal)
    return (d.withColumn("_off", F.coalesce(
                F.sum(n_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
             .withColumn("_tot", F.sum(n_col).over(Window.partitionBy(*g, "_batch")).cast("bigint")))


def pack_text(df: DataFrame, ordinal: str, text_col: str, vocab: Vocabulary,
              block: int = 512, batch_rows: int = 1000, groups: list[str] | None = None,
              batch_col: str | None = None) -> DataFrame:
    """Pretraining blocks: ``[groups], batch, block, input_ids array<int>, attention_mask array<int>``.

    ``ordinal`` must be dense from 0 over the rows that passed the filter (per group),
    unless ``batch_col`` already holds the batch (then ``ordinal`` is any order key).
    """
    g = list(groups or [])
    extra = [batch_col] if batch_col is not None else []
    # words are never merged: rows of one ordinal stay rows of their own; learned-BPE rows of one ordinal are one row
    enc = encode_rows(df.select(*g, *extra, ordinal, text_col), [*g, *extra, ordinal], text_col, vocab, "_ids",
                      merge=isinstance(vocab, Subwords))
    return pack_encoded(enc, ordinal, "_ids", block, batch_rows, g, batch_col)


def pack_encoded(df: DataFrame, ordinal: str, ids_col: str, block: int = 512, batch_rows: int = 1000,
                 groups: list[str] | None = None, batch_col: str | None = None) -> DataFrame:
    """The contract of :func:`pack_text` over already encoded rows.

    A row's ids are cut where its blocks begin, so what moves to a block is one slice per row, not
    one row per id; a group holds one block.
    """
    g = list(groups or [])
    extra = [batch_col] if batch_col is not None else []
    d = df.select(*g, *extra, ordinal, ids_col).withColumn("_n", F.size(ids_col).cast("bigint"))
    d = batch_offsets(d, ordinal, "_n", batch_rows, g, batch_col)
    size = F.lit(block).cast("bigint")
    full = (F.col("_tot") / size).cast("bigint") * size
    end = F.least(F.col("_off") + F.col("_n"), full)
    d = d.where((F.col("_off") < full) & (F.col("_n") > 0)).withColumn("_end", end)
    cuts = F.sequence((F.col("_off") / size).cast("bigint"), ((F.col("_end") - 1) / size).cast("bigint"))
    parts = d.select(*g, "_batch", "_off", "_end", ids_col, F.explode(cuts).alias("_blk"))
    first = F.greatest(F.col("_off"), F.col("_blk") * size)
    last = F.least(F.col("_end"), (F.col("_blk") + 1) * size)
    piece = F.slice(ids_col, (first - F.col("_off") + 1).cast("int"), (last - first).cast("int"))
    blocks = parts.select(*g, "_batch", "_blk", F.struct(first.alias("_p"), piece.alias("_s")).alias("_x")) \
        .groupBy(*g, "_batch", "_blk").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    ids = F.flatten(F.transform("_x", lambda x: x["_s"]))
    return blocks.select(*g, F.col("_batch").alias("batch"), F.col("_blk").alias("block"), ids.alias("input_ids"),
                         F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))
