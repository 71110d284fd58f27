"""First-N per dataset, exact seeded train/eval split, head split, seeded shuffle.

Random operators are seeded hashes of a stable row key, so results are exact in
size, reproducible, and unchanged under repartitioning or task retries.  A shuffle ranks
by hash (a distributed sort plus dense ordinal, no single final task); a split only
selects one boundary by histograms of the hash and sorts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal


def seeded_hash(seed: int, key: Column | str) -> Column:
    """``md5('<seed>:<key>')`` as hex: the order DuckDB can reproduce."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def eval_size(n: int, val_size: float) -> int:
    """``val_size > 1``: that many rows; a share below 1 is rounded up; 1 means one row."""
    if val_size <= 1e-6:
        return 0
    if val_size >= 1:
        return int(val_size)
    return int(math.ceil(val_size * n))


def seeded_rank(df: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """L4: dense rank by ``seeded_hash`` (ties broken by the key)."""
    return with_ordinal(df.withColumn("_h", seeded_hash(seed, key)), F.col("_h"), F.col(key),
                        name=name).drop("_h")


def buffer_slot(seed: int, ordinal: str, buffer_size: int) -> Column:
    """Place of a shuffle buffer that row ``ordinal`` takes: the first rows fill it in turn, each later one takes a seeded draw."""
    draw = F.conv(F.substring(seeded_hash(seed, ordinal), 1, 8), 16, 10).cast("bigint")
    return F.when(F.col(ordinal) < buffer_size, F.col(ordinal)).otherwise(draw % F.lit(buffer_size))


def left_buffer(rows: DataFrame, ordinal: str, seed: int, buffer_size: int, ready: int, name: str = "rank") -> DataFrame:
    """``name``: the place at which a rolling shuffle buffer gives the row away, null while the buffer holds it.

    Row t pushes the row out that sits in its slot, as row t - buffer_size of the shuffled order.  So a row leaves with the next
    row of its slot: one window per slot tells all places, without walking through the rows.  Rows from ordinal ``ready`` on wait.
    """
    waits = F.col(ordinal) >= F.lit(ready)
    w = Window.partitionBy(waits, buffer_slot(seed, ordinal, buffer_size)).orderBy(ordinal)
    return rows.withColumn(name, F.when(~waits, F.lead(ordinal).over(w) - F.lit(buffer_size)).cast("bigint"))


def rest_of_buffer(rows: DataFrame, ordinal: str, seed: int, buffer_size: int, n: int, name: str = "rank") -> DataFrame:
    """Places of the rows (``buffer_size`` at most) that a buffer still holds after all ``n`` rows: in seeded order, last."""
    w = Window.orderBy(seeded_hash(seed, ordinal), ordinal)  # bounded by the buffer
    return rows.withColumn(name, (F.row_number().over(w) - 1 + F.lit(max(n - buffer_size, 0))).cast("bigint"))


#: Hex digits by which a histogram narrows the place of the cut, and keys that are looked at one by one.
STEP_DIGITS = 4
BAND_ROWS = 10_000


def hash_cut(df: DataFrame, key: str, h: Column, k: int, counts: dict, band_rows: int = BAND_ROWS) -> tuple:
    """``(hash, key)`` of the row at rank ``k`` (from 0) of the rows with a key, by distributed selection.

    ``counts`` is the histogram of the hash's first digits.  The band that holds rank ``k`` is cut into finer ones by the next
    digits until it has at most ``band_rows`` rows; only that band's distinct keys are then put in order.  Each
    step is one scan of the key with a partial aggregation into at most 16 ** STEP_DIGITS counts; nothing is sorted.
    """
    prefix, left = "", k
    while True:
        for digits in sorted(counts):
            if left < counts[digits]:
                break
            left -= counts[digits]
        prefix += digits
        band = df.select(F.col(key).alias("_k"), h.alias("_h")).where(F.col("_h").startswith(prefix))
        if counts[digits] <= band_rows or len(prefix) == 32:
            break
        step = F.substring("_h", len(prefix) + 1, STEP_DIGITS)
        counts = dict(band.groupBy(step).count().collect())
    # a key that repeats is one row here, so a hot key leaves a band of one
    for row in sorted(band.groupBy("_h", "_k").count().collect(), key=lambda r: (r["_h"], r["_k"])):
        if left < row["count"]:
            return row["_h"], row["_k"]
        left -= row["count"]
    raise ValueError("the rows changed while the split was made")


def split_exact(df: DataFrame, key: str, val_size: float, seed: int = 42,
                n_rows: int | None = None, band_rows: int = BAND_ROWS) -> DataFrame:
    """L2: adds ``split`` = 'eval' for exactly ``eval_size`` rows chosen by seeded hash, else 'train'.

    The row at rank k by ``(hash, key)`` is the first train row, and every row is labelled by comparing its
    ``(hash, key)`` with that one boundary.  It is found by a histogram of the hash (see :func:`hash_cut`): the
    rows, wide or narrow, are never sorted or moved.  Keys should be unique: rows that repeat the boundary's key all
    go to 'train'.  Rows with a null key come last, so they are 'train' unless every row is 'eval'.
    """
    h = seeded_hash(seed, key)
    first = F.substring(h, 1, STEP_DIGITS)
    counts = dict(df.select(first.alias("_d")).groupBy("_d").count().collect())
    n = sum(counts.values()) if n_rows is None else n_rows
    keyed = n - counts.pop(None, 0)
    k = eval_size(n, val_size)
    if k <= 0:
        return df.withColumn("split", F.lit("train"))
    if k >= n:
        return df.withColumn("split", F.lit("eval"))
    if k >= keyed:
        return df.withColumn("split", F.when(F.col(key).isNotNull(), F.lit("eval")).otherwise(F.lit("train")))
    bh, bk = (F.lit(v) for v in hash_cut(df, key, h, k, counts, band_rows))
    before = (h < bh) | ((h == bh) & (F.col(key) < bk))
    return df.withColumn("split", F.when(before, F.lit("eval")).otherwise(F.lit("train")))


def split_head(df: DataFrame, ordinal: str, val_size: float) -> DataFrame:
    """L3: the first ``int(val_size)`` rows by ordinal are 'eval', the rest 'train'."""
    k = int(val_size)
    return df.withColumn("split", F.when(F.col(ordinal) < k, F.lit("eval")).otherwise(F.lit("train")))


def first_n_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """L1: ``min(len, n)`` first rows of every group.

    ``row_number() <= n`` is planned with a partial window-group limit before the
    shuffle, so a huge group sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
