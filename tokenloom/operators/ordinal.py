"""Explicit row order.

Packing, ``max_samples``, head splits and new vocabulary ids all depend on row
order, which Spark does not keep.  ``with_ordinal`` gives a dense 0..n-1 index in
the order of unique sort keys without a single-partition window: a range sort,
one reliable checkpoint (the id assignment must not change if a task is retried),
per-partition counts (one row per partition) and their offsets as a broadcast table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition id above bit 33


def with_ordinal_n(df: DataFrame, *order: Column | str, name: str = "ordinal") -> tuple[DataFrame, int]:
    """``(df + dense name column, row count)``; see :func:`with_ordinal`.

    Per-partition counts (one row per partition of the sorted table) and their running
    offsets are a small table, broadcast and joined by partition id; only the total reaches
    the driver.
    """
    ordered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_pid", F.coalesce(before, F.lit(0)).alias("_off"))
    numbered = ordered.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
    return numbered.withColumn(name, (F.col("_off") + local).cast("bigint")).drop("_mid", "_pid", "_off"), int(total)


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Add a dense ``name`` column (bigint, from 0) following ``order``.

    The order columns must identify a row, else ties break arbitrarily.
    """
    return with_ordinal_n(df, *order, name=name)[0]


def ordinal_from_key(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Dense ordinal from a unique key column (e.g. ``doc_id``)."""
    return with_ordinal(df, F.col(key).asc(), name=name)


# Boundaries above this count are not broadcast; the wide-row ordinal is used instead.
MAX_BOUNDARIES = 4_000_000


def assign_batches(df: DataFrame, key: str, batch_rows: int, name: str = "_batch",
                   max_boundaries: int = MAX_BOUNDARIES) -> DataFrame:
    """``name`` = (dense rank of ``key``) div ``batch_rows``, without sorting the wide rows.

    Only the key column is ranked (narrow sort + checkpoint); the first key of every
    batch (n / batch_rows keys, size-checked) is broadcast and each row finds its batch
    by binary search in an Arrow-batched UDF.  The wide rows then move once, in the
    caller's per-batch window.  Above ``max_boundaries``, and where keys are null (they come first, in a fixed
    but arbitrary order, and fill their own share of batches), the wide rows are ranked directly.
    """
    keys, n = with_ordinal_n(df.select(key), F.col(key).asc(), name="_o")
    n_batches = -(-n // batch_rows)
    if n_batches > max_boundaries or not keys.where(F.col(key).isNull()).isEmpty():
        ranked = with_ordinal(df, F.col(key).asc(), name="_o")
        return ranked.withColumn(name, (F.col("_o") / F.lit(batch_rows)).cast("bigint")).drop("_o")
    firsts = [r[0] for r in keys.where(F.col("_o") % batch_rows == 0).orderBy("_o").select(key).collect()]
    bounds = df.sparkSession.sparkContext.broadcast(np.asarray(firsts))

    @F.pandas_udf("bigint")
    def batch_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, k.to_numpy(), side="right") - 1, dtype="int64")

    return df.withColumn(name, batch_of(F.col(key)))
