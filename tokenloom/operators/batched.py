"""G1: the batched map as an extension point.

``map_batches`` hands a user function the rows of one batch (``batch_rows`` rows in
order, as a pandas DataFrame) and lets it return any number of rows, like a batched
``map`` that may change the row count.  Batches are groups of ``applyInPandas``,
bounded by ``batch_rows``.  The built-in operators do not need it (they are Column
expressions); it is for functions that only exist in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, ordinal: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                batch_rows: int = 1000) -> DataFrame:
    """``fn(batch) -> rows`` per batch of ``batch_rows`` rows (``ordinal`` dense from 0);
    the output gets ``batch`` and ``row`` (position in the function's output)."""
    d = df.withColumn("_batch", (F.col(ordinal) / F.lit(batch_rows)).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["_batch"].iloc[0])
        rows = pdf.sort_values(ordinal).drop(columns=["_batch"]).reset_index(drop=True)
        out = fn(rows).reset_index(drop=True)
        out.insert(0, "row", range(len(out)))
        out.insert(0, "batch", b)
        return out

    return d.groupBy("_batch").applyInPandas(run, schema=f"batch long, row long, {schema}")
