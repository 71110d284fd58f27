"""Size-checked broadcast.

A side is broadcast only when its measured row count times a per-row byte bound is
under the limit; otherwise the plain join is kept (sort-merge, with AQE's skew-join
splitting hot keys on the large side).  The limit follows the memory of the tasks
that must hold the broadcast table: executor memory / 64 (driver memory in local
mode), between 8 MB and 256 MB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LIMIT_BYTES = 8 << 20
MAX_LIMIT_BYTES = 256 << 20


def broadcast_limit(spark: SparkSession) -> int:
    conf = spark.sparkContext.getConf()
    mem = conf.get("spark.executor.memory", None)
    if mem is None or spark.sparkContext.master.startswith("local"):
        mem = conf.get("spark.driver.memory", "1g")
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return max(MIN_LIMIT_BYTES, min(MAX_LIMIT_BYTES, int(to_bytes(mem)) // 64))


def broadcast_if_small(df: DataFrame, rows: int | None = None, bytes_per_row: int = 64,
                       limit_bytes: int | None = None) -> DataFrame:
    """Return ``broadcast(df)`` when ``rows * bytes_per_row <= limit``.

    ``rows`` may be passed when already known (e.g. a vocabulary that was counted on
    creation); otherwise it is counted once, which is a cheap job on a narrow table.
    """
    limit = broadcast_limit(df.sparkSession) if limit_bytes is None else limit_bytes
    n = df.count() if rows is None else rows
    if n * bytes_per_row <= limit:
        return F.broadcast(df)
    return df
