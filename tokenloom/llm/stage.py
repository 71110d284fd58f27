"""Stage tables in the cluster's shared folder and readers used by the operators."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import stage_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` into the folder named by ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that every executor can read, so a lost executor costs a task
    retry and never a recomputation of what came before.  ``narrow`` tables (a few numbers a row) are
    written by at most four tasks per core, which spares iterative steps thousands of tiny files.
    """
    spark = df.sparkSession
    path = stage_dir(spark, name)
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    """glibc's call that returns freed memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


ROWS_AT_ONCE = 1_000


def bounded_batches(spark: SparkSession, rows: int = ROWS_AT_ONCE) -> None:
    """The session's Arrow batches hold at most ``rows`` rows from here on (a smaller setting stays).

    A batch of whole texts is held outside the heap in the executor's JVM and again in the Python worker, and the system's
    allocator keeps much of it in both; the default of 10,000 rows makes that the largest part of an executor's memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


PLAN_TEXT = 10_000


def let_go(spark: SparkSession) -> None:
    """Frees what finished work still holds on the driver; call it between stages.

    Python's handles keep the plans of earlier queries alive in the driver's JVM, and Spark removes their broadcasts and
    shuffle files only when a collection there finds them gone.  Plans are kept as text too, for listeners: that text is
    bounded from here on, as a literal table (the merge ranks) would fill megabytes with each copy.
    """
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if _trim() is not None:
        _trim()(0)


def let_go_on_executors(spark: SparkSession) -> None:
    """A collection in the executors' JVMs, by one small task per core; call it between stages, after ``let_go``.

    A JVM's heap keeps the size that the largest stage so far gave it, garbage included, beside the Python workers of the
    next one.  An executor that gets no task keeps its heap; no result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")) \
        .write.format("noop").mode("overwrite").save()


def giving_back(step):
    """An Arrow step over at most ROWS_AT_ONCE rows at a time that returns freed memory to the system at its end.

    Python workers stay for the tasks of later stages; without this each keeps the most it ever used.
    """
    def run(batches):
        parts = (b.slice(lo, ROWS_AT_ONCE) for b in batches for lo in range(0, b.num_rows, ROWS_AT_ONCE))
        try:
            yield from step(parts)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim() is not None:
                _trim()(0)
    return run
