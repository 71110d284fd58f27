"""Stage-table cache, vocabulary sink, size-bounded shards with an index."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .files import file_system


def fingerprint(df: DataFrame, **settings) -> str:
    """Names what a cached table was made from: input files (path, size, time), plan and settings."""
    spark = df.sparkSession
    files = []
    for f in sorted(df.inputFiles()):
        fs, p = file_system(spark, f)
        st = fs.getFileStatus(p)
        files.append((f, st.getLen(), st.getModificationTime()))
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    return hashlib.sha256(json.dumps([files, plan, settings], sort_keys=True, default=str).encode()).hexdigest()[:24]


def stage_table(make: Callable[[], DataFrame], spark: SparkSession, path: str, key: str, overwrite: bool = False) -> DataFrame:
    """The encoded table cached under ``path`` for ``key``, made and written only if it is not there.

    A hit (a complete write, marked by ``_SUCCESS``) is tested before anything else runs; reading back
    the written table also cuts the lineage (a shared-folder table, not a local cache).  A table is written
    under a private name and published by renaming the folder, so a reader never sees half of one; of two
    writers of one key the first to publish stands, and the other's table is deleted.
    """
    home = f"{path.rstrip('/')}/{key}"
    fs, mark = file_system(spark, f"{home}/_SUCCESS")
    if overwrite or not fs.exists(mark):
        draft = f"{path.rstrip('/')}/.{key}-{uuid.uuid4().hex[:12]}"      # a hidden name: readers pass over it
        make().write.parquet(draft)
        _, drafted = file_system(spark, draft)
        _, place = file_system(spark, home)
        if overwrite or not fs.exists(mark):
            fs.delete(place, True)
            fs.rename(drafted, place)
        if fs.exists(drafted):
            fs.delete(drafted, True)
        if not fs.exists(mark):
            raise OSError(f"could not publish {home}")
    return spark.read.parquet(home)


def write_vocab(table: DataFrame, path: str) -> None:
    """``(id, token, score)`` as Parquet."""
    table.select("id", "token", "score").write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, max_rows_per_file: int) -> None:
    """Files of at most ``max_rows_per_file`` rows (the size bound of a shard)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def shard_rows_for(max_bytes: int, dim: int, bytes_per_value: int = 4) -> int:
    """Rows per shard so that a shard of ``dim``-wide rows stays under ``max_bytes``."""
    return max(1, max_bytes // max(1, dim * bytes_per_value))


def write_byte_shards(df: DataFrame, path: str, key: str, row_bytes: Column, max_bytes: int,
                      shards_per_task: int = 8) -> DataFrame:
    """S9 for rows of unequal size: files of at most ``max_bytes`` (sum of ``row_bytes``), in key order, with an index.

    Rows are range-partitioned by key (rows of one key by their content), and every task cuts its sorted run into shards by
    a running sum: a shard is closed by the row that would not fit.  A row larger than the bound is a shard of its own; a null
    size counts as 0, null keys come first and aren't in the index's range of keys.  Columns of maps aren't taken.  Each shard is one file under ``shard=<task>-<number>``.

    The index (file, first_key, last_key, n_rows, n_bytes: one row per file) is read from the written files, stored under
    ``<path>/_index`` and returned; readers of ``path`` pass over it.  A table without rows has an empty index.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    taken = {"shard", "_bytes"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used by the shards")
    sized = df.withColumn("_bytes", F.greatest(F.coalesce(row_bytes.cast("long"), F.lit(0)), F.lit(0)))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    tasks = max(1, -(-total // (max_bytes * shards_per_task)))
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = sized.repartitionByRange(int(tasks), F.col(key).asc(), tie.asc()).sortWithinPartitions(key, tie)
    schema = StructType(sized.schema.fields).add("_shard", IntegerType()).add("_task", IntegerType())

    def cut(batches):
        task, shard, used, held = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            ends = np.cumsum(b.column(b.schema.get_field_index("_bytes")).to_numpy(zero_copy_only=False))
            number, at, base = np.empty(len(ends), np.int32), 0, 0
            while at < len(ends):
                stop = int(np.searchsorted(ends, base + max_bytes - used, "right"))
                if stop <= at and held:                  # the next row does not fit: a new shard
                    shard, used, held = shard + 1, 0, 0
                    continue
                stop = max(stop, at + 1)                 # a row larger than the bound stands alone
                number[at:stop] = shard
                used += int(ends[stop - 1]) - base
                held += stop - at
                at, base = stop, int(ends[stop - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number), pa.array(np.full(len(ends), task, np.int32))],
                                             names=[*b.schema.names, "_shard", "_task"])

    name = F.format_string("s%06d-%06d", "_task", "_shard")
    shards = ranged.mapInArrow(cut, schema).select(*df.columns, name.alias("shard"))
    shards.sortWithinPartitions("shard", key).write.mode("overwrite").partitionBy("shard").parquet(path)
    back = _shard_table(df, path).select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("_k"), row_bytes.cast("long").alias("_bytes"))
    index = back.groupBy("file").agg(F.min("_k").alias("first_key"), F.max("_k").alias("last_key"), F.count(F.lit(1)).alias("n_rows"),
                                     F.coalesce(F.sum("_bytes"), F.lit(0)).alias("n_bytes"))
    index.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_index")
    return read_shard_index(df.sparkSession, path)


def _shard_table(df: DataFrame, path: str) -> DataFrame:
    """The written shards of ``df``, with its schema and the shard's name."""
    return df.sparkSession.read.schema(StructType(df.schema.fields).add("shard", "string")).parquet(path)


def read_shard_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/_index")


def shard_files(spark: SparkSession, path: str, key) -> list[str]:
    """Files that can hold ``key``: one, or several where its rows fill more than one shard."""
    index = read_shard_index(spark, path)
    hit = index.where(F.lit(key).between(F.col("first_key"), F.col("last_key")))
    return sorted(r["file"] for r in hit.select("file").collect())


def read_key(spark: SparkSession, path: str, key_col: str, key) -> DataFrame:
    """The rows of one key, read from the files that the index names and no others."""
    files = shard_files(spark, path, key)
    if not files:
        return spark.read.parquet(path).drop("shard").where(F.lit(False))
    return spark.read.parquet(*files).where(F.col(key_col) == F.lit(key))
