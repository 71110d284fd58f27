"""Readers for the Parquet tables the registered queries run on.

Only the needed columns are selected right after the scan so that Parquet reads
just those (visible as ``ReadSchema`` in the plan); filters written after this are
pushed into the scan by Catalyst.  A scan with fewer input splits than the
cluster has cores (e.g. one file with one row group) is spread round-robin, so
the per-row work after it (word splitting, exploding, Arrow UDFs) runs on every
core; at scale there are far more splits than cores and nothing is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df)
