"""Embedding tables ``(id int, vec array<float>)``: gather, per-token mean, global
mean for new special tokens, append.  The dimension comes from the data.

Means are computed per ``(id, dim)`` after one join and one ``posexplode``:
partial averages are combined map-side, so a hot group (one new token built from a
third of all rows, or one old row shared by many new tokens) never lands whole in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small


def to_long(emb: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``(id, dim, value double)``."""
    return emb.select(F.col(id_col).alias("id"), F.posexplode(vec_col).alias("dim", "value")) \
              .withColumn("value", F.col("value").cast("double"))


def from_long(long: DataFrame, id_col: str = "id") -> DataFrame:
    """Inverse of :func:`to_long` (one group per row id, bounded by the dimension)."""
    g = long.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_s"))
    return g.select(F.col(id_col).alias("id"),
                    F.transform("_s", lambda s: s["value"].cast("float")).alias("vec"))


def gather_rows(mapping: DataFrame, emb: DataFrame, new_col: str = "new_id", old_col: str = "old_id",
                mapping_rows: int | None = None) -> DataFrame:
    """Row ``old_id`` of ``emb`` becomes row ``new_id``.

    Every mapped id must have a row: a missing one raises when the result is computed (see
    :func:`missing_rows` for the list), so a pruned table is never silently short.
    """
    m = mapping.select(F.col(new_col).cast("int").alias("_new"), F.col(old_col).alias("_old"))
    j = m.join(emb.select(F.col("id").alias("_old"), "vec"), "_old", "left")
    return j.select(F.col("_new").alias("id"), F.coalesce("vec", _lost(F.col("_old"))).alias("vec"))


def missing_rows(mapping: DataFrame, emb: DataFrame, old_col: str = "old_id") -> DataFrame:
    """Mapped ids that have no row in the embedding table."""
    return mapping.select(F.col(old_col).alias("id")).distinct().join(emb.select("id"), "id", "left_anti")


def _lost(member: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no embedding row for id "), F.coalesce(member.cast("string"), F.lit("null")))).cast("array<float>")


def mean_rows_long(members: DataFrame, emb: DataFrame, group_col: str = "new_id",
                   member_col: str = "old_id", missing: str = "raise") -> DataFrame:
    """A4: ``(group, dim, value)`` = mean of the rows of each group's members.

    A member without a row raises when the result is computed (:func:`missing_rows` lists them);
    with ``missing="skip"`` the mean is over the members that have one.
    """
    m = members.select(group_col, F.col(member_col).alias("_old"))
    rows = emb.select(F.col("id").alias("_id"), F.col("vec").alias("_vec"))
    j = m.join(rows, F.col("_old") == F.col("_id"), "inner" if missing == "skip" else "left")
    vec = F.col("_vec") if missing == "skip" else F.when(F.col("_id").isNull(), _lost(F.col("_old"))).otherwise(F.col("_vec"))
    ex = j.select(group_col, F.posexplode(vec).alias("dim", "value"))
    return ex.groupBy(group_col, "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))


def mean_rows(members: DataFrame, emb: DataFrame, group_col: str = "new_id",
              member_col: str = "old_id") -> DataFrame:
    return from_long(mean_rows_long(members, emb, group_col, member_col), group_col)


def global_mean_long(emb: DataFrame) -> DataFrame:
    """``(dim, value)``: mean of all rows (partial averages per task, one row per dim)."""
    return (emb.select(F.posexplode("vec").alias("dim", "value"))
            .groupBy("dim").agg(F.avg(F.col("value").cast("double")).alias("value")))


def global_mean_vector(emb: DataFrame) -> list[float]:
    """The table mean as a driver-side list: its size is the dimension, not the data."""
    rows = global_mean_long(emb).collect()
    vec = [0.0] * len(rows)
    for r in rows:
        vec[r["dim"]] = float(r["value"])
    return vec


def resize_long(emb: DataFrame, new_ids: list[int] | None = None, n_new: int = 1) -> DataFrame:
    """A5 in long form: old rows plus ``new_ids`` (default: after the largest id), each the global mean.

    The mean vector and new ids are plan-time literals exploded next to each other: no join.
    """
    if new_ids is None:
        top = emb.agg(F.max("id")).first()[0]
        start = 0 if top is None else int(top) + 1
        new_ids = list(range(start, start + n_new))
    mean = F.lit(global_mean_vector(emb))
    spark = emb.sparkSession
    new = (spark.createDataFrame([(int(i),) for i in new_ids], "id int")
           .select("id", F.posexplode(mean).alias("dim", "value")))
    return to_long(emb).unionByName(new)


def extend_long(emb: DataFrame, new_rows_long: DataFrame) -> DataFrame:
    """Rows kept, new rows appended (long form)."""
    return to_long(emb).unionByName(new_rows_long.select("id", "dim", "value"))


def with_fallback_mean(members: DataFrame, emb: DataFrame, new_ids: DataFrame,
                       group_col: str = "new_id", member_col: str = "old_id") -> DataFrame:
    """A4 + deliberate departure: a new id without any member row gets the table mean.

    Members without a row are passed over here: the table may be shorter than the old vocabulary.
    """
    means = mean_rows_long(members, emb, group_col, member_col, missing="skip").withColumnRenamed(group_col, "id")
    have = means.select("id").distinct()
    orphan = new_ids.select(F.col(group_col).alias("id")).join(have, "id", "left_anti")
    fill = orphan.select("id", F.posexplode(F.lit(global_mean_vector(emb))).alias("dim", "value"))
    return means.unionByName(fill)
