"""Importance resampling towards a target corpus: array-scored weights, then a parallel sort by regular sampling.

1. Features of a text are its runs of ``1 .. n`` consecutive words (A-Z lower-cased, ``WORDS``), repeats
   counted; a feature falls into a bucket by the crc32 of its UTF-8 bytes.  Both corpora are counted per bucket
   with partial sums, so what comes back to the driver is one number per bucket and side.
2. The gain of every bucket is one array literal; a text is scored by folding the array look-ups of its
   buckets.  The weight is the floored mean gain, the score adds a Gumbel draw made from the id's hash, so the
   highest scores are a sample without replacement with odds by weight.
3. Rows that take part are ranked by a parallel sort by regular sampling: every task sorts its rows (a run, cut
   from its lineage by a written table), every ``step``-th row of every run is a sample, the sorted samples give
   regular splitters, the rows between two splitters are exchanged into one segment and merged there, and the
   prefix counts of the segments turn a row's place in its segment into its exact rank.  Sort keys end with the row's
   place in its run, so equal rows are split like any others; a segment holds about rows / segments of them.

Defined results: a null text has no words; a row without features has weight 0; a null id is hashed as an empty
string and comes after the other ids in a tie; rows that repeat an id are rows of their own; extra columns are
ignored.  With an empty target every gain follows from T = t = 0; with no rows the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.stage import staged

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # fixed value: the words of a lower-cased text
SAMPLES_PER_SEGMENT = 64
MAX_SEGMENTS = 4_096                          # splitters and prefix counts: at most this many rows on the driver
ROWS_PER_SEGMENT = 1_000_000                  # segments follow the rows; at least one a core
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST_ID = (1 << 63) - 1


def features(text: Column, most: int = 1) -> Column:
    """Runs of 1 to ``most`` consecutive words, joined by one space."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UP, _LOW), F.lit(WORDS), F.lit(0))

    def of_length(w: Column, n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    def runs(w: Column) -> Column:
        return F.concat(w, *[of_length(w, n) for n in range(2, most + 1)])
    return words if most == 1 else F.get(F.transform(F.array(words), runs), F.lit(0))


def bucket_array(text: Column, most: int, buckets: int) -> Column:
    """The bucket of every feature of a text."""
    return F.transform(features(text, most), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def bucket_counts(texts: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; the driver gets one row per bucket."""
    rows = texts.select(F.explode(bucket_array(F.col(text_col), most, buckets)).alias("bucket")) \
        .groupBy("bucket").agg(F.count("*").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Floored 1000-fold log ratio of the smoothed target and source shares, per bucket."""
    m = len(source)
    total_s, total_t = int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((float(t + 1) * float(total_s + m)) / (float(s + 1) * float(total_t + m))))
            for s, t in zip(source.tolist(), target.tolist())]


def draw_noise(id_col: Column, seed: int) -> Column:
    """Floored 1000-fold Gumbel draw from the first 8 hex digits of sha256('<seed>:<id>')."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_rows(docs: DataFrame, gains: list[int], id_col: str, text_col: str, most: int, seed: int,
               least_words: int) -> DataFrame:
    """(doc_id, n_features, weight, score, fit) of every row; ``fit`` marks texts of ``least_words`` words or more."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")   # folded to one literal by the optimizer
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), bucket_array(F.col(text_col), most, len(gains)).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n = F.size("b").cast("long")
    n_words = n if most == 1 else F.size(features(F.col(text_col)))
    if most > 1:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_words.alias("n_words"),
                           bucket_array(F.col(text_col), most, len(gains)).alias("b"))
        n_words = F.col("n_words")
    rows = rows.select("doc_id", n.alias("n_features"), total.alias("sum"), (n_words >= least_words).alias("fit"))
    # a floored mean in whole numbers: the remainder is taken off before the exact division
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")) \
        .otherwise(F.expr("(sum - pmod(sum, n_features)) div n_features"))
    rows = rows.withColumn("weight", weight)
    return rows.select("doc_id", "n_features", "weight", (F.col("weight") + draw_noise(F.col("doc_id"), seed)).alias("score"), "fit")


def segment_count(n: int, cores: int) -> int:
    return max(1, min(MAX_SEGMENTS, max(cores, -(-n // ROWS_PER_SEGMENT))))


def _segments(splitters: list[np.ndarray]):
    """Arrow step: the number of splitters that are not after a row, for rows with the key columns a, b, c."""
    def run(batches):
        n_split = len(splitters[0])
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "c")]
            n = batch.num_rows
            both = [np.concatenate((s, k)) for s, k in zip(splitters, keys)]
            # a splitter equal to a row counts as not after it: splitters stand first and the sort is stable
            order = np.lexsort((both[2], both[1], both[0]))
            before = np.cumsum(order < n_split)
            seg = np.empty(n, np.int32)
            rows = order >= n_split
            seg[order[rows] - n_split] = before[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seg)],
                                             schema=batch.schema.append(pa.field("segment", pa.int32())))
    return run


def regular_sample_rank(rows: DataFrame, high: str, low: str) -> tuple[DataFrame, int]:
    """(rows with their exact ``rank`` from 1, number of rows): falling ``high``, then rising ``low`` (nulls last)."""
    key = [F.col("a"), F.col("b")]
    runs = rows.withColumns({"a": -F.col(high).cast("long"), "b": F.coalesce(F.col(low).cast("long"), F.lit(_LAST_ID))}) \
        .sortWithinPartitions(*key).withColumn("c", F.monotonically_increasing_id())
    runs = staged(runs, "sorted-runs")                       # run = c >> 33, place in the run = the lower bits
    n = runs.count()
    parts = segment_count(n, rows.sparkSession.sparkContext.defaultParallelism)
    step = max(1, n // (parts * SAMPLES_PER_SEGMENT))
    place = F.col("c").bitwiseAND(F.lit((1 << 33) - 1))
    picked = runs.where(place % step == step // 2).select("a", "b", "c").toArrow()   # parts * SAMPLES_PER_SEGMENT rows, and one a run
    a, b, c = (picked[k].to_numpy() for k in ("a", "b", "c"))
    order = np.lexsort((c, b, a))
    cuts = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
    splitters = [k[cuts] for k in (a, b, c)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", segment int"
    cut = runs.mapInArrow(_segments(splitters), schema)
    sizes = {r.segment: r.n for r in cut.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for s in range(parts):
        offsets.append(before)
        before += sizes.get(s, 0)
    start = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    merged = Window.partitionBy("segment").orderBy("a", "b", "c")
    ranked = cut.withColumn("rank", F.get(start, F.col("segment")) + F.row_number().over(merged))
    return ranked.select(*rows.columns, "rank"), n


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every row's doc_id, n_features, weight, score and its rank among the drawn ones (null if not drawn).

    ``percent`` of the rows with at least ``least_words`` words are drawn: the highest scores, ties to smaller ids.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_text, most, buckets))
    scored = staged(score_rows(docs, gains, id_col, text_col, most, seed, least_words), "scored")
    ranked, n = regular_sample_rank(scored.where("fit").drop("fit"), "score", "doc_id")
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = scored.where("not fit").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", drawn.cast("long").alias("rank")).unionByName(rest)
