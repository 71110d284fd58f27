"""Streamed datasets.

A streamed dataset is a file stream with an explicit schema.  Filters and
projections run as stateless streaming operators (X1); the batch functions that
need an ordered, finite input (tokenize + regroup, pack, buffer shuffle) run per micro-batch in
``foreachBatch`` (X2), writing each micro-batch to its own ``batch_id=`` folder
with overwrite, so a retried micro-batch replaces its own output and nothing else.

Batches of rows follow the rows' order, not files or micro-batches.  What has to live on between micro-batches (rows of a
batch that is not complete yet, the number of rows so far) is a table per micro-batch in a shared folder, never a
variable of the driver, so a query can be stopped after any micro-batch, or before its end is handled, and
started again.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import truthy
from ..operators.ordinal import with_ordinal_n
from ..operators.split import left_buffer, rest_of_buffer, seeded_hash
from ..sources.files import file_system


@dataclass
class StreamRules:
    """Options checked before a streamed query starts."""

    max_steps: int | None = None
    val_size: float = 0.0
    stage: str = "pt"
    max_samples: int | None = None

    def check(self) -> None:
        if self.max_steps is None or self.max_steps <= 0:
            raise ValueError("a streamed dataset needs a positive max_steps")
        if self.val_size > 1e-6 and self.val_size < 1:
            raise ValueError("a streamed dataset takes a whole number of eval rows as val_size")
        if self.stage == "ppo":
            raise ValueError("the ppo stage does not read streamed data")
        if self.max_samples is not None:
            warnings.warn("max_samples does not apply to streamed data and is switched off", stacklevel=2)
            self.max_samples = None


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int = 1, **options) -> DataFrame:
    """Lazy single pass over the files of ``path``."""
    return (spark.readStream.format(fmt).schema(schema).options(**options)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


def stream_filter(stream: DataFrame, prompt: str = "prompt") -> DataFrame:
    """The pretraining filter as a stateless streaming predicate."""
    return stream.where(truthy(prompt))


def _run(stream: DataFrame, sink, checkpoint_dir: str) -> None:
    """``foreachBatch`` with ``availableNow``: every file present at start is processed, then the query stops."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_batches(stream: DataFrame, fn, out_dir: str, checkpoint_dir: str,
                fmt: str = "parquet") -> None:
    """``fn(micro_batch_df, batch_id) -> DataFrame`` per micro-batch, written idempotently."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        out = fn(batch, batch_id)
        out.write.mode("overwrite").format(fmt).save(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
    _run(stream, sink, checkpoint_dir)


def last_batch(spark: SparkSession, path: str) -> int:
    """The greatest micro-batch whose table under ``path`` is complete (``_SUCCESS``), or -1."""
    fs, home = file_system(spark, path)
    if not fs.exists(home):
        return -1
    done = -1
    for status in fs.listStatus(home):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done = max(done, int(name.split("=")[1]))
    return done


def with_stream_ordinal(stream: DataFrame) -> DataFrame:
    """Adds the places that :func:`run_row_batches` numbers rows by: file, block, place in the block's task."""
    return stream.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


class Carried:
    """What a streamed step hands from one micro-batch to the next: a table of rows and the number of rows so far.

    Both are tables per micro-batch, written whole, so a replayed micro-batch writes its own again.
    """

    def __init__(self, stream: DataFrame, carry_dir: str, ordinal: str, more: str):
        self.spark, self.dir, self.ordinal = stream.sparkSession, carry_dir, ordinal
        self.numbered = ordinal not in stream.columns
        self.kept = [c for c in stream.columns if c not in ("_file", "_block")]
        schema = [f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in self.kept]
        self.schema = ", ".join(schema + [f"`{ordinal}` bigint"] * self.numbered + [more])

    def table(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.dir}/batch_id={batch_id}")

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.dir}/batch_id={batch_id}")
        return self.table(batch_id)

    def rows_before(self, batch_id: int) -> int:
        if batch_id == 0:
            return 0
        return int(self.spark.read.schema("n bigint").parquet(f"{self.dir}-rows/batch_id={batch_id - 1}").first()["n"])

    def note_rows(self, n: int, batch_id: int) -> None:
        self.spark.range(1).select(F.lit(n).cast("bigint").alias("n")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.dir}-rows/batch_id={batch_id}")

    def number(self, batch: DataFrame, before: int) -> tuple[DataFrame, int]:
        """The rows numbered from ``before`` on by file and place in the file, and the number of rows so far."""
        placed = batch.withColumn("_place", F.monotonically_increasing_id())
        rows, n = with_ordinal_n(placed, F.col("_file"), F.col("_block"), F.col("_place"), name=self.ordinal)
        return rows.select(*self.kept, (F.col(self.ordinal) + F.lit(before)).cast("bigint").alias(self.ordinal)), before + n


def run_row_batches(stream: DataFrame, fn, out_dir: str, checkpoint_dir: str, carry_dir: str, batch_rows: int,
                    ordinal: str = "ordinal") -> None:
    """``fn(rows with columns ordinal, batch) -> DataFrame`` over batches of ``batch_rows`` filtered rows.

    Batches follow the rows' ``ordinal`` (dense from 0 over the filtered rows).  A stream without that column (see
    :func:`with_stream_ordinal`) is numbered here: rows of a micro-batch by file and place in the file, after the rows of
    the micro-batches before it, whose number is part of the micro-batch's table.

    A micro-batch writes its rows and those carried to it once, marked by whether their batch is complete; complete
    ones go to ``fn``, the others are carried.  When the stream has ended, the last, short batch is handled as the output
    of the micro-batch that would come next.  Which one that is, is read from the complete tables, so a query that
    stopped anywhere goes on when it is started again; files that arrive later continue the open batch and their
    micro-batch replaces its short output.
    """
    carried = Carried(stream, carry_dir, ordinal, "batch bigint, closed boolean")
    number = (F.col(ordinal) / F.lit(batch_rows)).cast("bigint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if carried.numbered:
            rows, total = carried.number(batch, carried.rows_before(batch_id))
            carried.note_rows(total, batch_id)
        rows = rows.withColumn("batch", number)
        if batch_id > 0:
            rows = rows.unionByName(carried.table(batch_id - 1).where("not closed").drop("closed"))
        whole = F.count(F.lit(1)).over(Window.partitionBy("batch")) == batch_rows      # groups of batch_rows rows
        held = carried.write(rows.withColumn("closed", whole), batch_id)
        fn(held.where("closed").drop("closed")).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    _run(stream, sink, checkpoint_dir)
    end_stream(carried.spark, lambda i: fn(carried.table(i).where("not closed").drop("closed")), out_dir, carry_dir)


def _dense_until(ordinals: DataFrame, ordinal: str, start: int) -> int:
    """The least number from ``start`` on that is not among the ordinals (all at least ``start``)."""
    here = ordinals.select(F.col(ordinal).alias("_o"))
    after = here.unionByName(here.sparkSession.range(start - 1, start).toDF("_o")).select((F.col("_o") + 1).alias("_o"))
    return int(after.join(here, "_o", "left_anti").agg(F.min("_o")).first()[0])


def run_buffer_shuffle(stream: DataFrame, out_dir: str, checkpoint_dir: str, carry_dir: str, buffer_size: int, seed: int,
                       ordinal: str = "ordinal", rank: str = "rank") -> None:
    """L4 on a stream: a rolling buffer of ``buffer_size`` rows with random replacement.

    The first rows fill the buffer; each later one takes a seeded draw of its places and the row that sat there goes out.
    When the stream has ended, what the buffer holds goes out in seeded order.  ``rank`` is the row's place in the shuffled
    stream.  The order of the rows is their ``ordinal`` (dense from 0; numbered here where the stream has none, see
    :func:`run_row_batches`); rows that come before one with a lesser ordinal wait for it, and a number that never
    comes is an error when the stream ends.

    The buffer, and rows that wait, are a table per micro-batch, so the query can be stopped anywhere and started again.
    A micro-batch costs one window over its rows and the buffer, in as many groups as the buffer has places.
    """
    if buffer_size < 1:
        raise ValueError("a shuffle buffer holds at least one row")
    carried = Carried(stream, carry_dir, ordinal, f"`{rank}` bigint")

    def held(batch_id: int) -> DataFrame:
        return carried.table(batch_id).where(F.col(rank).isNull())

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows, before = batch, carried.rows_before(batch_id)
        if carried.numbered:
            rows, ready = carried.number(batch, before)
        if batch_id > 0:
            rows = rows.unionByName(held(batch_id - 1).drop(rank))
        if not carried.numbered:
            ready = _dense_until(rows.where(F.col(ordinal) >= before), ordinal, before)
        carried.note_rows(ready, batch_id)
        out = carried.write(left_buffer(rows, ordinal, seed, buffer_size, ready, rank), batch_id)
        out.where(F.col(rank).isNotNull()).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    def rest(batch_id: int) -> DataFrame:
        n, rows = carried.rows_before(batch_id + 1), held(batch_id)
        if not rows.where(F.col(ordinal) >= n).isEmpty():
            raise ValueError(f"the stream ended without row {n}, and holds later ones")
        return rest_of_buffer(rows, ordinal, seed, buffer_size, n, rank)

    _run(stream, sink, checkpoint_dir)
    end_stream(carried.spark, rest, out_dir, carry_dir)


def end_stream(spark: SparkSession, rest, out_dir: str, carry_dir: str) -> None:
    """Writes ``rest(last micro-batch)`` as the output of the micro-batch that would come next."""
    last = last_batch(spark, carry_dir)
    if last >= 0:
        rest(last).write.mode("overwrite").parquet(f"{out_dir}/batch_id={last + 1}")


def split_head_stream(stream: DataFrame, val_size: float, ordinal: str = "ordinal") -> DataFrame:
    """L3 on a stream: the first ``int(val_size)`` rows by ordinal are 'eval' (stateless, any arrival order)."""
    return stream.withColumn("split", F.when(F.col(ordinal) < int(val_size), F.lit("eval")).otherwise(F.lit("train")))


def shuffle_buffers(rows: DataFrame, key: str, seed: int, buffer_size: int, ordinal: str = "batch") -> DataFrame:
    """L4 on a stream: seeded-hash order inside each buffer of ``buffer_size`` rows (``batch`` of
    :func:`run_row_batches`); ``rank`` is the row's place in the shuffled stream."""
    w = Window.partitionBy(ordinal).orderBy(seeded_hash(seed, key), F.col(key))  # bounded by the buffer
    return rows.withColumn("rank", F.col(ordinal) * buffer_size + F.row_number().over(w) - 1)


def run_stateless(stream: DataFrame, out_dir: str, checkpoint_dir: str, fmt: str = "parquet") -> None:
    """A stateless streaming query (filters, projections) straight into a file sink
    (exactly-once through the sink's commit log), processing what is there, then stopping."""
    q = (stream.writeStream.format(fmt).option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
