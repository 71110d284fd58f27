"""Mixing several datasets.

Every dataset is a DataFrame with a unique order key (or its dense ingest
``ordinal``, which needs no sort).  Per-dataset starts and lengths are k numbers
(k = number of datasets), used as literals.
Oversampling emits each row's repeats with ``explode(sequence(...))`` instead of
joining a generated position table, so a tiny dataset repeated a million times
never becomes a hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_ordinal


def local_ordinals(datasets: list[DataFrame], key: str, names: list[str] | None = None,
                   systems: list | None = None) -> tuple[DataFrame, list[int]]:
    """Union with ``ds``, ``dataset``, optional ``system`` and ``o`` = dense row number inside
    its dataset; plus the k dataset sizes.

    With ``key == "ordinal"`` the datasets already carry their dense ingest order and
    nothing is sorted; otherwise each dataset is ranked by ``key``.
    """
    parts = []
    for i, df in enumerate(datasets):
        d = df.withColumn("o", F.col("ordinal")) if key == "ordinal" else \
            with_ordinal(df, F.col(key).asc(), name="o")
        d = d.withColumn("ds", F.lit(i)).withColumn("dataset", F.lit(names[i] if names else str(i)))
        if systems is not None:
            d = d.withColumn("system", F.lit(systems[i]).cast("string"))
        parts.append(d)
    rows = parts[0]
    for d in parts[1:]:
        rows = rows.unionByName(d, allowMissingColumns=True)
    counts = {r["ds"]: int(r["n"]) for r in rows.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).collect()}
    return rows, [counts.get(i, 0) for i in range(len(datasets))]


def concat(datasets: list[DataFrame], key: str, names: list[str] | None = None,
           systems: list | None = None) -> DataFrame:
    """Datasets one after another; ``position`` = start of the dataset + row number in it."""
    rows, sizes = local_ordinals(datasets, key, names, systems)
    starts, acc = [], 0
    for n in sizes:
        starts.append(acc)
        acc += n
    start = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("ds") + 1)
    return rows.withColumn("position", start + F.col("o")).drop("o")


def interleave_under(datasets: list[DataFrame], key: str, names: list[str] | None = None) -> DataFrame:
    """U2 first_exhausted: round robin until the shortest dataset ends (k * min_len rows)."""
    k = len(datasets)
    rows, sizes = local_ordinals(datasets, key, names)
    min_len = min(sizes) if sizes else 0
    return (rows.where(F.col("o") < min_len)
            .withColumn("position", F.col("o") * k + F.col("ds"))
            .drop("o"))


# Rows repeated more often than this are expanded in chunks spread over the tasks.
REPEAT_CHUNK = 4096


def interleave_over(datasets: list[DataFrame], key: str, names: list[str] | None = None,
                    chunk: int = REPEAT_CHUNK) -> DataFrame:
    """U2 all_exhausted: round robin, shorter datasets cycle, until the longest ends (k * max_len).

    Row ``o`` of a dataset of ``n`` rows appears at rounds ``o, o + n, o + 2n, ... < max_len``.
    A tiny dataset next to a huge one repeats each row up to ``max_len`` times: then the
    rounds are first cut into chunks, the chunk rows spread round-robin, and each task
    expands its own chunks, so no single task emits a hot row's copies.
    """
    k = len(datasets)
    rows, sizes = local_ordinals(datasets, key, names)
    max_len = max(sizes) if sizes else 0
    n = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in sizes]), F.col("ds") + 1)
    most_repeats = max((-(-max_len // x) for x in sizes if x), default=0)
    if most_repeats <= chunk:
        out = rows.withColumn("_i", F.explode(F.sequence(F.col("o"), F.lit(max_len - 1).cast("bigint"), n)))
    else:
        step = n * F.lit(chunk)
        starts = rows.withColumn("_c", F.explode(F.sequence(F.col("o"), F.lit(max_len - 1).cast("bigint"), step)))
        starts = starts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        end = F.least(F.col("_c") + step - n, F.lit(max_len - 1).cast("bigint"))
        out = starts.withColumn("_i", F.explode(F.sequence(F.col("_c"), end, n))).drop("_c")
    return out.withColumn("position", F.col("_i") * k + F.col("ds")).drop("o", "_i")


def _draws(spark, count: int, shares: list[float], seed: int) -> DataFrame:
    """``(p, ds)`` for the positions ``p`` below ``count``: a seeded hash of p against the cumulative shares."""
    total, acc, cum = sum(shares), 0.0, []
    for x in shares:
        acc += x / total
        cum.append(acc)
    # uniform in [0, 1) from 52 bits of md5('<seed>:<p>'): reproducible in plain SQL
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("p").cast("string"))), 1, 13)
    u = F.conv(bits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
    ds = F.lit(len(cum) - 1)
    for j in range(len(cum) - 2, -1, -1):
        ds = F.when(u < F.lit(cum[j]), F.lit(j)).otherwise(ds)
    return spark.range(0, count).withColumnRenamed("id", "p").withColumn("ds", ds)


def interleave_probs(datasets: list[DataFrame], key: str, probs: list[float], seed: int = 42,
                     names: list[str] | None = None, chunk: int = 1 << 16, until: str = "first") -> DataFrame:
    """Position p draws dataset d from a seeded hash and takes that dataset's next row.

    ``until="first"``: the mix ends with the draw that takes the last row of a dataset.
    ``until="all"``: datasets start over when used up, and the mix ends with the draw that
    uses up the last one.  So the end is the least, or the greatest, position of the n-th
    draw of a dataset of n rows.  Empty datasets count as used up from the start.

    Running draw counts use chunked prefix sums: per (chunk, dataset) counts, their offsets
    per dataset (one row per chunk), then a window bounded by the chunk size.  The counts are
    extended until they decide the end, then the positions below it are numbered once.
    """
    if len(probs) != len(datasets) or min(probs, default=0) <= 0:
        raise ValueError(f"{len(datasets)} datasets need as many positive probabilities, not {probs}")
    if until not in ("first", "all"):
        raise ValueError(f"until is 'first' or 'all', not {until!r}")
    spark = datasets[0].sparkSession
    rows, sizes = local_ordinals(datasets, key, names)
    pick = min if until == "first" else max
    if min(sizes) == 0 and until == "first" or max(sizes) == 0:
        return rows.where("false").withColumn("position", F.lit(0).cast("bigint")).drop("o")
    count, share = 0, [x / sum(probs) for x in probs]
    want = int(pick(n / x for n, x in zip(sizes, share) if n)) + 1
    while True:
        count = max(2 * count, want + 8 * int(want ** 0.5) + 8)
        per_chunk = _draws(spark, count, probs, seed).groupBy((F.col("p") / F.lit(chunk)).cast("bigint").alias("_c"), "ds") \
            .agg(F.count(F.lit(1)).alias("_k"))
        totals = {r["ds"]: int(r["k"]) for r in per_chunk.groupBy("ds").agg(F.sum("_k").alias("k")).collect()}
        enough = [totals.get(d, 0) >= n for d, n in enumerate(sizes) if n]
        if any(enough) if until == "first" else all(enough):
            break
    offs = per_chunk.withColumn("_off", F.coalesce(F.sum("_k").over(
        Window.partitionBy("ds").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pos = _draws(spark, count, probs, seed).withColumn("_c", (F.col("p") / F.lit(chunk)).cast("bigint")) \
        .join(offs.select("_c", "ds", "_off"), ["_c", "ds"])
    pos = pos.withColumn("_d", F.col("_off") + F.row_number().over(Window.partitionBy("_c", "ds").orderBy("p")) - 1) \
        .checkpoint(eager=True)
    size = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in sizes]), F.col("ds") + 1)
    last = [r["p"] for r in pos.where(F.col("_d") == size - 1).select("p").collect()]  # one row per dataset at most
    picked = pos.where(F.col("p") <= pick(last)).select(F.col("p").alias("position"), "ds", F.pmod(F.col("_d"), F.greatest(size, F.lit(1))).alias("o"))
    return picked.join(rows, ["ds", "o"]).drop("o")


def mix(datasets: list[DataFrame], key: str, strategy: str = "concat", probs: list[float] | None = None,
        seed: int = 42, names: list[str] | None = None) -> DataFrame:
    """U1-U3 by the declared strategy: concat, interleave_under (first exhausted) or interleave_over
    (all exhausted); the interleavings draw by ``probs`` if given, else take turns."""
    if strategy == "concat":
        if probs is not None:
            raise ValueError("probabilities are for the interleaving strategies")
        return concat(datasets, key, names)
    if strategy not in ("interleave_under", "interleave_over"):
        raise ValueError(f"unknown mix strategy {strategy!r}")
    first = strategy == "interleave_under"
    if probs is not None:
        return interleave_probs(datasets, key, probs, seed, names, until="first" if first else "all")
    return (interleave_under if first else interleave_over)(datasets, key, names)
