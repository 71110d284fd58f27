"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning.  On a documented sample (at most ``SAMPLE`` vectors, those with the least hash of the id) the mean and
an orthogonal rotation are learned by alternating between sign codes and the rotation that fits them best
(iterative quantisation); the sample also sets the Hamming radius that holds the nearest neighbours of
``TARGET`` of its queries.  Every row is coded and indexed.

Index.  A code of ``BITS`` bits is cut into ``PARTS`` substrings, each with its own bucket lists.  Two codes within
Hamming radius r agree in one substring up to r // PARTS bits (pigeonhole), so probing the buckets of
every substring within that distance retrieves each code within the radius; the retrieved codes are
then checked on all bits, and what lies within the radius is ranked by the exact distance of the floats.
Fewer than k codes within the radius: the radius grows until there are k, or all rows of the block.

Distribution.  Rows are dealt into blocks of about ``BLOCK`` vectors with an index each; the stated queries are
sent to every block in groups of ``QUERIES``, and a block returns k rows per query, so the hot bucket of
one block is bounded by the block.  Equal vectors are one entry with the k + 1 least ids (no query can
return more of them), which the window's partial limit cuts before the shuffle.

Defined results: vectors that are null, zero, empty, or hold a null or non-finite component take no part, nor do
rows with a null id; vectors of another length than the most common one take no part; repeated rows of
an id count once per distinct vector (a query's own id is never returned); ties go to the smaller id;
fewer candidates than k are all returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.stage import staged

SAMPLE = 8_192
SAMPLE_QUERIES = 256
BITS = 64
PARTS = 8
PART_BITS = BITS // PARTS
TARGET = 0.99
ROUNDS = 40
BLOCK = 8_192
QUERIES = 1_024

_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def learn(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection to BITS signs, radius) from sample vectors."""
    mean = x.mean(axis=0)
    z = x - mean
    dim = z.shape[1]
    _, vec = np.linalg.eigh(z.T @ z)
    rng = np.random.default_rng(11)
    base = vec[:, ::-1][:, :min(dim, BITS)]
    # fewer dimensions than bits: several rotations side by side
    parts, left = [], BITS
    while left > 0:
        width = min(left, base.shape[1])
        p = z @ base[:, :width]
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
            r = vt.T @ u.T
        parts.append(base[:, :width] @ r)
        left -= width
    proj = np.concatenate(parts, axis=1)
    if len(x) <= k + 1:
        return mean, proj, BITS
    codes = encode(x, mean, proj)
    q = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
    far = []
    for i in q:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argpartition(d, k - 1)[:k]
        far.append(_POP8[codes[near] ^ codes[i]].sum(axis=1))
    return mean, proj, int(np.quantile(np.concatenate(far), TARGET))


def encode(x: np.ndarray, mean: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Codes as rows of PARTS bytes: one byte per substring."""
    return np.packbits((x - mean) @ proj >= 0, axis=1)


class BlockIndex:
    """Bucket lists of every substring over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(PARTS)]
        self.start = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within ``radius`` of the code: probed by substring, then checked on all bits."""
        reach = radius // PARTS
        seen = np.zeros(len(self.codes), bool)
        for s in range(PARTS):
            probes = np.flatnonzero(_POP8[np.arange(256, dtype=np.uint8) ^ code[s]] <= reach)
            starts, ends = self.start[s][probes], self.start[s][probes + 1]
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b > a:
                    seen[self.order[s][a:b]] = True
        rows = np.flatnonzero(seen)
        return rows[_POP8[self.codes[rows] ^ code].sum(axis=1) <= radius]


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(model, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mean, proj, radius = model.value
        if left.num_rows == 0 or right.num_rows == 0:
            return _HITS.empty_table()
        x = np.stack([np.frombuffer(v, np.float64) for v in left["vec"].to_pylist()])
        ids = left["ids"].to_pylist()
        index = BlockIndex(encode(x, mean, proj))
        out = [[], [], []]
        for qid, raw in zip(right["query_id"].to_pylist(), right["vec"].to_pylist()):
            q = np.frombuffer(raw, np.float64)
            code = encode(q[None], mean, proj)[0]
            r, found = radius, []
            while True:
                rows = index.within(code, r)
                d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
                near = rows if len(rows) <= k + 1 else rows[d <= np.partition(d, k)[k]]
                dist = d if len(rows) <= k + 1 else d[d <= np.partition(d, k)[k]]
                found = sorted((s, i) for s, row in zip(dist.tolist(), near.tolist()) for i in ids[row] if i != qid)[:k]
                if len(found) >= k or r >= BITS:
                    break
                r = min(BITS, r + PARTS)
            out[0] += [qid] * len(found)
            out[1] += [i for _, i in found]
            out[2] += [s for s, _ in found]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], schema=_HITS)
    return run


_CLEAN = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])


def _clean(batches):
    """Usable vectors as doubles."""
    for b in batches:
        ids, dims, raw = [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or not v or any(c is None for c in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                x = x + 0.0  # -0.0 and 0.0 are equal components
                ids.append(i)
                dims.append(len(x))
                raw.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], schema=_CLEAN)


def nearest(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row where ``queries`` holds.

    ``queries`` is a column condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
                  .mapInArrow(_clean, "vec_id long, dim int, vec binary"), "vectors")
    common = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("dim") == common[0].dim).select("vec_id", "vec")
    sample = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("vec").collect()  # 8,192 rows at most
    model = spark.sparkContext.broadcast(learn(np.stack([np.frombuffer(r.vec, np.float64) for r in sample]), k))

    w = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("key", F.md5("vec")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    entries = few.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = staged(entries.select("key", "vec", "ids"), "entries")
    asked = staged(rows.where(queries).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("query_id"), "vec"), "queries")
    n_blocks = -(-entries.count() // BLOCK)
    n_groups = -(-asked.count() // QUERIES)
    # a query group meets every block: the keys below name the pairs of a block and a group
    blocks = entries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(n_blocks, 1)))) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(n_groups - 1, 0)))))
    groups = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(max(n_groups, 1))).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks - 1, 0)).cast("long"))))
    hits = blocks.groupBy("block", "group").cogroup(groups.groupBy("block", "group")) \
        .applyInArrow(_search(model, k), "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
