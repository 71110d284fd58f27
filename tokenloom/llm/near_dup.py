"""Near-duplicate texts by HyperMinHash.

Sketch.  The distinct k-word shingle hashes of a text fall into 256 buckets by their top bits.  Each
bucket stores the smallest remaining hash in 16 bits: its count of leading zeros and ten mantissa
bits.  Empty buckets borrow a register of a filled one (a fixed random order per bucket) for
banding only.

Candidates.  Equal shingle sets are one class (digest of the whole set).  One sketch per class is cut
into bands of compressed registers; classes that agree in a band share a bucket.  Inside a bucket
texts are compared with a few pivots, never all with all: what a pivot does not link is compared
with further pivots, in rounds, until all members of the bucket lie in one component or every pair
between different components has been compared.  So links are complete for the components while
copies of one text cost one comparison each.  A bucket is streamed past its pivots' sketches, and a pair
leaves the task only if its sketches are likely to pass, in the least bucket that both texts share (in the
first round: once for the least members of all buckets).

Check.  A pair first passes a size test and the collision-corrected Jaccard estimate of the two
sketches (with a margin of 4.5 standard deviations), then the exact Jaccard test on full sets.

Defined results: a null or empty text (no words) has an empty set and is linked with nothing; every
input row gives one output row; rows that repeat an id with other texts are labelled one by one, and a
class of equal sets is represented by its least id; rows with a null id are linked with nothing and come
back with a null component; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm import textnum as tn
from tokenloom.llm.components import components
from tokenloom.llm.stage import giving_back, staged

BUCKETS = 256
BUCKET_BITS = 8
MANTISSA = 10
EMPTY = 0xFFFF
MORE_PIVOTS = 32        # pivots of a bucket: one in the first round, then this factor from round to round
GROUP = 4096            # members of a bucket in one task
PIVOT, MEMBER, BOTH = 0, 1, 2   # what a row is compared as; pivots come first


def band_rows(threshold: float, miss: float = 1e-6) -> int:
    """Most registers per band that miss a pair at the threshold with probability below ``miss``."""
    good = [r for r in range(1, 9) if (1 - threshold ** r) ** (BUCKETS // r) <= miss]
    return max(good) if good else 1


@functools.cache
def _borrow_order() -> np.ndarray:
    rng = np.random.default_rng(20240917)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def sketch(u: np.ndarray) -> np.ndarray:
    """256 registers (uint16) of sorted distinct hashes."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(u) == 0:
        return out
    low = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    pos = np.searchsorted(u, low)
    least = u[np.minimum(pos, len(u) - 1)]
    full = (pos < len(u)) & (least >> np.uint64(64 - BUCKET_BITS) == np.arange(BUCKETS, dtype=np.uint64))
    rest = least << np.uint64(BUCKET_BITS)
    # frexp of the top 53 bits gives the position of the leading one
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.minimum(zeros, 53).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[full] = ((zeros << np.uint64(MANTISSA)) | mantissa)[full].astype(np.uint16)
    return out


def bands(reg: np.ndarray, rows: int) -> np.ndarray:
    """Signed 64-bit keys of the bands of a non-empty sketch."""
    full = reg != EMPTY
    if not full.all():
        order = _borrow_order()
        src = order[np.arange(BUCKETS), full[order].argmax(axis=1)]
        # a borrowed register is told from an own one by the distance it was borrowed over
        reg = np.where(full, reg, reg[src])
    n = BUCKETS // rows
    m = reg[:n * rows].reshape(n, rows).astype(np.uint64)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(rows):
        h = tn.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return h.view(np.int64)


def _collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two registers of different minima agree, for sets of n and m hashes."""
    i = np.arange(0, 54)
    hi, lo = 1.0 - 0.5 ** (i + 1.0), 1.0 - 0.5 ** i

    def law(x):
        """P(leading zeros of the least of x / BUCKETS uniform values = i)."""
        x = np.maximum(x / BUCKETS, 1e-9)[:, None]
        return np.power(hi, x) - np.power(lo, x)
    return np.clip((law(n) * law(m)).sum(axis=1) * 0.5 ** MANTISSA, 0, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray):
    """Collision-corrected Jaccard estimates of rows of two register matrices, and the registers used."""
    used = (a != EMPTY) | (b != EMPTY)
    count = np.maximum(used.sum(axis=1), 1)
    same = (used & (a == b)).sum(axis=1) / count
    c = _collision(n.astype(float), m.astype(float))
    return (same - c) / (1 - c), count


def shingle_sets(batch_ids, col, k: int):
    """(position, sorted distinct shingle hashes) of every text of an Arrow column."""
    data, offsets = tn.utf8_buffers(col)
    for lo, hi in tn.slices(offsets):
        part = offsets[lo:hi + 1]
        words, at = tn.byte_words(data[part[0]:part[-1]], part - part[0])
        for j in range(hi - lo):
            yield lo + j, tn.shingle_hash(words[at[j]:at[j + 1]], k)


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("sketch", pa.binary())])

    def run(batches):
        for b in batches:
            ids, n, key, sk = b.column(0), [], [], []
            for _, u in shingle_sets(ids, b.column(1), k):
                n.append(len(u))
                key.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                sk.append(sketch(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(sk, pa.binary())], schema=schema)
    return run


def _sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for b in batches:
            out = [u.tobytes() for _, u in shingle_sets(b.column(0), b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())],
                                             schema=schema)
    return run


def _band_keys(rows: int):
    schema = pa.schema([("rep", pa.int64()), ("bucket", pa.int64())])

    def run(batches):
        for b in batches:
            reps = b.column(0).to_numpy(zero_copy_only=False)
            keys = [bands(np.frombuffer(s, np.uint16), rows) for s in b.column(1).to_pylist()]
            if keys:
                n = len(keys[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps, n), pa.int64()),
                                                  pa.array(np.concatenate(keys), pa.int64())], schema=schema)
    return run


def cut(n: np.ndarray, m: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    """Least estimate that a pair at the threshold shows, but for 4.5 standard deviations.

    The registers used are a sample, without replacement, of the union of the two sets.
    """
    union = np.maximum((n + m) / (1 + threshold), used)
    spread = np.sqrt(threshold * (1 - threshold) / used * np.maximum(1 - used / union, 0.02))
    return threshold - 4.5 * spread - 0.5 / used


def _likely(threshold: float):
    """Streams a bucket's members, its pivots first; yields pairs of different components that pass the
    size test and the estimate, each pair only in the least bucket that both share."""
    schema = pa.schema([(c, pa.int64()) for c in ("p", "m", "pc", "mc", "salt")])

    def run(batches):
        place, pivots = None, []
        for b in batches:
            if b.num_rows == 0:
                continue
            bucket, salt, kind, rep, comp, size = (b.column(c).to_numpy() for c in (
                "bucket", "salt", "kind", "rep", "comp", "n_shingles"))
            regs = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            lists = b.column("buckets")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            out = [[] for _ in schema]
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if (bucket[lo], salt[lo]) != place:
                    place, pivots = (bucket[lo], salt[lo]), []
                if kind[lo] != MEMBER:
                    pivots += [(rep[i], comp[i], size[i], regs[i], flat[off[i]:off[i + 1]]) for i in range(lo, hi)]
                if kind[lo] == PIVOT:
                    continue
                own, width = flat[off[lo]:off[hi]], np.diff(off[lo:hi + 1])
                for p, pc, n, sketch_p, list_p in pivots:
                    at = np.flatnonzero((rep[lo:hi] > p) & (comp[lo:hi] != pc)
                                        & (np.minimum(size[lo:hi], n) >= threshold * np.maximum(size[lo:hi], n) - 1e-9))
                    if not len(at):
                        continue
                    x = regs[lo:hi][at]
                    m = size[lo:hi][at].astype(float)
                    j, used = estimate(np.broadcast_to(sketch_p, x.shape), x, np.full(len(at), float(n)), m)
                    at = at[j >= cut(float(n), m, used, threshold)]
                    if not len(at):
                        continue
                    common = np.where(np.isin(own, list_p), own, np.iinfo(np.int64).max)
                    least = np.minimum.reduceat(common, np.cumsum(width) - width)
                    at = at[least[at] == bucket[lo]]
                    same = [np.full(len(at), v, np.int64) for v in (p, pc, salt[lo])]
                    for c, v in zip(out, (same[0], rep[lo:hi][at], same[1], comp[lo:hi][at], same[2])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], schema=schema)
    return run


def _verify(percent: int):
    """Streams (pivot, kind, components, set), the pivot's own sets first; yields links of components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(x, y):
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        inter = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * inter >= percent * (len(x) + len(y) - inter)

    def run(batches):
        pivot, own = None, []
        for b in batches:
            a, m = [], []
            hashes = b.column("hashes")
            for i, (p, kind, pc, mc) in enumerate(zip(*(b.column(c).to_pylist() for c in ("p", "kind", "pc", "mc")))):
                u = np.frombuffer(hashes[i].as_buffer(), np.uint64)
                if p != pivot:
                    pivot, own = p, []
                if kind == 0:
                    own.append(u)
                elif any(linked(o, u) for o in own):
                    a.append(pc)
                    m.append(mc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(m, pa.int64())], schema=schema)
    return run


def _salted(size: DataFrame, *keep) -> DataFrame:
    """One row per task of a group: a large one is dealt to several tasks (salts), each with all its pivots."""
    return size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts")))).select("salt", *keep)


def _first_candidates(open_: DataFrame, side: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs (p, m, pc, mc, salt) of the least member of each bucket with its other members.

    Most buckets of a group of near copies have the same few least members, so each (pivot, member) is taken once.
    """
    met = open_.where("rep <> pivot").select("pivot", "rep").distinct()
    size = met.groupBy("pivot").agg(F.floor(F.count("*") / GROUP).cast("int").alias("salts"))
    members = met.join(size, "pivot").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts") + 1).cast("int")) \
        .select("pivot", "salt", F.lit(MEMBER).alias("kind"), "rep")
    rows = members.unionByName(_salted(size, "pivot", F.lit(PIVOT).alias("kind"), F.col("pivot").alias("rep"))) \
        .join(side.select("rep", "n_shingles", "sketch"), "rep")
    return _compared(rows.select(F.col("pivot").alias("bucket"), "salt", "kind", "rep", F.col("rep").alias("comp"), "n_shingles", "sketch",
                                 F.array("pivot").alias("buckets")), threshold)


def _open(members: DataFrame, alive: DataFrame, pivots: int) -> DataFrame:
    """(bucket, rep, comp, c) of the buckets ``alive``; c, the bucket's size, only if that is above ``pivots``."""
    few = members.join(alive.where(F.col("c") <= pivots).select("bucket"), "bucket", "left_semi")
    many = members.join(alive.where(F.col("c") > pivots), "bucket")
    return many.select("bucket", "rep", "comp", "c").unionByName(few.select("bucket", "rep", "comp", F.lit(None).cast("long").alias("c")))


def _candidates(open_: DataFrame, side: DataFrame, pivots: int, threshold: float) -> DataFrame:
    """Likely pairs (p, m, pc, mc, salt) of the first ``pivots`` members of each bucket with its other members.

    The members of a bucket that has no more are all pivots of one another, sent once.
    """
    few = open_.where("c is null").select("bucket", F.lit(0).alias("salt"), F.lit(BOTH).alias("kind"), "rep", "comp")
    many = open_.where("c is not null").withColumn("salts", F.floor(F.col("c") / GROUP).cast("int"))
    members = many.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts") + 1).cast("int")) \
        .select("bucket", "salt", F.lit(MEMBER).alias("kind"), "rep", "comp")
    heads = _salted(_first(many, pivots), "bucket", F.lit(PIVOT).alias("kind"), "rep", "comp")
    return _compared(few.unionByName(members).unionByName(heads).join(side, "rep"), threshold)


def _first(members: DataFrame, pivots: int) -> DataFrame:
    """The first members of each bucket."""
    w = Window.partitionBy("bucket").orderBy("rep")
    return members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pivots).drop("r")


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "rep")
            .select("bucket", "salt", "kind", "rep", "comp", "n_shingles", "sketch", "buckets")
            .mapInArrow(giving_back(_likely(threshold)), "p long, m long, pc long, mc long, salt long"))


def _links(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of the pairs (p, m, pc, mc, salt) whose full sets pass.

    The salt that split a large bucket splits its pivots' pairs as well.
    """
    members = likely.join(sets.withColumnRenamed("rep", "m"), "m").select("p", "salt", F.lit(1).alias("kind"), "pc", "mc", "hashes")
    none = F.lit(None).cast("long")
    pivots = likely.select("p", "salt").distinct().join(sets.withColumnRenamed("rep", "p"), "p") \
        .select("p", "salt", F.lit(0).alias("kind"), none.alias("pc"), none.alias("mc"), "hashes")
    n = int(likely.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.unionByName(pivots).repartition(n, "p", "salt").sortWithinPartitions("p", "salt", "kind")
            .select("p", "kind", "pc", "mc", "hashes").mapInArrow(giving_back(_verify(percent)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their k-word shingle sets;
    ``component_id`` is the least id reachable and ``kept`` marks the row that carries it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(docs.mapInArrow(giving_back(_sketches(k)), "doc_id long, n_shingles long, set_key binary, sketch binary"),
                  "sketches")
    reps = staged(rows.where("set_key is not null and doc_id is not null").groupBy("set_key")
                  .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                       F.first("sketch").alias("sketch")), "classes")
    keys = reps.select("rep", "sketch").mapInArrow(giving_back(_band_keys(band_rows(percent / 100))), "rep long, bucket long")
    keys = staged(keys, "bands")
    once = _once(_signed(keys).where("c > 1")).select("bucket", F.col("lo").alias("pivot"))
    open_ = staged(keys.join(once, "bucket").select("bucket", "rep", "pivot"), "open")
    label = None
    if not open_.isEmpty():
        # a row per text from here on, its buckets in an array (one per band at most): rows per bucket are made of those still open
        mine = open_.groupBy("rep").agg(F.collect_set(F.when(F.col("rep") != F.col("pivot"), F.col("bucket"))).alias("rest"))
        side = staged(reps.select("rep", "n_shingles", "sketch").join(mine, "rep"), "open-sketches")
        # The join is a merge at every size: whether the ids would fit a broadcast grows with the data.
        sets = _full_sets(docs.join(side.select("rep").hint("merge"), docs.doc_id == F.col("rep"), "left_semi").where("text is not null"), k)
        likely = staged(_first_candidates(open_, side, percent / 100), "likely", narrow=True)
        label = _relabelled(side.select("rep", F.col("rep").alias("comp"), "rest"), likely, sets, percent)
        side = side.drop("rest")
        pivots = MORE_PIVOTS
        while True:
            members = staged(label.select("rep", "comp", F.explode("rest").alias("bucket")), "members", narrow=True)
            alive = _signed(members, F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
            alive = staged(_once(alive).select("bucket", "c"), "alive", narrow=True)
            if alive.isEmpty():
                break
            open_ = staged(_open(members, alive, pivots), "open", narrow=True)
            mine = open_.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
            likely = staged(_candidates(open_, side.join(mine, "rep"), pivots, percent / 100), "likely", narrow=True)
            many = open_.where("c is not null")
            done = _first(many, pivots).groupBy("rep").agg(F.collect_set("bucket").alias("done"))
            rest = many.groupBy("rep").agg(F.collect_set("bucket").alias("rest")).join(done, "rep", "left") \
                .select("rep", F.when(F.col("done").isNull(), F.col("rest")).otherwise(F.array_except("rest", "done")).alias("rest"))
            label = _relabelled(label.select("rep", "comp").join(rest, "rep", "left"), likely, sets, percent)
            pivots *= MORE_PIVOTS
    return _labelled(rows, reps, label)


def _signed(members: DataFrame, *more: Column) -> DataFrame:
    """Per bucket its number of members and what tells their set from others."""
    return members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi"),
                                         F.sum(F.pmod(F.xxhash64("rep"), F.lit(1 << 40))).alias("s"), *more)


def _once(signed: DataFrame) -> DataFrame:
    """One bucket of those with the same members (most bands of true copies): each is needed once."""
    return signed.groupBy("c", "lo", "hi", "s").agg(F.min("bucket").alias("bucket"))


def _relabelled(label: DataFrame, likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``label`` (rep, comp, rest) with the components that the links among the likely pairs join."""
    merged = staged(components(_links(likely, sets, percent)), "merged", narrow=True).select(F.col("node").alias("comp"), "component")
    return staged(label.join(merged, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"), "rest"), "labels", narrow=True)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Full shingle sets of the class representatives (several if an id has several texts)."""
    return staged(docs.select("doc_id", "text").mapInArrow(giving_back(_sets(k)), "rep long, hashes binary")
                  .where("octet_length(hashes) > 0"), "sets")


def _labelled(rows: DataFrame, reps: DataFrame, label: DataFrame | None) -> DataFrame:
    classes = reps.select("set_key", "rep")
    if label is None:
        classes = classes.withColumn("comp", F.col("rep"))
    else:
        classes = classes.join(label.select("rep", "comp"), "rep", "left")
    by_class = classes.select("set_key", F.coalesce("comp", "rep").alias("c"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      (F.col("doc_id").eqNullSafe(cid)).alias("kept"))
