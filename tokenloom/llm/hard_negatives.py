"""Hard negatives by shared candidate lists of anchor clusters with certified termination.

A row's score for an anchor is the integer inner product of their quantised vectors.  The anchors are dealt into
waves of at most ``WAVE_BYTES`` measured bytes; a wave is broadcast and every row is scanned once for its positives and
once for its negatives, so no vector is shuffled.  Per wave:

1. Its anchors are clustered by direction; a cluster keeps its centroid and the largest angle of a member to it.
2. A task takes its candidates in blocks.  For a cluster the block is sorted once by the angular upper bound
   ``|i| * cos(max(0, angle(i, centroid) - widest member))``; times a member's length it bounds the member's score.
   Every member walks that one list from the front and stops when the bound is below the score that could still
   enter its results: the walk is then certified to miss nothing of the block.  Results found in earlier
   blocks of the task end later walks sooner.
3. The first ``positives`` rows of the anchor's label are merged over the tasks.  Their scores give each positive a
   window ``low * positive <= 100 * negative <= 100 * positive``; a second scan walks for the first ``negatives`` rows of
   another label in every window, and ends at the least window's lower end or when all windows are settled.

On vectors without clusters the bound cannot end a walk early and a wave costs one product with every row; the
results are the same.

Defined results: rows with a null id, label or vector or a null or non-finite component take no part; a shorter vector
counts as padded with zeros; rows that share an id are one candidate, at its highest score, and never a candidate of
the anchor of that id; of several anchor rows with one id the least (label, vector) stands; extra columns are ignored;
a score beyond 64 bits is given as the nearest 64-bit number.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.stage import staged

WAVE_BYTES = 32 << 20     # most bytes of anchors' vectors in one broadcast
BLOCK = 8192              # candidates whose lists are sorted at a time
STRIDE = 512              # steps of a walk between two looks at the bound
MEMBERS = 256             # mean size of a cluster
CHUNK = 1024              # members multiplied with a stride at a time
ROUNDS = 6                # of the clustering
ANGLE_SLACK = 1e-6        # rounding errors of an angle, far below this
_EXACT = float(1 << 53)
_FAR = np.iinfo(np.int64).max


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def prepared(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("vec")) \
        .where("vec_id is not null and label is not null and vec is not null").where(ok)


def _matrix(column, scale: int, dim: int | None = None) -> np.ndarray:
    """Quantised vectors of an Arrow list column as rows of ``dim`` numbers (the longest, if not given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = quantise(column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], scale) if len(column) else np.zeros(0)
    size = np.diff(off)
    dim = int(size.max(initial=0)) if dim is None else dim
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)
    fits = col < dim
    out[row[fits], col[fits]] = flat[fits]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    top = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(a.shape[1], 1)
    if top < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_FAR - 1, _FAR).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of every row: higher scores first, ties to smaller ids, an id once."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), -_FAR, np.int64)
        self.id = np.full((rows, k), _FAR, np.int64)
        self.n = np.zeros(rows, np.int64)

    def kth(self) -> np.ndarray:
        """The score that a new entry has to reach; the least number while a row has room."""
        return np.where(self.n == self.k, self.score[:, -1], -_FAR)

    def add(self, row: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        held = np.arange(self.k)[None, :] < self.n[touched][:, None]
        row = np.concatenate((row, np.repeat(touched, self.n[touched])))
        score = np.concatenate((score, self.score[touched][held]))
        key = np.concatenate((key, self.id[touched][held]))
        order = np.lexsort((-score, key, row))
        row, score, key = row[order], score[order], key[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, score, key = row[first], score[first], key[first]
        order = np.lexsort((key, -score, row))
        row, score, key = row[order], score[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]] = score[keep]
        self.id[row[keep], place[keep]] = key[keep]
        self.n[touched] = np.minimum(np.bincount(np.searchsorted(touched, row), minlength=len(touched)), self.k)


@dataclass
class Wave:
    """Anchors of one broadcast, ordered by cluster."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    length: np.ndarray
    centroids: np.ndarray
    widest: np.ndarray
    edges: np.ndarray
    positive: np.ndarray | None = None        # scores of the positives, per anchor (least number: none)
    low: np.ndarray | None = None             # least score of a negative, per anchor and positive
    walked: list = field(default_factory=list)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> "Wave":
        length = np.linalg.norm(vecs, axis=1)
        unit = vecs / np.where(length > 0, length, 1)[:, None]
        n = max(1, -(-len(ids) // MEMBERS))
        centroids = unit[np.linspace(0, len(ids) - 1, n).astype(np.int64)] if len(ids) else np.zeros((0, vecs.shape[1]))
        home = np.zeros(len(ids), np.int64)
        for _ in range(ROUNDS if len(ids) else 0):
            home = (unit @ centroids.T).argmax(axis=1)
            total = np.zeros_like(centroids)
            np.add.at(total, home, unit)
            size = np.linalg.norm(total, axis=1)
            centroids = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centroids)
        order = np.lexsort((ids, home))
        home = home[order]
        angle = np.arccos(np.clip((unit[order] * centroids[home]).sum(axis=1), -1, 1)) if len(ids) else np.zeros(0)
        widest = np.zeros(len(centroids))
        np.maximum.at(widest, home, np.where(length[order] > 0, angle, 0))   # a zero vector scores 0 whatever the angle
        return cls(ids[order], labels[order], vecs[order], length[order], centroids, widest + ANGLE_SLACK,
                   np.searchsorted(home, np.arange(len(centroids) + 1)))


class PositiveWalk:
    """What the first scan looks for: the best rows of the anchor's label."""

    def __init__(self, wave: Wave, k: int):
        self.wave, self.best = wave, Best(len(wave.ids), k)

    def need(self, who: np.ndarray) -> np.ndarray:
        return self.best.kth()[who]

    def offer(self, who, scores, ids, labels) -> None:
        w = self.wave
        hit = (scores >= self.need(who)[:, None]) & (labels[None, :] == w.labels[who][:, None]) & (ids[None, :] != w.ids[who][:, None])
        r, c = np.nonzero(hit)
        self.best.add(who[r], scores[r, c], ids[c])


class NegativeWalk:
    """What the second scan looks for: per positive, the best rows of another label in its window."""

    def __init__(self, wave: Wave, k: int):
        self.wave, self.slots = wave, wave.positive.shape[1]
        self.best = Best(len(wave.ids) * self.slots, k)

    def _least(self, who: np.ndarray) -> np.ndarray:
        kth = self.best.kth().reshape(-1, self.slots)[who]
        return np.maximum(kth, self.wave.low[who])

    def need(self, who: np.ndarray) -> np.ndarray:
        return self._least(who).min(axis=1)

    def offer(self, who, scores, ids, labels) -> None:
        w = self.wave
        other = (labels[None, :] != w.labels[who][:, None]) & (ids[None, :] != w.ids[who][:, None])
        least = self._least(who)
        for j in range(self.slots):
            r, c = np.nonzero(other & (scores >= least[:, j][:, None]) & (scores <= w.positive[who, j][:, None]))
            self.best.add(who[r] * self.slots + j, scores[r, c], ids[c])


def walk_block(wave: Wave, goal, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> int:
    """Offers every candidate of the block that can enter a member's results; returns the products made."""
    length = np.linalg.norm(vecs, axis=1)
    unit = vecs / np.where(length > 0, length, 1)[:, None]
    angle = np.arccos(np.clip(unit @ wave.centroids.T, -1, 1))
    made = 0
    for c in range(len(wave.centroids)):
        members = np.arange(wave.edges[c], wave.edges[c + 1])
        bound = length * np.cos(np.maximum(0, angle[:, c] - wave.widest[c]))
        shared = np.argsort(-bound, kind="stable")
        for at in range(0, len(members), CHUNK):
            active = members[at:at + CHUNK]
            for lo in range(0, len(shared), STRIDE):
                top = wave.length[active] * bound[shared[lo]]
                active = active[top + 1e-9 * np.abs(top) + 1e-6 >= goal.need(active)]
                if not len(active):
                    break
                part = shared[lo:lo + STRIDE]
                goal.offer(active, products(wave.vecs[active], vecs[part]), ids[part], labels[part])
                made += len(active) * len(part)
    return made


_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _scan(shipped, goal_of, k: int, scale: int):
    """Arrow step: candidates in blocks past a wave; the task's own results at its end."""
    def run(batches):
        wave: Wave = shipped.value
        goal = goal_of(wave, k)
        held: list = []

        def close():
            if held:
                t = pa.Table.from_batches(held)
                walk_block(wave, goal, t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["vec"], scale, wave.vecs.shape[1]))
                held.clear()
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                if sum(x.num_rows for x in held) + part.num_rows > BLOCK:
                    close()
                held.append(part)
        close()
        best = goal.best
        r, c = np.nonzero(np.arange(best.k)[None, :] < best.n[:, None])
        slots = getattr(goal, "slots", 1)
        for lo in range(0, len(r), 100_000):
            rr, cc = r[lo:lo + 100_000], c[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(wave.ids[rr // slots]), pa.array((rr % slots).astype(np.int32)),
                                              pa.array(best.id[rr, cc]), pa.array(best.score[rr, cc])], schema=_FOUND)
    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of every (anchor, slot) with their rank from 1; an id counts once, at its highest score."""
    once = found.groupBy("anchor_id", "slot", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _deal(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with a wave number such that no wave of two or more holds over WAVE_BYTES."""
    cost = F.col("bytes")
    sized = anchors.withColumn("bytes", F.size("vec").cast("long") * 8 + 200)
    total = sized.agg(F.sum(cost)).first()[0] or 0
    waves = max(1, -(-total // WAVE_BYTES))
    while True:
        dealt = sized.withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(waves)))
        if waves == 1:
            return dealt, 1
        worst = dealt.groupBy("wave").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where("n > 1").agg(F.max("b")).first()[0]
        if (worst or 0) <= WAVE_BYTES:
            return dealt, waves
        waves += max(1, waves // 4)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   scale: int = 256, positives: int = 5, negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` are expressions over the rows' own columns.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    use = prepared(rows, id_col, vec_col, label)
    picked = prepared(rows.where(is_anchor), id_col, vec_col, label).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    anchors = staged(picked.select("vec_id", "r.label", "r.vec"), "anchors")
    dealt, waves = _deal(anchors)
    out = None
    for number in range(waves):
        t = dealt.where(F.col("wave") == number).select("vec_id", "label", "vec").toArrow()   # WAVE_BYTES at most
        if not t.num_rows:
            continue
        wave = Wave.of(t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["vec"], scale))
        shipped = sc.broadcast(wave)
        found = use.mapInArrow(_scan(shipped, PositiveWalk, positives, scale), "anchor_id long, slot int, vec_id long, score long")
        first = staged(_first(found, positives).select("anchor_id", F.col("vec_id").alias("positive_id"),
                                                       F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot")), "positives")
        shipped.destroy()
        got = first.select("anchor_id", "slot", "positive_score").toArrow()   # ``positives`` numbers an anchor of the wave
        order = np.argsort(wave.ids)
        at = order[np.searchsorted(wave.ids[order], got["anchor_id"].to_numpy())]
        wave.positive = np.full((len(wave.ids), positives), -_FAR, np.int64)
        wave.positive[at, got["slot"].to_numpy()] = got["positive_score"].to_numpy()
        # a window below zero is empty; -(-a // b) is the ceiling
        wide = wave.positive.astype(object)
        low = -((-low_percent * wide) // 100)
        wave.low = np.where(wave.positive >= 0, low, _FAR).astype(np.int64)
        shipped = sc.broadcast(wave)
        found = use.mapInArrow(_scan(shipped, NegativeWalk, negatives, scale), "anchor_id long, slot int, vec_id long, score long")
        mined = _first(found, negatives).select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"),
                                                F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = staged(first.join(mined, ["anchor_id", "slot"]), "negatives")
        shipped.destroy()
        out = part if out is None else out.unionByName(part)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.select(*columns)
