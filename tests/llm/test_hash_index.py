import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import hash_index as H

SCHEMA = "vec_id long, embedding array<float>, key string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in rows], SCHEMA)


def exact(rows, k, every):
    ok = {i: np.array(np.float32(v), np.float64) for i, v in rows if v is not None and len(v) and None not in v
          and np.isfinite(np.float32(v)).all() and np.any(v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            d = sorted((float(np.sqrt(((ok[i] - x) ** 2).sum())), i) for i in ok if i != q)[:k]
            out[q] = [(i, s) for s, i in d]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x[700:730] = x[700]                                   # a group of equal vectors
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(H, "BLOCK", 400)
    monkeypatch.setattr(H, "QUERIES", 8)
    got, want = result(H.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), exact(rows, 10, 50)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        for i, s in found:
            d = np.array(np.float32(x[i]), np.float64) - np.array(np.float32(x[q]), np.float64)
            assert s == float(np.sqrt((d ** 2).sum()))
    assert [i for i, _ in got[700]] == list(range(701, 711))   # ties: smaller ids first


def test_radius_retrieves_every_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, H.PARTS)).astype(np.uint8)
    index = H.BlockIndex(codes)
    for r in (0, 5, 16, 25, 33, 64):
        q = codes[3] ^ rng.integers(0, 4, H.PARTS).astype(np.uint8)
        far = np.unpackbits(codes ^ q, axis=1).sum(axis=1)
        assert index.within(q, r).tolist() == np.flatnonzero(far <= r).tolist()


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (50, None), (100, []), (150, [0, 0]), (200, [None, 1]), (250, [float("nan"), 1]),
            (300, [float("inf"), 1]), (1, [1, 0]), (2, [0, 2]), (None, [1, 1]), (350, [3, 4, 5])]
    assert result(H.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)) == {0: [(1, 0.0), (2, float(np.sqrt(5.0)))]}
    assert H.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert H.nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
