import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score string, slot string, wave string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", "y", "z")
                                  for i, v, y in rows], SCHEMA)


def plain(rows, every, k=5, n=5, low=80):
    """All scores of every anchor, sorted."""
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in sorted(ok, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, y))
    out = set()
    for a, (u, y) in anchors.items():
        def first(rows_, limit):
            best = {}
            for i, s in rows_:
                best[i] = max(s, best.get(i, s))
            return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:limit]
        scores = [(i, sum(p * q for p, q in zip(u, v)), z) for i, v, z in ok if i != a]
        for p, ps in first([(i, s) for i, s, z in scores if z == y], k):
            window = [(i, s) for i, s, z in scores if z != y and low * ps <= 100 * s <= 100 * ps]
            out |= {(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(first(window, n))}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mine(spark, rows, every):
    return result(H.hard_negatives(frame(spark, rows).repartition(4), F.col("vec_id") % every == 0, F.col("label")))


def clustered(rng, n, groups, dim, noise):
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    return [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("noise,block", [(0.05, 64), (1.0, 8192)])
def test_equals_brute_force(spark, monkeypatch, noise, block):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "STRIDE", 16)
    monkeypatch.setattr(H, "MEMBERS", 4)
    rows = clustered(np.random.default_rng(3), 900, 6, 8, noise)
    got = mine(spark, rows, 20)
    assert got and got == plain(rows, 20)


def test_waves_give_the_same(spark, monkeypatch):
    rows = clustered(np.random.default_rng(4), 300, 4, 6, 0.2)
    whole = mine(spark, rows, 10)
    monkeypatch.setattr(H, "WAVE_BYTES", 1500)
    assert mine(spark, rows, 10) == whole == plain(rows, 10)


def test_walks_end_early_on_clusters_and_miss_nothing():
    rng = np.random.default_rng(5)
    rows = clustered(rng, 4000, 40, 16, 0.03)
    ids, vecs = np.arange(4000), H.quantise(np.array([v for _, v, _ in rows]), 256)
    labels = np.array([y for _, _, y in rows])
    wave = H.Wave.of(ids[::100], labels[::100], vecs[::100])
    goal = H.PositiveWalk(wave, 5)
    made = sum(H.walk_block(wave, goal, ids[s], labels[s], vecs[s]) for s in (slice(0, 2000), slice(2000, 4000)))
    assert made < 0.6 * 40 * 4000                            # less than every product
    for a, who in enumerate(wave.ids):
        score = vecs @ vecs[who]
        same = sorted((-s, i) for i, s in enumerate(score) if i != who and labels[i] == labels[who])[:5]
        assert [(-int(s), int(i)) for s, i in zip(goal.best.score[a], goal.best.id[a])] == [(int(s), i) for s, i in same]


def test_ties_repeats_and_odd_rows(spark):
    same = [1.0, 0.5]
    rows = [(i, same, i % 2) for i in range(0, 40)]           # all equal: ids decide
    rows += [(3, same, 1), (3, [1.0, 0.4], 1), (0, same, 0), (0, same, 1)]
    rows += [(50, None, 1), (51, [None, 1.0], 1), (52, [float("nan"), 1.0], 0), (53, [float("inf"), 1.0], 0), (54, same, None),
             (None, same, 1), (60, [], 0), (61, [0.0, 0.0], 0), (62, [1.0], 0), (63, [1.0, 0.5, 9.0], 1), (70, [-1.0, -1.0], 0)]
    got = mine(spark, rows, 10)
    assert got == plain(rows, 10)
    assert {a for a, *_ in got} >= {0, 10, 20, 30}
    assert mine(spark, [], 10) == set() and mine(spark, [(0, same, 1)], 10) == set() and mine(spark, rows[1:9], 10) == set()


def test_large_components_stay_exact():
    a = np.array([[2.0 ** 40, 1.0, 3.0]])
    b = np.array([[2.0 ** 20, 1.0, 5.0], [2.0 ** 60, 2.0 ** 60, 0.0]])
    assert H.products(a, b).tolist() == [[2 ** 60 + 16, 2 ** 63 - 1]]


def test_query_equals_brute_force(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(E.queries()["op12_hard_negatives"](spark, sf)) == plain(rows, 100)
