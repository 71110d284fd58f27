"""Splits, shuffles and mixing."""

import hashlib

from pyspark.sql import functions as F

from tokenloom.operators.mix import interleave_over, interleave_probs, interleave_under
from tokenloom.operators.split import eval_size, seeded_rank, split_exact


def test_eval_size():
    assert eval_size(10, 3) == 3
    assert eval_size(10, 0.25) == 3
    assert eval_size(10, 0) == 0
    assert eval_size(10, 1) == 1


def test_split_exact_disjoint_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = split_exact(df, "k", 0.1, seed=3)
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"eval": 100, "train": 900}
    again = split_exact(df.repartition(5), "k", 0.1, seed=3)
    a = {r["k"] for r in out.where("split = 'eval'").collect()}
    b = {r["k"] for r in again.where("split = 'eval'").collect()}
    assert a == b


def test_split_exact_equals_a_sort_at_every_band_size(spark):
    def digest(k):
        return hashlib.md5(f"7:{k}".encode()).hexdigest()
    keys = list(range(2000))
    df = spark.createDataFrame([(k, "x" * (k % 5)) for k in keys], "k long, v string").repartition(3)
    for share in (1, 777, 1999, 0.013):
        want = set(sorted(keys, key=lambda k: (digest(k), k))[:eval_size(len(keys), share)])
        for band in (0, 1, 10_000):
            out = split_exact(df, "k", share, seed=7, band_rows=band)
            assert {r["k"] for r in out.where("split = 'eval'").collect()} == want
    plan = split_exact(df, "k", 777, seed=7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan


def test_split_exact_with_null_and_hot_keys(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(1,)] * 400 + [(i,) for i in range(2, 97)], "k long")

    def sizes(val_size):
        c = {r["split"]: r["count"] for r in split_exact(df, "k", val_size, seed=1, band_rows=8).groupBy("split").count().collect()}
        return c.get("eval", 0), c.get("train", 0)
    assert sizes(495) == (495, 5) and sizes(497) == (495, 5) and sizes(500) == (500, 0) and sizes(0) == (0, 500)
    order = sorted([1] * 400 + list(range(2, 97)), key=lambda k: hashlib.md5(f"1:{k}".encode()).hexdigest())
    at = order.index(1)
    assert sizes(at) == (at, 500 - at)
    assert sizes(at + 200) == (at, 500 - at)      # the hot key is the boundary: its rows stay together
    assert split_exact(df.limit(0), "k", 0.5).collect() == []


def test_seeded_rank_is_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    ranks = sorted(r["rank"] for r in seeded_rank(df, "k", 9).collect())
    assert ranks == list(range(500))


def _ds(spark, letters):
    return spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "k long, v string")


def test_interleave_under_over(spark):
    a, b = _ds(spark, "abc"), _ds(spark, "xy")
    under = [r["v"] for r in interleave_under([a, b], "k").orderBy("position").collect()]
    over = [r["v"] for r in interleave_over([a, b], "k").orderBy("position").collect()]
    assert under == list("axby")
    assert over == list("axbycx")


def _drawn(seed, probs, count):
    import hashlib
    out = []
    for p in range(count):
        u = int(hashlib.md5(f"{seed}:{p}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out.append(next((d for d in range(len(probs) - 1) if u < sum(probs[:d + 1])), len(probs) - 1))
    return out


def test_interleave_probs_ends_with_the_draw_that_exhausts(spark):
    for sizes, probs, seed in (((4, 60), [0.2, 0.8], 3), ((4, 60), [0.2, 0.8], 5), ((8, 8), [0.5, 0.5], 1), ((1, 3), [0.9, 0.1], 2)):
        sets = [spark.createDataFrame([(i, f"{d}-{i}") for i in range(n)], "k long, v string") for d, n in enumerate(sizes)]
        draws = _drawn(seed, probs, 2000)
        ends = [[i for i, d in enumerate(draws) if d == k][n - 1] for k, n in enumerate(sizes)]
        for until, stop in (("first", min(ends)), ("all", max(ends))):
            used, want = [0] * len(sizes), []
            for d in draws[:stop + 1]:
                want.append(f"{d}-{used[d] % sizes[d]}")
                used[d] += 1
            got = interleave_probs(sets, "k", probs, seed=seed, until=until, chunk=16).orderBy("position").collect()
            assert [r["v"] for r in got] == want and [r["position"] for r in got] == list(range(stop + 1))


def test_interleave_probs_by_hand(spark):
    """Draws of seed 3 with shares 0.5 / 0.5, worked out from md5 once and written here."""
    draws = _drawn(3, [0.5, 0.5], 8)
    a, b = _ds(spark, "ab"), _ds(spark, "wxyz")
    out = interleave_probs([a, b], "k", [0.5, 0.5], seed=3).orderBy("position").collect()
    cut = min([i for i, d in enumerate(draws) if d == 0][1:2] + [i for i, d in enumerate(draws) if d == 1][3:4])
    assert [r["ds"] for r in out] == draws[:cut + 1]


def test_interleave_probs_arguments(spark):
    import pytest
    a, b = _ds(spark, "ab"), _ds(spark, "")
    for probs in ([1.0], [0.5, 0.5, 0.5], [1.0, 0.0]):
        with pytest.raises(ValueError):
            interleave_probs([a, b], "k", probs)
    assert interleave_probs([a, b], "k", [0.5, 0.5]).collect() == []


def test_concat_on_ingest_ordinal(spark):
    from tokenloom.operators.mix import concat
    a = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal long, v string")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "ordinal long, v string")
    out = concat([a, b], "ordinal", ["A", "B"], ["s", "t"]).orderBy("position").collect()
    assert [(r["position"], r["v"], r["dataset"], r["system"]) for r in out] == [
        (0, "a", "A", "s"), (1, "b", "A", "s"), (2, "x", "B", "t"), (3, "y", "B", "t"), (4, "z", "B", "t")]


def test_interleave_over_chunked_equal(spark):
    a, b = _ds(spark, "abcdefghijklmnopqrstuvwxyz" * 4), _ds(spark, "xy")
    plain = [(r["position"], r["v"]) for r in interleave_over([a, b], "k").collect()]
    chunked = [(r["position"], r["v"]) for r in interleave_over([a, b], "k", chunk=3).collect()]
    assert sorted(plain) == sorted(chunked)
    assert len(plain) == 2 * 104
