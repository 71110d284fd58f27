import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import resample as R
from llm_fixtures import docs_of  # noqa: F401

WORDS = ["alpha", "Beta", "gamma", "déjà", "naïve", "Z9", "the", "of", "rare", "中文", "ZÉ"]


def runs(text, most):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent, most, buckets, least, seed=2024):
    """Every row's values by the formulas of the contract, one row at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        for f in runs(text, most)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, most)[1]:
            t[bucket(f)] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * (S + buckets) / ((s[i] + 1.0) * (T + buckets)))) for i in range(buckets)]
    out = []
    for i, text in rows:
        words, fs = runs(text, most)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    rank = {id(x): n + 1 for n, x in enumerate(fit[:percent * len(fit) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("most", [1, 2])
def test_equals_the_formulas(spark, docs_of, most):
    rng = random.Random(most)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\x00.,;!"), (303, "the " * 5000), (None, " ".join(WORDS * 3))]
    target = ["Rare gamma, rare\nalpha", None, "the rare"]
    got = R.resample(docs_of(rows).repartition(5), docs_of(list(enumerate(target))), percent=25, most=most, buckets=97, least_words=20)
    assert key(got.collect()) == key(plain(rows, target, 25, most, 97, 20))


def test_ranks_are_exact_in_many_segments_and_with_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_SEGMENT", 40)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 0, 7, -3, rng.randint(-50, 50)]), "x") for i in range(900)]
    rows += [(5, 0, "again")] * 300 + [(None, 0, "no id")] * 3            # one key holds a third of the rows
    df = spark.createDataFrame(rows, "doc_id long, score long, segment string").repartition(6).drop("segment")
    out, n = R.regular_sample_rank(df, "score", "doc_id")
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert n == len(rows) and [r["rank"] for r in got] == list(range(1, n + 1))
    keys = [(-r.score, math.inf if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)


def test_equal_keys_are_dealt_to_several_segments():
    """A key that fills the table is cut by its places in the runs."""
    n = 1000
    a, b, c = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    cut = np.arange(100, 1000, 100)
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "c"])
    seg = next(R._segments([a[cut], b[cut], c[cut]])(iter([batch]))).column("segment").to_numpy()
    assert np.bincount(seg).tolist() == [100] * 10 and (np.diff(seg) >= 0).all()


def test_empty_tables(spark, docs_of):
    assert R.resample(docs_of([]), docs_of([(1, "a b")])).collect() == []
    rows = [(1, "a b c"), (2, "a")]
    got = R.resample(docs_of(rows), docs_of([]), percent=50, least_words=1).collect()
    assert key(got) == key(plain(rows, [], 50, 1, 10_000, 1))


def test_query_reads_whole_tables(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text")).collect()]
    assert key(E.queries()["op11_resample"](spark, sf).collect()) == key(plain(docs, target, 10, 1, 10_000, 20))
