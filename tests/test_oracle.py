"""Registered queries against their DuckDB oracle on the smallest tables."""

import hashlib
import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SLOW = {"bpe_merges", "encode_bpe", "vocab_decompose"}


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return v
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str, ensure_ascii=False) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


NO_SQL = {"bpe_merges_full", "encode_bpe_full", "pt_pack_bpe_full"}    # held to other queries and brute force below


def test_every_query_has_an_oracle():
    assert set(E.ORACLES) == set(E.QUERIES) - NO_SQL
    assert set(E.oracle_sql()) <= set(E.queries())


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = _plan(df)
    assert not any(f in plan for f in FORBIDDEN), plan
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(rows, df.columns) == _digest(orows, ocols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["batch", "block", "input_ids", "n_tokens"]
    assert df.count() >= 0


def test_full_size_merges_and_their_encoding(spark):
    """The small list (checked by SQL) begins the large one; ids and blocks equal a plain encoder's."""
    from tokenloom.operators.bpe import WORD_MARK, _encoder, bpe_vocabulary
    from tokenloom.plans.queries import FULL_MERGES, _bpe
    merges = [(r["a"], r["b"], r["count"]) for r in E.queries()["bpe_merges_full"](spark, SF_SMALL).orderBy("rank").collect()]
    small = [(r["a"], r["b"], r["count"]) for r in E.queries()["bpe_merges"](spark, SF_SMALL).orderBy("rank").collect()]
    assert len(merges) == FULL_MERGES and merges[:len(small)] == small
    assert all(x[2] >= y[2] for x, y in zip(merges, merges[1:]))
    docs, _, vocab = _bpe(spark, SF_SMALL, n_merges=FULL_MERGES)
    plain = _encoder(merges, [(r["id"], r["token"]) for r in vocab.table.collect()])
    seen = {}
    want = {r["doc_id"]: [i for w in r["text"].split() for i in (seen.get(w) or seen.setdefault(w, plain(w)))]
            for r in docs.where("text is not null and text <> ''").collect()}
    got = {r["doc_id"]: [int(x) for x in r["input_ids"].split()] for r in E.queries()["encode_bpe_full"](spark, SF_SMALL).collect()}
    assert {k: got[k] for k in want} == want
    rows, blocks = [want[k] for k in sorted(want)], {}
    for b in range(0, len(rows), 100):
        flat = [i for ids in rows[b:b + 100] for i in ids]
        blocks |= {(b // 100, n): flat[n * 512:n * 512 + 512] for n in range(len(flat) // 512)}
    packed = E.queries()["pt_pack_bpe_full"](spark, SF_SMALL).collect()
    assert {(r["batch"], r["block"]): [int(x) for x in r["input_ids"].split()] for r in packed} == blocks
