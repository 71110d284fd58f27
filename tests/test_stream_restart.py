"""Streamed batches that survive a stop at any place (X2, L4), and rows numbered inside the stream."""

import os

import pytest
from pyspark.sql import functions as F

from tokenloom.streaming import encode as S

ROWS = 10


def put(spark, path, part, lo, hi, mtime):
    """One file of rows lo .. hi - 1, dated so that files arrive in order."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(path, exist_ok=True)
    f = f"{path}/part-{part}.parquet"
    pq.write_table(pa.table({"k": pa.array(range(lo, hi), pa.int64()), "ordinal": pa.array(range(lo, hi), pa.int64())}), f)
    os.utime(f, (mtime, mtime))


def stream(spark, path, numbered=False):
    s = S.read_stream(spark, path, "k bigint, ordinal bigint")
    return S.with_stream_ordinal(s.select("k")) if numbered else s


def note(rows):
    return rows.groupBy("batch").agg(F.sort_array(F.collect_list("k")).alias("ks"))


def result(spark, base):
    rows = spark.read.schema("batch bigint, ks array<bigint>").parquet(f"{base}/out").collect()
    assert len({r.batch for r in rows}) == len(rows)
    return {r.batch: r.ks for r in rows}


def want(n):
    return {b: list(range(b * ROWS, min(n, (b + 1) * ROWS))) for b in range(-(-n // ROWS))}


def run(spark, base, fn=note, numbered=False):
    S.run_row_batches(stream(spark, f"{base}/in", numbered), fn, f"{base}/out", f"{base}/ckpt", f"{base}/carry", ROWS)


@pytest.mark.parametrize("numbered", [False, True])
def test_rows_of_the_open_batch_come_after_a_stop_before_the_end(spark, tmp_path, monkeypatch, numbered):
    base = str(tmp_path)
    for i, (lo, hi) in enumerate([(0, 7), (7, 18), (18, 25)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)
    end = S.end_stream

    def stop(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(S, "end_stream", stop)
    with pytest.raises(KeyboardInterrupt):
        run(spark, base, numbered=numbered)
    assert result(spark, base) == {k: v for k, v in want(25).items() if k < 2}
    monkeypatch.setattr(S, "end_stream", end)
    run(spark, base, numbered=numbered)                # no file is new: the stream runs no micro-batch
    assert result(spark, base) == want(25)
    run(spark, base, numbered=numbered)
    assert result(spark, base) == want(25)
    put(spark, f"{base}/in", 3, 25, 33, 1_000_010)     # later files go on with the open batch
    run(spark, base, numbered=numbered)
    assert result(spark, base) == want(33)


@pytest.mark.parametrize("fail_at", [0, 1, 2])
@pytest.mark.parametrize("numbered", [False, True])
def test_a_failed_micro_batch_is_done_again(spark, tmp_path, fail_at, numbered):
    base = str(tmp_path)
    for i, (lo, hi) in enumerate([(0, 12), (12, 15), (15, 29)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)
    calls = []

    def failing(rows):
        calls.append(1)
        if len(calls) == fail_at + 1:
            raise RuntimeError("lost")
        return note(rows)
    with pytest.raises(Exception, match="lost"):
        run(spark, base, failing, numbered)
    run(spark, base, numbered=numbered)
    assert result(spark, base) == want(29)


def test_stream_numbers_rows_by_file_and_place(spark, tmp_path):
    """Registry order of a text stream: no ordinal column, no batch pass before the stream."""
    base = str(tmp_path)
    os.makedirs(f"{base}/in")
    lines = [f"line {i}" if i % 7 else "" for i in range(40)]
    for i in range(4):
        with open(f"{base}/in/{3 - i}.txt", "w") as f:      # names against the order of arrival
            f.write("\n".join(lines[10 * i:10 * i + 10]) + "\n")
        os.utime(f"{base}/in/{3 - i}.txt", (1_000_000 + i,) * 2)
    s = S.stream_filter(S.with_stream_ordinal(S.read_stream(spark, f"{base}/in", "value string", "text").withColumnRenamed("value", "prompt")))
    S.run_row_batches(s, lambda r: S.split_head_stream(r, 5).select("ordinal", "prompt", "batch", "split"),
                      f"{base}/out", f"{base}/ckpt", f"{base}/carry", 8)
    got = spark.read.schema("ordinal bigint, prompt string, batch bigint, split string").parquet(f"{base}/out").orderBy("ordinal").collect()
    kept = [x for x in lines if x]
    assert [(r.ordinal, r.prompt, r.batch, r.split) for r in got] == \
        [(i, x, i // 8, "eval" if i < 5 else "train") for i, x in enumerate(kept)]
