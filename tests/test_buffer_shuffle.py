"""A rolling shuffle buffer over a stream (L4), held to a sequential model across micro-batches and restarts."""

import hashlib

import pytest

from test_stream_restart import put, stream
from tokenloom.streaming import encode as S

SEED = 7


def model(n, size):
    """Keys 0 .. n - 1 in the order in which a buffer filled, replaced and emptied one row at a time gives them away."""
    def md5(i):
        return hashlib.md5(f"{SEED}:{i}".encode()).hexdigest()
    held, out = [], []
    for i in range(n):
        if len(held) < size:
            held.append(i)
        else:
            at = int(md5(i)[:8], 16) % size
            out.append(held[at])
            held[at] = i
    return out + sorted(held, key=lambda i: (md5(i), i))


def run(spark, base, size, numbered):
    S.run_buffer_shuffle(stream(spark, f"{base}/in", numbered), f"{base}/out", f"{base}/ckpt", f"{base}/carry", size, SEED)


def result(spark, base):
    rows = spark.read.schema("k bigint, rank bigint").parquet(f"{base}/out").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(len(rows)))
    return [r.k for r in rows]


@pytest.mark.parametrize("numbered", [False, True])
@pytest.mark.parametrize("size", [1, 6, 100])
def test_equals_the_sequential_buffer(spark, tmp_path, numbered, size):
    base = str(tmp_path)
    for i, (lo, hi) in enumerate([(0, 7), (7, 8), (8, 40)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)
    run(spark, base, size, numbered)
    got = result(spark, base)
    assert got == model(40, size) and (size == 1) == (got == list(range(40)))


@pytest.mark.parametrize("numbered", [False, True])
def test_stop_before_the_end_and_later_files(spark, tmp_path, monkeypatch, numbered):
    base, end = str(tmp_path), S.end_stream
    for i, (lo, hi) in enumerate([(0, 9), (9, 21)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)

    def stop(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(S, "end_stream", stop)
    with pytest.raises(KeyboardInterrupt):
        run(spark, base, 5, numbered)
    assert result(spark, base) == model(21, 5)[:16]
    monkeypatch.setattr(S, "end_stream", end)
    run(spark, base, 5, numbered)
    assert result(spark, base) == model(21, 5)
    put(spark, f"{base}/in", 2, 21, 33, 1_000_010)      # the buffer goes on with later files
    run(spark, base, 5, numbered)
    assert result(spark, base) == model(33, 5)


@pytest.mark.parametrize("fail_at", [0, 1, 2])
def test_a_failed_micro_batch_is_done_again(spark, tmp_path, monkeypatch, fail_at):
    base, write, calls = str(tmp_path), S.Carried.write, []
    for i, (lo, hi) in enumerate([(0, 9), (9, 11), (11, 30)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)

    def failing(self, rows, batch_id):
        held = write(self, rows, batch_id)
        calls.append(1)
        if len(calls) == fail_at + 1:                   # after the rows are carried, before any goes out
            raise RuntimeError("lost")
        return held
    monkeypatch.setattr(S.Carried, "write", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, base, 4, True)
    run(spark, base, 4, True)
    assert result(spark, base) == model(30, 4)


def test_rows_that_come_early_wait(spark, tmp_path):
    base = str(tmp_path)
    for i, (lo, hi) in enumerate([(12, 20), (0, 5), (8, 12), (5, 8)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)
    run(spark, base, 3, False)
    assert result(spark, base) == model(20, 3)


def test_a_missing_row_is_an_error(spark, tmp_path):
    base = str(tmp_path)
    for i, (lo, hi) in enumerate([(0, 5), (6, 9)]):
        put(spark, f"{base}/in", i, lo, hi, 1_000_000 + i)
    with pytest.raises(ValueError, match="without row 5"):
        run(spark, base, 3, False)
    put(spark, f"{base}/in", 2, 5, 6, 1_000_010)
    run(spark, base, 3, False)
    assert result(spark, base) == model(9, 3)


def test_no_rows_and_bad_size(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/in", 0, 0, 0, 1_000_000)
    run(spark, base, 3, True)
    assert result(spark, base) == []
    with pytest.raises(ValueError):
        run(spark, base, 0, True)
