"""Merge learning by segments and merging many words at once, against sequential BPE and the encoder of one word."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from test_bpe import DIGIT, sequential_bpe
from tokenloom.operators import merge_segments as ms
from tokenloom.operators.bpe import WORD_MARK, _encoder, byte_tokens, train_bpe, word_table
from tokenloom.operators.encode import _in_order, _word_pieces, _words_merger


def learn_in_rounds(counts: dict, n: int, least_of) -> list:
    """The rounds of ``train_bpe`` over two blocks held here; ``least_of`` picks the least count from all counts."""
    names = sorted({s for w in counts for s in WORD_MARK + w})
    numbers = {s: i for i, s in enumerate(names)}
    rows = pa.RecordBatch.from_arrays([pa.array(list(counts.values())), pa.array([" ".join(WORD_MARK + w) for w in counts])], names=["cnt", "syms"])
    blocks = [b for half in (rows.slice(0, 3), rows.slice(3)) if half.num_rows for b in ms.build(numbers)([half])]
    merges = []
    while len(merges) < n and blocks:
        plain = np.array([not DIGIT.search(s) for s in names], bool)
        total, found, size = Counter(), Counter(), set()
        for b in ms.count(plain)(blocks):
            for k, v in zip(*(c.to_pylist() for c in b.columns)):
                total[k] += v
        if not total:
            break
        least = least_of(sorted(total.values(), reverse=True))
        known = SimpleNamespace(value=(np.array(sorted(total)), np.array([total[k] for k in sorted(total)])))
        for b in ms.segments(plain, known, least)(blocks):
            for k, v in zip(*(c.to_pylist() for c in b.columns)):
                found[k] += v
        for b in ms.segment_sizes(plain, known, [least], 0)(blocks):
            size |= set(zip(*(c.to_pylist() for c in b.columns[1:])))
        assert sum(x for _, x in size) == sum(len(s) // 4 for s in found)      # where all are told, the estimate is exact
        learner = ms.Segments(np.frombuffer(b"".join(found), np.int32), np.array([len(s) // 4 for s in found]), np.array(list(found.values())), names, numbers)
        batch, again = learner.learn(least, n - len(merges))
        assert batch and not again
        merges += [(names[a], names[b], c) for a, b, _, c in batch]
        blocks = list(ms.rewrite([[m[:3] for m in batch]])(blocks))
    return merges


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_sequential_at_any_least_count(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abc" if seed % 3 == 1 else "abcde1"
    counts = Counter("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(rng.choice([5, 40, 200])))
    counts = {w: c * rng.randint(1, 4) for w, c in counts.items()}
    want = sequential_bpe(counts, 120)
    for least_of in (lambda c: 1, lambda c: c[0], lambda c: c[min(3, len(c) - 1)], lambda c: c[len(c) // 2]):
        assert learn_in_rounds(counts, 120, least_of) == want
    rows = list(enumerate(byte_tokens() + [a + b for a, b, _ in want] + [WORD_MARK, *"abc"]))
    one, texts = _encoder(want, rows), [*counts, "xéz", "aab😀b"]
    assert _in_order(want)
    ids, size = _words_merger(want, rows)(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(size)[:-1])] == [one(w) for w in texts]


def test_lists_out_of_order_are_encoded_one_word_at_a_time():
    merges = [("ab", "c", 2), ("a", "b", 1)]       # not a learned list: ab is made after it is used
    assert not _in_order(merges)
    rows = list(enumerate([*byte_tokens(), "abc", "ab", "a", "b", "c", WORD_MARK]))
    order, _ = _word_pieces(merges, rows)(pa.array(["abc", "cab"]), None)
    assert [order(0), order(1)] == [_encoder(merges, rows)(w) for w in ("abc", "cab")]


def test_many_merges_take_few_rounds(spark):
    """Before, a round ended with the first count that was only bounded: some 20 merges a round."""
    rng = random.Random(5)
    counts = Counter("".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 9))) for _ in range(3000))
    table = spark.createDataFrame(list(counts.items()), "token string, count long")
    rounds = []
    got = train_bpe(word_table(table), 300, log=lambda r, batch, m: rounds.append(batch))
    assert got == sequential_bpe(counts, 300)
    assert len(rounds) <= 3
