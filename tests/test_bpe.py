"""Byte-pair merges against a plain sequential Python BPE (the P-check of A3 / K2 / J5)."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from tokenloom.operators import merge_blocks
from tokenloom.operators.bpe import WORD_MARK, _encoder, bpe_vocabulary, decompose, encode_bpe, train_bpe, word_table
from tokenloom.operators.merge_plan import Known, Round
from tokenloom.operators.vocab import word_counts

DIGIT = re.compile("[0-9]")


def sequential_bpe(counts: dict, n: int) -> list:
    words = {tuple(WORD_MARK + w): c for w, c in counts.items()}
    merges = []
    for _ in range(n):
        pc = Counter()
        for syms, c in words.items():
            for a, b in zip(syms, syms[1:]):
                if not (DIGIT.search(a) or DIGIT.search(b)):
                    pc[(a, b)] += c
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        merges.append((a, b, c))
        nxt = {}
        for syms, cc in words.items():
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            nxt[tuple(out)] = nxt.get(tuple(out), 0) + cc
        words = nxt
    return merges


@pytest.mark.parametrize("hot,merges", [(200_000, 300), (400, 80)])
def test_batched_merges_equal_sequential(spark, hot, merges):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 60")
    wc = word_counts(docs, "text")
    sizes = []
    got = train_bpe(word_table(wc), merges, hot=hot, checkpoint_every=3, log=lambda r, batch, m: sizes.append(batch))
    assert got == sequential_bpe({r["token"]: r["count"] for r in wc.collect()}, merges)
    assert max(sizes) > 1


def test_special_characters_and_ties(spark):
    counts = spark.createDataFrame(
        [("a$b", 5), ("a$b\\", 5), ("x.y", 4), ("(()", 3), ("aaaa", 2), ("[a]", 2), ("12ab", 7)],
        "token string, count long")
    got = train_bpe(word_table(counts), 30, hot=6)
    assert got == sequential_bpe({r["token"]: r["count"] for r in counts.collect()}, 30)
    assert train_bpe(word_table(counts.where("false")), 5) == []


def local_bpe(counts: dict, n: int, hot: int, block_words: int) -> tuple[list, int]:
    """The rounds of ``train_bpe`` over blocks held here: (merges, rounds)."""
    words = [(list(WORD_MARK + w), c) for w, c in counts.items()]
    names = sorted({s for w, _ in words for s in w})
    numbers = {s: i for i, s in enumerate(names)}
    plain = lambda: np.array([not DIGIT.search(s) for s in names], bool)
    blocks = [merge_blocks.Block(np.array([c for _, c in part]), np.array([numbers[s] for w, _ in part for s in w]),
                                 np.array([len(w) for w, _ in part]), plain())
              for part in (words[i:i + block_words] for i in range(0, len(words), block_words))]
    known, merges, rounds, fresh = Known(names), [], 0, False

    def recount():
        total = Counter()
        for blk in blocks:
            total.update(dict(zip(*(x.tolist() for x in blk.counts(plain())))))
        rows = sorted(((k, v) for k, v in total.items() if v > 0), key=lambda r: (-r[1], r[0]))[:hot]
        known.load(rows, rows[-1][1] + 1 if len(rows) == hot else 1)
    recount()
    while len(merges) < n:
        batch, again = Round(known, numbers).plan(n - len(merges))
        if not batch and not fresh and known.floor > 1:
            recount()
            fresh = True
            continue
        if not batch and known.floor > 1:
            total = Counter()
            for blk in blocks:
                total.update(dict(zip(*(x.tolist() for x in blk.counts(plain())))))
            pairs = [(-v, names[k[0]], names[k[1]], k) for k, v in ((merge_blocks.split_key(k), v) for k, v in total.items()) if len(k) == 2]
            if pairs:
                n_, a_, b_, (x, y) = min(pairs)
                batch, again = [(x, y, numbers.setdefault(a_ + b_, len(names)), -n_)], a_ + b_ in names
        if not batch:
            break
        fresh, base = False, len(names)
        for a, b, new, c in batch:
            merges.append((names[a], names[b], c))
            if new == len(names):
                names.append(names[a] + names[b])
        rounds += 1
        watched, total = set(known.keys()), Counter()
        for blk in blocks:
            for k, v in zip(*(x.tolist() for x in blk.apply([m[:3] for m in batch], plain()))):
                if k in watched or max(merge_blocks.split_key(k)) >= base:
                    total[k] += v
        if again:
            recount()
        else:
            known.change([(k, v) for k, v in total.items() if v and (k in watched or v >= known.floor)])
            if len(known) > 2 * hot:
                known.trim(hot)
    return merges, rounds


@pytest.mark.parametrize("seed", range(40))
def test_rounds_equal_sequential_on_repetitive_words(seed):
    """Few letters make overlaps of every kind: runs of one letter, a b a b, results that come up twice."""
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abc" if seed % 3 == 1 else "abcde1"
    counts = Counter("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.choice([5, 40, 200])))
    counts = {w: c * rng.randint(1, 4) for w, c in counts.items()}
    for hot in (100_000, 30, 4):
        assert local_bpe(counts, 120, hot, 17)[0] == sequential_bpe(counts, 120)


def test_independent_merges_share_a_round():
    merges, rounds = local_bpe({"xy": 9, "zw": 8, "uv": 7, "pq": 6}, 4, 1000, 10)
    assert len(merges) == 4 and rounds == 1


def test_merges_run_left_to_right():
    for word, want in (([0, 0, 0], [5, 0]), ([0, 0, 0, 0], [5, 5]), ([1, 0, 0], [1, 5])):
        sym, _ = merge_blocks.merge_symbols(np.array(word), np.zeros(len(word), int), [(0, 0, 5)])
        assert sym.tolist() == want
    sym, word = merge_blocks.merge_symbols(np.array([0, 0, 0]), np.array([0, 1, 1]), [(0, 0, 5)])
    assert (sym.tolist(), word.tolist()) == ([0, 5], [0, 1])     # never over a border of words


def test_blocks_touch_only_words_that_hold_a_pair():
    plain = np.ones(9, bool)
    blk = merge_blocks.Block(np.array([1, 1, 1]), np.array([0, 1, 2, 3, 0, 1]), np.array([2, 2, 2]), plain)
    assert blk.holders(np.array([merge_blocks.pair_key(0, 1)])).tolist() == [0, 2]
    keys, change = blk.apply([(0, 1, 8)], plain)
    assert dict(zip(keys.tolist(), change.tolist())) == {int(merge_blocks.pair_key(0, 1)): -2}
    assert blk.sym.tolist() == [8, 2, 3, 8] and blk.size.tolist() == [1, 2, 1]


def test_encode_and_decompose(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 20").select("doc_id", "text")
    wc = word_counts(docs, "text")
    merges = train_bpe(word_table(wc), 20)
    vocab = bpe_vocabulary(spark, merges, [WORD_MARK] + [chr(c) for c in range(ord("a"), ord("z") + 1)])
    enc = {r["doc_id"]: r["input_ids"] for r in encode_bpe(docs, "doc_id", "text", merges, vocab).collect()}
    py = _encoder(merges, [(r["id"], r["token"]) for r in vocab.table.collect()])
    for r in docs.collect():
        want = [i for w in r["text"].split() for i in py(w)]
        assert enc[r["doc_id"]] == want
    new = spark.createDataFrame([(100, "the")], "id int, token string")
    got = decompose(new, merges, vocab).collect()[0]["old_ids"]
    full = py("the")
    mark = vocab.ids_of([WORD_MARK])[WORD_MARK]
    assert got == (full[1:] if full[0] == mark else full)


def test_training_stores_one_state_of_the_blocks(spark):
    """Between checkpoints the states of earlier rounds are freed, not kept beside the last one."""
    counts = spark.createDataFrame([("abcab", 9), ("bcabc", 7), ("cabba", 5), ("aabb", 4), ("ccba", 3), ("babac", 2)], "token string, count long")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    stored = []
    train_bpe(word_table(counts), 12, hot=4, checkpoint_every=100,
              log=lambda r, batch, m: stored.append(spark.sparkContext._jsc.getPersistentRDDs().size() - before))
    assert len(stored) >= 4 and max(stored) <= 1
