"""Word blocks of merge learning: distinct words as symbol numbers, with an inverted index of their pairs.

The distinct words of a corpus are dealt into blocks; a block is one row with a binary state (numpy arrays).  A block
keeps, besides the symbols of its words, an index from a pair of symbols to the words that held it: sorted
segments of (pair, word), one made at the start and one for every later batch of merges, joined when there are
many.  A batch of merges looks its pairs up, rewrites only the words found and reports how the counts of pairs and of
triples of neighbours changed in them.  Index entries of pairs that have gone stay until segments are joined;
the words found are checked against their symbols.

A key is one number: three symbols of 21 bits, the third all ones for a pair.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

BITS = 21
NONE = (1 << BITS) - 1           # third symbol of a pair's key; symbols are below it
SEGMENTS = 12                    # index segments of a block before they are joined
BLOCK_WORDS = 50_000
_KEYS_AT_ONCE = 100_000
SCHEMA = "block long, state binary, key long, delta long"
_ROWS = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("key", pa.int64()), ("delta", pa.int64())])


def pair_key(a, b):
    return (np.int64(a) << np.int64(2 * BITS)) | (np.int64(b) << np.int64(BITS)) | np.int64(NONE)


def split_key(key: int) -> tuple[int, ...]:
    """(a, b) of a pair's key, (a, b, c) of a triple's."""
    c = key & NONE
    ab = (key >> 2 * BITS, (key >> BITS) & NONE)
    return ab if c == NONE else (*ab, c)


def _keys(sym: np.ndarray, word: np.ndarray, plain: np.ndarray):
    """((pair keys, their words), (triple keys, their words)) of neighbours in one word that may be merged.

    ``plain`` marks the symbols that may be merged.
    """
    s = sym.astype(np.int64)
    ok = plain[sym]
    two = (word[1:] == word[:-1]) & ok[1:] & ok[:-1]
    a = np.flatnonzero(two)
    pairs = (s[a] << (2 * BITS)) | (s[a + 1] << BITS) | NONE
    b = np.flatnonzero(two[1:] & two[:-1])
    triples = (s[b] << (2 * BITS)) | (s[b + 1] << BITS) | s[b + 2]
    return (pairs, word[a]), (triples, word[b])


def _summed(keys: np.ndarray, weights: np.ndarray):
    uniq, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, inverse, weights)
    return uniq, total


def merge_symbols(sym: np.ndarray, word: np.ndarray, batch: list[tuple[int, int, int]]):
    """Every merge (a, b, new) of the batch in turn, left to right without overlap, on all words at once."""
    for a, b, new in batch:
        at = np.flatnonzero((sym[:-1] == a) & (sym[1:] == b) & (word[:-1] == word[1:]))
        if not len(at):
            continue
        if a == b:
            # of places that follow each other, every second one from the first
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        sym = sym.copy()
        sym[at] = new
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    return sym, word


class Block:
    """Words of one block: counts, symbols (flat, with each word's start) and the index segments."""

    def __init__(self, cnt: np.ndarray, sym: np.ndarray, size: np.ndarray, plain: np.ndarray):
        self.cnt, self.sym, self.size = cnt, sym.astype(np.int32), size.astype(np.int32)
        (pairs, word), _ = _keys(self.sym, np.repeat(np.arange(len(cnt)), self.size), plain)
        self.segments = [self._segment(pairs, word)]

    @staticmethod
    def _segment(pairs: np.ndarray, word: np.ndarray):
        order = np.lexsort((word, pairs))
        pairs, word = pairs[order], word[order].astype(np.int32)
        first = np.ones(len(pairs), bool)
        first[1:] = (pairs[1:] != pairs[:-1]) | (word[1:] != word[:-1])
        return pairs[first], word[first]

    def counts(self, plain: np.ndarray):
        """(keys, sums) of all pairs and triples."""
        both = _keys(self.sym, np.repeat(np.arange(len(self.cnt)), self.size), plain)
        return _summed(np.concatenate([k for k, _ in both]), np.concatenate([self.cnt[w] for _, w in both]))

    def holders(self, pairs: np.ndarray) -> np.ndarray:
        """Words that hold, or held, one of the (sorted) pairs."""
        found = []
        for keys, word in self.segments:
            lo, hi = np.searchsorted(keys, pairs, "left"), np.searchsorted(keys, pairs, "right")
            found += [word[i:j] for i, j in zip(lo.tolist(), hi.tolist()) if i < j]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)

    def apply(self, batch: list[tuple[int, int, int]], plain: np.ndarray):
        """Merges the batch in the words that hold one of its pairs; returns (keys, changes of their counts)."""
        at = self.holders(np.unique(np.array([pair_key(a, b) for a, b, _ in batch], np.int64)))
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none
        start = np.cumsum(self.size, dtype=np.int64) - self.size
        size = self.size[at].astype(np.int64)
        place = np.arange(int(size.sum())) + np.repeat(start[at] - (np.cumsum(size) - size), size)
        sym, word = self.sym[place], np.repeat(np.arange(len(at)), size)
        new_sym, new_word = merge_symbols(sym, word, batch)
        new_size = np.bincount(new_word, minlength=len(at))
        changed = np.flatnonzero(new_size != size)
        if not len(changed):
            return none, none
        mark = np.zeros(len(at), bool)
        mark[changed] = True
        old = _keys(sym[mark[word]], word[mark[word]], plain)
        now = _keys(new_sym[mark[new_word]], new_word[mark[new_word]], plain)
        weight = self.cnt[at]
        keys = np.concatenate([k for k, _ in (*old, *now)])
        sums = np.concatenate([-weight[w] for _, w in old] + [weight[w] for _, w in now])
        # the words in place again: the others' symbols as they were, the changed ones' new symbols
        self._replace(at[changed], new_sym[mark[new_word]], new_size[changed])
        pairs, word_of = now[0]
        made = plain_new(pairs, {n for _, _, n in batch})
        self.segments.append(self._segment(pairs[made], at[word_of[made]]))
        if len(self.segments) > SEGMENTS:
            self.segments = [self._segment(np.concatenate([k for k, _ in self.segments]), np.concatenate([w for _, w in self.segments]))]
        keys, total = _summed(keys, sums)
        return keys[total != 0], total[total != 0]

    def _replace(self, words: np.ndarray, sym: np.ndarray, size: np.ndarray) -> None:
        old_size = self.size.copy()
        gone = np.zeros(len(self.cnt), bool)
        gone[words] = True
        self.size[words] = size
        out = np.empty(int(self.size.sum()), np.int32)
        is_new = np.repeat(gone, self.size)
        out[is_new], out[~is_new] = sym, self.sym[~np.repeat(gone, old_size)]
        self.sym = out


def plain_new(pairs: np.ndarray, new: set[int]) -> np.ndarray:
    """Which pairs hold a symbol made by the batch."""
    made = np.array(sorted(new), np.int64)
    return np.isin(pairs >> (2 * BITS), made) | np.isin((pairs >> BITS) & NONE, made)


def _count_rows(keys: np.ndarray, sums: np.ndarray):
    for lo in range(0, len(keys), _KEYS_AT_ONCE):
        k = keys[lo:lo + _KEYS_AT_ONCE]
        n = len(k)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(k),
                                          pa.array(sums[lo:lo + _KEYS_AT_ONCE])], schema=_ROWS)


def _state_row(block: int, state: Block):
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps(state, 5)], pa.binary()),
                                       pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=_ROWS)


def build(numbers: dict[str, int], plain: np.ndarray, block_words: int = BLOCK_WORDS):
    """Arrow step: (cnt, syms) rows, symbols joined by a space, to blocks."""
    def run(batches):
        cnt, syms, n = [], [], 0

        def close():
            size = np.array([len(s) for s in syms], np.int64)
            return _state_row(n, Block(np.array(cnt, np.int64), np.array([x for s in syms for x in s], np.int32), size, plain))
        for b in batches:
            for c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cnt.append(c)
                syms.append([numbers[x] for x in s.split(" ")])
                if len(cnt) >= block_words:
                    yield close()
                    cnt, syms, n = [], [], n + 1
        if cnt:
            yield close()
    return run


def count(plain: np.ndarray):
    """Arrow step: blocks to the counts of all their pairs and triples."""
    def run(batches):
        for b in batches:
            for raw in b.column("state"):
                yield from _count_rows(*pickle.loads(raw.as_py()).counts(plain))
    return run


def step(batch: list[tuple[int, int, int]], plain: np.ndarray, watched):
    """Arrow step: blocks past a batch of merges; changes of the watched keys and of keys with a new symbol."""
    new = {n for _, _, n in batch}
    made = np.array(sorted(new), np.int64)

    def run(batches):
        known = watched.value
        for b in batches:
            for i, raw in enumerate(b.column("state")):
                state: Block = pickle.loads(raw.as_py())
                keys, sums = state.apply(batch, plain)
                yield _state_row(b.column("block")[i].as_py(), state) if len(keys) else b.slice(i, 1)
                if len(keys):
                    third = keys & NONE
                    told = plain_new(keys, new) | np.isin(third, made)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        told |= known[at] == keys
                    yield from _count_rows(keys[told], sums[told])
    return run
