"""Merge learning by segments: few rounds, each of which learns all merges down to a count.

A pair that occurs fewer than ``least`` times can't be merged while merges occur ``least`` times or more: counts of pairs
never rise, and a new pair (x, ab) or (ab, y) occurs at most as often as (x, a) or (b, y) did.  So every word is cut where two
neighbours occur together fewer than ``least`` times, and what is left, runs of two symbols or more, is counted over all words: the
segments.  They hold every place of every pair that matters, so sequential BPE over the distinct segments (:class:`Segments`)
gives the merges of all words until the best count is below ``least``.  The words are then rewritten and the next round begins.

The distinct words of a corpus stay on the executors, in blocks (one row: counts, symbols, symbols per word).  How many symbols
the segments of a ``least`` have is estimated from a share of them, told by a hash; it decides ``least``, not the result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

BITS = 21                        # a pair's key: two symbols of 21 bits
LOW = (1 << BITS) - 1
BLOCK_WORDS = 50_000
BLOCK_SYMBOLS = 1 << 20          # about the symbols of a block, but for its last rows
_ROWS_TOLD = 1_000
_ROWS_AT_ONCE = 100_000
SCHEMA = "cnt binary, sym binary, size binary"
_BLOCK = pa.schema([("cnt", pa.binary()), ("sym", pa.binary()), ("size", pa.binary())])
_FACTOR = 0x9E3779B97F4A7C15     # odd: has an inverse modulo 2^64
_NEVER = np.int64(1) << 62


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << BITS) | right


def _row(cnt: np.ndarray, sym: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    parts = [a.astype(t).tobytes() for a, t in ((cnt, np.int64), (sym, np.int32), (size, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], schema=_BLOCK)


def _blocks(batches):
    """(counts, symbols, symbols per word) of every block."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.int32, np.int32)))


def _in_slices(arrays: list, schema: pa.Schema):
    for lo in range(0, len(arrays[0]), _ROWS_AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo:lo + _ROWS_AT_ONCE]) for a in arrays], schema=schema)


def _neighbours(sym: np.ndarray, size: np.ndarray, plain: np.ndarray):
    """(key of every place and the next one, whether both are in one word and may be merged)."""
    ends = np.cumsum(size)[:-1]
    ok = plain[sym]
    ok = ok[1:] & ok[:-1]
    ok[ends - 1] = False
    return pair_keys(sym[:-1], sym[1:]), ok


def _summed(keys: np.ndarray, weights: np.ndarray):
    """(distinct keys, their sums of weights)."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(weights, start)


def _runs(joined: np.ndarray):
    """(first place, place after the last) of every run of joined neighbours."""
    j = np.zeros(len(joined) + 2, bool)
    j[1:-1] = joined
    return np.flatnonzero(~j[:-1] & j[1:]), np.flatnonzero(j[:-1] & ~j[1:]) + 1


def build(numbers: dict[str, int]):
    """Arrow step: (cnt, syms) rows, symbols joined by a space, to blocks."""
    chars = all(len(s) == 1 for s in numbers)
    number = np.zeros(max(map(ord, numbers), default=0) + 1 if chars else 0, np.int32)
    if chars:
        number[[ord(s) for s in numbers]] = list(numbers.values())

    def block(rows: pa.Table) -> pa.RecordBatch:
        syms = rows.column(1).to_pylist()
        if chars:
            sym = number[np.frombuffer("".join(syms).replace(" ", "").encode("utf-32-le"), np.int32)]
            size = np.array([len(s) // 2 + 1 for s in syms])
        else:
            parts = [s.split(" ") for s in syms]
            sym, size = np.array([numbers[x] for p in parts for x in p]), np.array([len(p) for p in parts])
        return _row(rows.column(0).to_numpy(), sym, size)

    def run(batches):
        held, n, size = [], 0, 0

        def close():
            return block(pa.Table.from_batches(held))
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS_TOLD):
                b = whole.slice(lo, _ROWS_TOLD)
                held.append(b)
                n, size = n + b.num_rows, size + b.column(1).nbytes // 2
                if n >= BLOCK_WORDS or size >= BLOCK_SYMBOLS:
                    yield close()
                    held, n, size = [], 0, 0
        if held:
            yield close()
    return run


COUNTS = "key long, n long"
_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def count(plain: np.ndarray):
    """Arrow step: blocks to the counts of all their pairs."""
    def run(batches):
        for cnt, sym, size in _blocks(batches):
            keys, ok = _neighbours(sym, size, plain)
            yield from _in_slices(list(_summed(keys[ok], np.repeat(cnt, size)[:-1][ok])), _COUNTS)
    return run


def _times(keys: np.ndarray, ok: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often the pair at every place occurs in all words; 0 where it isn't among the (sorted) pairs or not ``ok``."""
    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    return np.where(ok & (pairs[at] == keys), times[at], 0)


SIZES = "level int, segment long, size int"
_SIZES = pa.schema([("level", pa.int32()), ("segment", pa.int64()), ("size", pa.int32())])


def segment_sizes(plain: np.ndarray, known, levels: list[int], bits: int):
    """Arrow step: blocks to (level, hash, symbols) of one in 2^bits of their distinct segments at every level (a least count)."""
    def run(batches):
        pairs, times = known.value
        for _, sym, size in _blocks(batches):
            told = _times(*_neighbours(sym, size, plain), pairs, times)
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(np.full(len(sym), _FACTOR, np.uint64))
                back = np.multiply.accumulate(np.full(len(sym), pow(_FACTOR, -1, 1 << 64), np.uint64))
                each = (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                each = (each ^ (each >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((each ^ (each >> np.uint64(29))) * power, dtype=np.uint64)])
            for level, least in enumerate(levels):
                start, end = _runs(told >= least)
                with np.errstate(over="ignore"):
                    h = (upto[end] - upto[start]) * back[start]
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(30)
                mine = np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0)
                h, first = np.unique(h[mine].view(np.int64), return_index=True)
                n = (end - start)[mine[first]]
                yield from _in_slices([np.full(len(h), level, np.int32), h, n.astype(np.int32)], _SIZES)
    return run


SEGMENTS = "segment binary, n long"
_SEGMENTS = pa.schema([("segment", pa.binary()), ("n", pa.int64())])


def segments(plain: np.ndarray, known, least: int):
    """Arrow step: blocks to their distinct segments (symbols of 4 bytes) and how often these occur."""
    def run(batches):
        pairs, times = known.value
        for cnt, sym, size in _blocks(batches):
            start, end = _runs(_times(*_neighbours(sym, size, plain), pairs, times) >= least)
            if not len(start):
                continue
            n = (end - start).astype(np.int64)
            place = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
            ends = np.zeros(len(n) + 1, np.int64)
            np.cumsum(4 * n, out=ends[1:])
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sym[place].tobytes())])
            found = pa.table({"segment": found, "n": np.repeat(cnt, size)[start]}).group_by("segment").aggregate([("n", "sum")])
            yield from found.rename_columns({"n_sum": "n"}).select(["segment", "n"]).cast(_SEGMENTS).to_batches(max_chunksize=_ROWS_AT_ONCE)
    return run


def _apart(at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Places without overlap: of places that follow each other, every second one from the first."""
    first = np.concatenate([[True], ~follows])
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def merge_words(sym: np.ndarray, size: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, new: np.ndarray):
    """(symbols, symbols per word) past the merges: every word takes its pair of least rank, again and again.

    ``pairs`` are sorted; ``ranks`` and ``new`` (the results) belong to them.  As no merge makes a pair of lower rank than its own,
    this equals merging pair by pair in rank order.
    """
    if not len(sym) or not len(pairs):
        return sym, size
    word = np.repeat(np.arange(len(size)), size)

    def found(at: np.ndarray) -> np.ndarray:
        """Which pair stands at each place (that isn't the last one), -1 for none."""
        keys = pair_keys(sym[at], sym[at + 1])
        i = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        return np.where((pairs[i] == keys) & (word[at] == word[at + 1]), i, -1).astype(np.int32)
    pair = np.append(found(np.arange(len(sym) - 1)), np.int32(-1))
    sym, done = sym.copy(), []
    while True:
        place = np.flatnonzero(pair >= 0)
        if not len(place):
            done.append((sym, word))
            break
        rank, owner = ranks[pair[place]], word[place]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(rank, begins)
        place = place[rank == np.repeat(least, np.diff(np.append(begins, len(owner))))]
        place = _apart(place, place[1:] == place[:-1] + 1)
        live = np.zeros(len(size), bool)
        live[owner[begins]] = True
        live = live[word]
        done.append((sym[~live], word[~live]))
        sym[place] = new[pair[place]]
        live[place + 1] = False
        sym, word, pair = sym[live], word[live], pair[live]
        place = np.cumsum(live)[place] - 1
        pair[place] = -1
        near = np.concatenate([place - 1, place])
        near = near[(near >= 0) & (near < len(sym) - 1)]
        pair[near] = found(near)
    sym, word = (np.concatenate([d[i] for d in done]) for i in (0, 1))
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(size)).astype(np.int32)


def ranked(batch: list[tuple[int, int, int]]):
    """Merges (a, b, new) in rank order as the arrays that :func:`merge_words` takes."""
    a, b, new = (np.array(x, np.int64) for x in zip(*batch))
    pairs = pair_keys(a, b)
    order = np.argsort(pairs)
    return pairs[order], order, new[order].astype(np.int32)


def rewrite(batches_of_merges: list):
    """Arrow step: blocks past lists of merges (a, b, new), one list after the other."""
    lists = [ranked(batch) for batch in batches_of_merges if batch]

    def run(batches):
        for cnt, sym, size in _blocks(batches):
            for one in lists:
                sym, size = merge_words(sym, size, *one)
            long = size > 1                      # a word of one symbol has no pair any more
            if long.any():
                yield _row(cnt[long], sym[np.repeat(long, size)], size[long])
    return run


class Segments:
    """Sequential BPE over counted segments: symbols in a linked list, an index from a pair to its places."""

    def __init__(self, sym: np.ndarray, size: np.ndarray, cnt: np.ndarray, names: list[str], numbers: dict[str, int]):
        n = len(sym)
        self.sym, self.names, self.numbers = sym.astype(np.int32), names, numbers
        self.weight = np.repeat(cnt.astype(np.int64), size)
        self.before, self.after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        ends = np.cumsum(size)
        self.before[ends - size], self.after[ends - 1] = -1, -1
        self.count: dict[int, int] = {}
        self.places: dict[int, np.ndarray] = {}
        self.heap: list = []

    def _entry(self, key: int, n: int):
        return (-n, self.names[key >> BITS], self.names[key & LOW], key)

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return pair_keys(self.sym[at], self.sym[self.after[at]])

    def _paired(self, at: np.ndarray) -> np.ndarray:
        """The distinct places among ``at`` that have a next one."""
        at = np.unique(at[at >= 0])
        return at[self.after[at] >= 0]

    def _index(self, at: np.ndarray, least: int):
        """Counts and places of pairs that weren't there before; their heap entries."""
        keys = self._keys(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        if not len(keys):
            return
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(self.weight[at], start).tolist()
        borders = [*start.tolist(), len(keys)]
        for key, n, lo, hi in zip(keys[start].tolist(), total, borders, borders[1:]):
            if n >= least:                       # counts never rise: what is below the least count stays there
                self.count[key], self.places[key] = n, at[lo:hi]
                yield self._entry(key, n)

    def learn(self, least: int, limit: int) -> tuple[list[tuple[int, int, int, int]], bool]:
        """(merges (a, b, number of the result, count) in order, whether the last result was a symbol before).

        All merges that occur ``least`` times or more, ``limit`` at most; a result that was a symbol before ends them.
        """
        self.heap = list(self._index(self._paired(np.arange(len(self.sym), dtype=np.int32)), least))
        heapq.heapify(self.heap)
        merges: list[tuple[int, int, int, int]] = []
        while self.heap and len(merges) < limit:
            n, _, _, key = heapq.heappop(self.heap)
            if self.count.get(key) != -n:
                continue
            a, b = key >> BITS, key & LOW
            name = self.names[a] + self.names[b]
            again = name in self.numbers
            new = self.numbers.setdefault(name, len(self.names))
            merges.append((a, b, new, -n))
            if again:
                return merges, True
            self.names.append(name)
            self._merge(key, a, b, new, least)
        return merges, False

    def _merge(self, key: int, a: int, b: int, new: int, least: int) -> None:
        del self.count[key]
        at = self.places.pop(key)
        at = at[(self.sym[at] == a) & (self.after[at] >= 0)]
        at = at[self.sym[self.after[at]] == b]
        if a == b:
            at = _apart(at, self.after[at[:-1]] == at[1:])
        other = self.after[at]
        gone = self._paired(np.concatenate([self.before[at], at, other]))
        lost = _summed(self._keys(gone), self.weight[gone])
        after = self.after[other]
        self.sym[at], self.sym[other] = new, -1
        self.after[at] = after
        self.before[after[after >= 0]] = at[after >= 0]
        for old, n in zip(*(x.tolist() for x in lost)):
            if old in self.count:
                n = self.count[old] - n
                if n >= least:
                    self.count[old] = n
                    heapq.heappush(self.heap, self._entry(old, n))
                else:
                    del self.count[old], self.places[old]
        for entry in self._index(self._paired(np.concatenate([self.before[at], at])), least):
            heapq.heappush(self.heap, entry)
