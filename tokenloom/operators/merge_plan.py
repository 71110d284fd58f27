"""Which merges can be learned in one round: an exact look ahead over the most frequent pairs.

Sequential BPE takes the most frequent pair (ties: left, then right symbol), merges it everywhere, recounts, and so on.
One merge (a, b) -> n changes few counts: pairs (x, a) and (b, y) lose the places where the pair stood beside them, and
pairs (x, n), (n, y) appear.  Both follow from the counts of triples, (x, a, b) and (a, b, y), so the merges that
come next can be told without recounting as long as these triples are known and no earlier merge of the round has
touched them.  Where they are not, a count is only bounded; the round ends when such a bound could come first.

The driver holds the pairs and triples of at least ``floor`` occurrences, a bounded list (see ``bpe.train_bpe``).
"""

from __future__ import annotations

import heapq

from .merge_blocks import NONE, split_key

_NO: dict = {}


class Known:
    """Exact counts of all pairs and triples that occur ``floor`` times or more."""

    def __init__(self, names: list[str]):
        self.names = names
        self.load([], 1)

    def load(self, rows: list[tuple[int, int]], floor: int) -> None:
        """Replaces everything by rows (key, count)."""
        self.floor = floor
        self.pair: dict[tuple[int, int], int] = {}
        self.triple: dict[tuple[int, int, int], int] = {}
        self.first: dict[int, set[int]] = {}      # a -> every b of a known pair (a, b)
        self.second: dict[int, set[int]] = {}     # b -> every a
        self.heap: list = []
        for key, n in rows:
            self._set(split_key(key), n)
        heapq.heapify(self.heap)

    def __len__(self) -> int:
        return len(self.pair) + len(self.triple)

    def entry(self, p: tuple[int, int], n: int):
        return (-n, self.names[p[0]], self.names[p[1]], p)

    def _set(self, key: tuple, n: int) -> None:
        table = self.pair if len(key) == 2 else self.triple
        if n >= self.floor:
            table[key] = n
            if len(key) == 2:
                self.first.setdefault(key[0], set()).add(key[1])
                self.second.setdefault(key[1], set()).add(key[0])
                self.heap.append(self.entry(key, n))
        elif table.pop(key, None) is not None and len(key) == 2:
            self.first[key[0]].discard(key[1])
            self.second[key[1]].discard(key[0])

    def change(self, rows: list[tuple[int, int]]) -> None:
        """Adds changes (key, delta); a key that is not known starts at 0."""
        at = len(self.heap)
        for key, delta in rows:
            parts = split_key(key)
            table = self.pair if len(parts) == 2 else self.triple
            self._set(parts, table.get(parts, 0) + delta)
        new = self.heap[at:]
        del self.heap[at:]
        for e in new:
            heapq.heappush(self.heap, e)

    def trim(self, most: int) -> None:
        """Raises the floor until at most about ``most`` keys are left."""
        counts = sorted((*self.pair.values(), *self.triple.values()), reverse=True)
        if len(counts) > most:
            self.floor = max(self.floor, counts[most] + 1)
            for table in (self.pair, self.triple):
                for key in [k for k, n in table.items() if n < self.floor]:
                    self._set(key, 0)
            self.heap = [self.entry(p, n) for p, n in self.pair.items()]
            heapq.heapify(self.heap)

    def keys(self) -> list[int]:
        """All known keys, sorted."""
        return sorted([(a << 42) | (b << 21) | NONE for a, b in self.pair] + [(a << 42) | (b << 21) | c for a, b, c in self.triple])


class Round:
    """One round's look ahead; nothing in ``known`` changes but its heap, which loses stale entries."""

    def __init__(self, known: Known, numbers: dict[str, int]):
        self.known, self.numbers = known, numbers
        self.base = len(known.names)
        self.names = list(known.names)
        self.now: dict[tuple[int, int], tuple[int, bool]] = {}     # changed pairs: (count or bound, exact)
        self.first: dict[int, set[int]] = {}
        self.second: dict[int, set[int]] = {}
        self.heap: list = []
        self.aside: list = []
        self.lefts: set[int] = set()
        self.rights: set[int] = set()
        self.merged: set[tuple[int, int]] = set()

    def _count(self, p) -> tuple[int, bool]:
        return self.now[p] if p in self.now else (self.known.pair.get(p, 0), True)

    def _put(self, p, n: int, exact: bool) -> None:
        if p in self.merged:
            return
        self.now[p] = (n, exact)
        self.first.setdefault(p[0], set()).add(p[1])
        self.second.setdefault(p[1], set()).add(p[0])
        if n >= self.known.floor:
            # a bound comes before exact counts of the same size
            heapq.heappush(self.heap, (-n, exact, self.names[p[0]], self.names[p[1]], p))

    def _triple(self, x: int, y: int, z: int) -> tuple[int, bool]:
        """(count or bound, exact) of three neighbours."""
        if (x, y) in self.merged or (y, z) in self.merged:
            return 0, True
        bound = min(self._count((x, y))[0], self._count((y, z))[0])
        if max(x, y, z) >= self.base:
            return bound, False
        told = self.known.triple.get((x, y, z))
        if told is None:
            return min(bound, self.known.floor - 1), self.known.floor <= 1
        return min(told, bound), x not in self.rights and z not in self.lefts

    def _best(self):
        """The entry that comes first: (pair, count, exact), or None."""
        heap, known = self.heap, self.known.heap
        while heap and self.now.get(heap[0][4]) != (-heap[0][0], heap[0][1]):
            heapq.heappop(heap)
        while known:
            p = known[0][3]
            if self.known.pair.get(p) != -known[0][0]:
                heapq.heappop(known)
            elif p in self.now or p in self.merged:
                self.aside.append(heapq.heappop(known))
            else:
                break
        mine = heap[0] if heap else None
        if known and (mine is None or (known[0][0], True, *known[0][1:3]) < mine[:4]):
            return known[0][3], -known[0][0], True
        return None if mine is None else (mine[4], -mine[0], mine[1])

    def plan(self, limit: int) -> tuple[list[tuple[int, int, int, int]], bool]:
        """(merges (a, b, number of the result, count) in order, whether a result was a symbol before)."""
        batch: list[tuple[int, int, int, int]] = []
        again = False
        while len(batch) < limit and not again:
            best = self._best()
            if best is None or not best[2] or best[1] < self.known.floor:
                break
            (a, b), n, _ = best
            name = self.names[a] + self.names[b]
            again = name in self.numbers
            new = self.numbers.setdefault(name, len(self.names))
            if not again:
                self.names.append(name)
            batch.append((a, b, new, n))
            self.merged.add((a, b))
            self.now.pop((a, b), None)
            if a == b:
                break
            if not again:
                self._merge(a, b, new)
        for e in self.aside:
            heapq.heappush(self.known.heap, e)
        return batch, again

    def _merge(self, a: int, b: int, new: int) -> None:
        self.merged.discard((a, b))            # the triples around it are those of before
        before = [(x, *self._triple(x, a, b)) for x in (self.known.second.get(a, set()) | self.second.get(a, set()))
                  if (x, a) not in self.merged and (x, a) != (a, b)]
        after = [(y, *self._triple(a, b, y)) for y in (self.known.first.get(b, set()) | self.first.get(b, set()))
                 if (b, y) not in self.merged and (b, y) != (a, b)]
        self.merged.add((a, b))
        # in a b a b the middle pair is beside two places: counts of (b, a) and of the results are only bounded then
        bab, aba = (next((t for t in side if t[0] == s), (s, 0, True)) for side, s in ((before, b), (after, a)))
        crossed = bab[1] > 0 and aba[1] > 0
        for side, other in ((before, b), (after, a)):
            for x, t, exact in side:
                old, new_pair = ((x, a), (x, new)) if side is before else ((b, x), (new, x))
                n, sure = self._count(old)
                if x == other and crossed:
                    self._put(old, n, False)
                    self._put(new_pair, t, False)
                    continue
                if t or not exact:
                    self._put(old, n - t if exact else n, sure and exact)
                if t >= self.known.floor:
                    self._put(new_pair, t, exact)
        if crossed:
            self._put((new, new), min(bab[1], aba[1]), False)
        self.lefts.add(a)
        self.rights.add(b)
