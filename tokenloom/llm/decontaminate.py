"""Benchmark decontamination by template canonicalisation.

Texts become token sequences (letter runs in lower case, numbers).  A *template* replaces slots by typed
placeholders: numbers (a fraction, with its whole part, is one), units (a unit word right after a number) and
names (a run of capitalised words is one).  A capitalised word that begins a sentence may be a name or not, so there are
two templates: in the first it is a word, in the second a name, with the names that follow it.  Windows of ``WINDOW`` tokens of the
benchmark items, and of ``WINDOW`` words and placeholders of their templates if they hold slots, are hashed; texts
are hashed alike and joined on the hash, either template with either.

Matches are gathered per (text, item) over neighbouring shifts, counted in words and placeholders: a word put in or
left out starts a new shift, a placeholder of more tokens does not.
From every shift a chain is built: the other shifts up to half the item's tokens away join it, the nearest first,
where their windows keep the order of the words.  In a chain every aligned pair of slots must be consistent (one value
of the item always meets the same value in the text), which tells a re-parameterised question from a chance
likeness; else the shift counts alone, and if it is not consistent itself, it is tried without the second template, and
then only windows that agree word for word count.  A text is reported for an item when the windows that count cover at least half of the item's tokens, or
``RUN`` tokens in one shift or without a break.

Templates with fewer than ``WORDS`` tokens outside slots say too little and are matched word for word only.
Items shorter than a window are one window; items of fewer than ``SHORT`` tokens match only texts that are
nothing but the item.  Letters and numbers alone make tokens, so symbols and line breaks do not hide a copy.

Scale: the benchmark's windows are counted first.  Up to ``SMALL`` windows (fixed bound, some 20 MB) they are
broadcast, the hashes as a sorted array that drops the other windows of a text before they leave the task;
above it the join shuffles both sides.  Shifts are gathered by regions of the text of twice the item's length, so the
item bounds a group, not the text.

Defined results: null texts are empty and match nothing; rows with a null id are not reported; repeated rows
are reported once; equal items are reported under each id; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import textnum as tn
from tokenloom.llm.stage import giving_back, staged

WINDOW = 8
WORDS = 4
SHORT = 5
RUN = 13
COVER = 0.5
SMALL = 200_000

# Unit words that follow a number.
UNITS = ("mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers "
         "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "dollar dollars cent cents euro euros usd eur percent degrees degree mph kmh kph hz khz mhz ghz w kw v kb mb gb tb").split()
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3


@functools.cache
def _units() -> np.ndarray:
    points, offsets = tn.code_points(UNITS)
    return np.sort(tn.span_hash(tn.point_prefix(points), offsets[:-1], offsets[1:]))


def lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def tokens(texts: list[str]):
    """(hash, slot types of both templates, whether one slot with the token before, offsets per text) of all tokens."""
    raw, offsets = tn.code_points(texts)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    points, _ = tn.code_points([lower(t) for t in texts])
    cls = tn.class_table()[points].copy()
    # a point or comma between digits belongs to the number
    inner = np.zeros(n, bool)
    inner[1:-1] = ((points[1:-1] == 46) | (points[1:-1] == 44)) & (cls[:-2] == tn.NUMBER) & (cls[2:] == tn.NUMBER)
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    inner[border] = False
    inner[border - 1] = False
    cls[inner] = tn.NUMBER
    start = tn.runs(cls, offsets)
    end = np.append(start[1:], n)
    keep = (cls[start] == tn.LETTER) | (cls[start] == tn.NUMBER)
    start, end = start[keep], end[keep]
    h = tn.span_hash(tn.point_prefix(points), start, end)
    at = np.searchsorted(start, offsets)
    number = cls[start] == tn.NUMBER
    first = np.zeros(len(start), bool)
    first[at[:-1][at[:-1] < len(start)]] = True
    kind = np.where(number, NUMBER, WORD).astype(np.int8)
    after = np.append(False, number[:-1]) & ~first
    units = _units()
    kind[after & ~number & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h)] = UNIT
    # names: a capital, then a small letter; at the start of a sentence in the second template only
    upper = raw != points
    pos = np.arange(n)
    solid = np.maximum.accumulate(np.where(tn.class_table()[points] != tn.SPACE, pos, -1))
    line = np.maximum.accumulate(np.where(points == 10, pos, -1))
    doc_start = offsets[np.searchsorted(offsets, start, "right") - 1]
    before = np.where(start > 0, start - 1, 0)
    last = np.where(start > doc_start, solid[before], -1)
    opened = (last < doc_start) | np.isin(points[np.maximum(last, 0)], np.array([ord(c) for c in ".!?:;\"“”«»()|"], np.uint32)) \
        | (np.where(start > doc_start, line[before], -1) > last)
    second = np.minimum(start + 1, n - 1)
    capital = ~number & upper[start] & (end - start > 1) & ~upper[second]
    name = capital & ~opened
    kind[name] = NAME
    second_kind = np.where(capital, NAME, kind).astype(np.int8)
    # one slot: names with white space, a hyphen or an apostrophe between them; the numbers of a fraction
    def between(chars):
        total = np.concatenate(([0], np.cumsum(chars)))
        return np.append(0, total[start[1:]] - total[end[:-1]])
    inked = between(tn.class_table()[points] != tn.SPACE)
    near = (inked == 0) | (inked == between(np.isin(points, np.array([ord(c) for c in "-'’"], np.uint32)))) & (np.append(0, start[1:] - end[:-1]) == 1)
    slash = (inked == 1) & (between((points == 47) | (points == 0x2044)) == 1) & number & np.append(False, number[:-1]) & ~first
    whole = (inked == 0) & number & np.append(False, number[:-1]) & ~first & ~slash & np.append(slash[1:], False)
    glued = name & near & ~first | slash | whole
    return h, kind, second_kind, glued, at


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = tn.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)])
    return out


def _begins(kinds: np.ndarray, glued: np.ndarray) -> np.ndarray:
    """Whether a token begins a word or placeholder of the template."""
    return ~(glued & np.append(False, kinds[1:] == kinds[:-1]))


def windows(h: np.ndarray, kind: np.ndarray, second_kind: np.ndarray, glued: np.ndarray, sizes_of):
    """(level, starts and ends of the units, size, positions, hashes) of the windows of one text: as it stands, then its
    templates; of the second only windows with a word that is no name in the first."""
    n = len(h)
    at = np.arange(n + 1)
    for size in sizes_of(n):
        if n >= size and (size >= SHORT or n == size):
            yield 0, at, size, at[:n - size + 1], _windows(h, size)
    opener = kind != second_kind
    for level, kinds in ((1, kind), (2, second_kind)) if opener.any() else ((1, kind),):
        begin = np.flatnonzero(_begins(kinds, glued))
        slot = kinds[begin] > 0
        template = np.where(slot, tn.mix(kinds[begin].astype(np.uint64) + np.uint64(77)), h[begin])
        count = np.concatenate(([0], np.cumsum(slot)))
        needed = np.concatenate(([0], np.cumsum(opener[begin] if level == 2 else slot)))
        m = len(begin)
        for size in sizes_of(m):
            if m < size or (size < SHORT and m != size):
                continue
            slots = count[size:] - count[:-size]
            use = np.flatnonzero((needed[size:] > needed[:-size]) & (size - slots >= WORDS))
            if len(use):
                yield level, np.append(begin, n), size, use, _windows(template, size)[use]


def _value(h: np.ndarray) -> int:
    """Value of a slot of one or more tokens."""
    v = h[:1]
    for i in range(1, len(h)):
        v = tn.mix(v * np.uint64(0x9E3779B97F4A7C15) + h[i:i + 1])
    return int(v.view(np.int64)[0])


# pos and span count tokens, size words and placeholders, unit those before; offs has where these begin, none for a text as it stands
_ROWS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int32()), ("unit", pa.int32()), ("span", pa.int32()), ("size", pa.int32()),
                   ("level", pa.int32()), ("offs", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64())), ("n", pa.int32())])
_ROWS_SQL = "id long, hash long, pos int, unit int, span int, size int, level int, offs array<int>, slots array<bigint>, n int"


def _rows(sizes_of, wanted):
    """Windows of texts; ``wanted`` (sorted hashes) keeps only those, ``sizes_of`` gives the window sizes of a length."""
    def run(batches):
        known = wanted.value if wanted is not None else None
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = b.column(0).to_pylist()
            bounds = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=bounds[1:])
            for lo, hi in tn.slices(bounds):
                h, kind, second_kind, glued, at = tokens(texts[lo:hi])
                out = [[] for _ in _ROWS]
                for j in range(hi - lo):
                    a, e = at[j], at[j + 1]
                    if ids[lo + j] is None or a == e:
                        continue
                    th, kinds = h[a:e], (None, kind[a:e], second_kind[a:e])
                    unit = np.cumsum(_begins(kinds[2], glued[a:e])) - 1
                    for level, edge, size, pos, hashes in windows(th, *kinds[1:], glued[a:e], sizes_of):
                        if known is not None:
                            if not len(known):
                                continue
                            hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                            pos, hashes = pos[hit], hashes[hit]
                        for p, x in zip(pos.tolist(), hashes.view(np.int64).tolist()):
                            at_tokens = edge[p:p + size + 1].tolist()
                            first, last = at_tokens[0], at_tokens[-1]
                            offs, values = [], []
                            if level:
                                offs = [t - first for t in at_tokens[:-1]]
                                values = [_value(th[s:t]) for s, t in zip(at_tokens, at_tokens[1:]) if kinds[level][s] > 0]
                            for c, v in zip(out, (ids[lo + j], x, first, unit[first], last - first, size, level, offs, values, e - a)):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)
    return run


class _Chain:
    """Windows that keep the order of the words, what they cover and whether their slots are consistent."""

    def __init__(self):
        self.keys, self.to, self.value, self.places, self.held, self.consistent = [], {}, {}, set(), [], True

    def add(self, w) -> None:
        places = [(w["item_pos"] + i, w["pos"] + d) for i, d in zip(w["item_offs"] or range(w["span"]), w["offs"] or range(w["span"]))]
        lo, hi = bisect_left(self.keys, places[0][0]), bisect_right(self.keys, places[-1][0])
        if lo and self.to[self.keys[lo - 1]] >= places[0][1] or hi < len(self.keys) and self.to[self.keys[hi]] <= places[-1][1]:
            return
        both = {k: self.to[k] for k in self.keys[lo:hi]}
        if any(both.setdefault(i, d) != d for i, d in places):
            return
        order = sorted(both)
        if any(both[x] >= both[y] for x, y in zip(order, order[1:])):
            return
        self.keys[lo:hi] = order
        self.to.update(both)
        self.consistent &= all(self.value.setdefault(x, y) == y for x, y in zip(w["item_slots"], w["slots"]))
        self.places.update(range(w["item_pos"], w["item_pos"] + w["item_span"]))
        self.held.append(w)

    def run(self) -> int:
        """Item tokens of the longest part without a break on either side."""
        best = begin = item_end = end = 0
        for w in sorted(self.held, key=lambda w: (w["item_pos"], w["pos"])):
            if w["item_pos"] > item_end or w["pos"] > end or not end:
                begin = w["item_pos"]
            item_end, end = max(item_end, w["item_pos"] + w["item_span"]), max(end, w["pos"] + w["span"])
            best = max(best, item_end - begin)
        return best


def _best(spots, n: int, low: int) -> int:
    """Most item tokens covered by a chain that is reported, 0 if none.  Windows of the first template are placed first; seeds are the shifts from ``low`` on, one item length."""
    half = (n + 1) // 2
    at_shift = defaultdict(list)
    reach = set()
    for w in sorted(spots, key=lambda w: (w["level"], w["item_pos"], w["pos"])):
        at_shift[w["unit"] - w["item_unit"]].append(w)
        reach.update(range(w["item_pos"], w["item_pos"] + w["item_span"]))
    if len(reach) < min(COVER * n, RUN):
        return 0
    best = 0
    holds = {s: {p for w in ws for p in range(w["item_pos"], w["item_pos"] + w["item_span"])} for s, ws in at_shift.items()}
    for seed in sorted((s for s in at_shift if low <= s < low + 2 * half), key=lambda s: (-len(holds[s]), s)):
        alone, chain = _Chain(), _Chain()
        for w in at_shift[seed]:
            alone.add(w)
            chain.add(w)
        if not alone.consistent:
            continue
        if len(alone.places) >= min(COVER * n, RUN):
            best = max(best, len(alone.places))
        near = sorted((s for s in at_shift if s != seed and abs(s - seed) <= half), key=lambda s: (abs(s - seed), -len(holds[s]), s))
        for s in near:
            if not holds[s] <= chain.places:
                for w in at_shift[s]:
                    chain.add(w)
        if chain.consistent and (len(chain.places) >= COVER * n or chain.run() >= RUN):
            best = max(best, len(chain.places))
        if best >= len(reach):
            break
    return best


_SCORED_SQL = "id long, item_id long, item_tokens int, covered int, plain int"


def _score(batches):
    for b in batches:
        out = [[] for _ in range(5)]
        for r in (r for i in range(0, b.num_rows, 16) for r in b.slice(i, 16).to_pylist()):
            n = r["item_tokens"]
            low = r["region"] * 2 * ((n + 1) // 2) + (n + 1) // 2
            same = [w for w in r["spots"] if w["slots"] == w["item_slots"]]
            plain = _best(same, n, low)
            covered = max([plain] + [_best(spots, n, low) for level in (2, 3, 4) if len(spots := [w for w in r["spots"] if w["level"] <= level]) > len(same)])
            if covered:
                for c, v in zip(out, (r["id"], r["item_id"], n, covered, int(plain > 0))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                                         ["id", "item_id", "item_tokens", "covered", "plain"])


def _own_sizes(n: int):
    return (min(n, WINDOW),)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per reported (doc_id, item_id): covered and item tokens, coverage, whether slots differ."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = staged(items.mapInArrow(giving_back(_rows(_own_sizes, None)), _ROWS_SQL).distinct(), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    small = items.count() <= SMALL
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))  # at most WINDOW numbers
    wanted = None
    if small:
        known = np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(known))
    found = texts.mapInArrow(giving_back(_rows(lambda n: sizes, wanted)), _ROWS_SQL)
    right = items.select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("unit").alias("item_unit"), F.col("span").alias("item_span"),
                         F.col("level").alias("item_level"), F.col("offs").alias("item_offs"), F.col("slots").alias("item_slots"),
                         F.col("n").alias("item_tokens"))
    period = 2 * F.floor((F.col("item_tokens") + 1) / 2)
    pairs = found.drop("n").join(F.broadcast(right) if small else right, "hash") \
        .where(F.size("slots") == F.size("item_slots")) \
        .withColumn("region", F.floor((F.col("unit") - F.col("item_unit")) / period))
    # a shift is in its own region and the one before: a region reaches over two item lengths, its seeds lie in the middle
    pairs = pairs.withColumn("region", F.explode(F.array("region", F.col("region") - 1)))
    spot = F.struct("item_pos", "item_unit", "item_span", "item_offs", "item_slots", "pos", "unit", "span", "offs", "slots",
                    (F.col("level") + F.col("item_level")).alias("level"))
    regions = pairs.groupBy("id", "item_id", "item_tokens", "region").agg(F.collect_set(spot).alias("spots"))
    scored = regions.mapInArrow(giving_back(_score), _SCORED_SQL)
    best = scored.groupBy("id", "item_id", "item_tokens").agg(F.max("covered").alias("covered"), F.max("plain").alias("plain"))
    return best.select(F.col("id").alias("doc_id"), "item_id", F.col("covered").cast("long").alias("covered"),
                       F.col("item_tokens").cast("long").alias("item_tokens"),
                       (F.col("covered") / F.col("item_tokens")).alias("coverage"),
                       (F.col("plain") == 0).alias("reparameterised"))
