"""Vectorised text kernels used inside Arrow tasks: words, their 64-bit hashes, code-point classes.

A batch of texts is one flat array (UTF-8 bytes or code points) plus document offsets; words are
found with class changes and hashed with prefix sums, so no Python object is made per word.  Work
is done on slices of at most ``SLICE`` units (one longer text is a slice of its own), which bounds
the memory of a task by the slice, not by the Arrow batch.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SLICE = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (a bijection), so that equal inputs only give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, _BASE_INV, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[e] - P[s] = sum of mixed values[i] * base**i over s <= i < e."""
    up, _ = _powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), independent of where the span lies."""
    _, down = _powers.get(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def utf8_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n+1) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of documents whose texts hold at most ``limit`` units together (at least one document)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


@functools.cache
def _byte_tables():
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return mix(fold.astype(np.uint64) + U(1)), word


def byte_words(data: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: (hash of each word, word offsets per document)."""
    values, is_word = _byte_tables()
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = w & (edge[:-1] | np.concatenate(([True], ~w[:-1])))
    last = w & (edge[1:] | np.concatenate((~w[1:], [True])))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix(values[data]), start, end), np.searchsorted(start, offsets)


def shingle_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles of one document, sorted; fewer words make one shingle."""
    if len(words) == 0:
        return words
    k_used = min(k, len(words))
    h = np.zeros(len(words) - k_used + 1, np.uint64)
    for i in range(k_used):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[i:i + len(h)])
    return np.unique(mix(h + U(k_used)))


# --- code points ---------------------------------------------------------------------------------

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: white space, letter (L*), number (N*), other."""
    import regex
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for cls, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pat, every):
            table[at[m.start():m.end()]] = cls
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a list of texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def point_prefix(points: np.ndarray) -> np.ndarray:
    return prefix(mix(points.astype(np.uint64) + U(1)))


def runs(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of the maximal runs of one class, cut at document borders."""
    n = len(cls)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= cls[1:] != cls[:-1]
    return np.flatnonzero(edge[:-1])


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + lens[i]]."""
    total = int(lens.sum())
    if total == 0:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)]
