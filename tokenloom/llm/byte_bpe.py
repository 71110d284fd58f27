"""Byte-level BPE: encoding by a fold of ranked merges over byte arrays, decoding by joining pieces.

Encoding runs in one narrow pass over the texts without a shuffle:

0. The head: words that several tasks meet in a sample of about ``HEAD_DOCS`` documents (the ``HEAD_WORDS`` most
   widespread ones, of ``FOLD_BYTES`` bytes at most, so its size is bounded) are encoded first, by the fold of step 2,
   and sent to every worker, so that they are not folded in every task again.  It changes no result, only how often a
   word is folded.
1. An Arrow step splits the texts of a task by the pre-tokenizer's pattern (class changes on code points), slice by
   slice: one row per word that is neither in the head nor met before (the symbols of its bytes), ``WORDS_AT_ONCE`` to a batch, then
   one row per document that ended in the slice, with its words as references into the head and the words met.
2. Spark higher-order functions encode each distinct word: ``aggregate`` folds merges over the array
   of symbols; the state is one array of the symbols with the rank of every adjacent pair between its two (the first
   state comes from step 1), and each step merges the leftmost pair of least rank.  The rank map is a literal: a table
   of shifted rows with one slot per pair, so that one look-up is two array reads.
3. An Arrow step keeps the ids of the words met, replaces the references by them and decodes the ids again by
   concatenating the binary pieces.

After ``CHUNK_WORDS`` words both steps forget the words met and a new chunk begins.  A text longer than a slice is cut
where white space begins, which is always a border of pieces.  So a task holds a slice, ``CHUNK_WORDS`` hashes and ids,
and the references of one document, whatever the input.  The fold is quadratic in a word's length; words over
``FOLD_BYTES`` bytes are merged with a heap in step 1 instead, with the same result.

Defined results: a null text is an empty text (no ids); every input row gives one output row, repeated
rows and null ids as well; extra columns are ignored; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import textnum as tn
from tokenloom.llm.stage import giving_back, staged

HEAD_DOCS = 20_000       # documents of the sample that the head of widespread words comes from
HEAD_WORDS = 300_000     # most words of the head, each of FOLD_BYTES bytes at most
CHUNK_WORDS = 300_000    # words met that a task remembers: a hash, a place and a few ids each
WORDS_AT_ONCE = 2_000    # words of one batch to fold
SLICE = 300_000          # code points split at a time
DECODE_IDS = 200_000     # ids decoded at a time
FOLD_BYTES = 64
_END = 65535            # sentinel symbol around a word; no pair with it has a rank
_FREE = 1 << 50         # free slot of the rank map
_SLOTS_PER_PAIR = 1.6
_ID = 65536             # added to the symbols of a fold's state, where ranks are below it
_PLAIN = 2 * _ID        # least rank of no piece
_TAG = 17               # bits of a rank in a slot, the left symbol above them
_STEP = 4096            # places tried at a time for a row of the rank map
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")   # fixed values: contractions of the pattern


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 piece and rank per line."""
    cells = data.split()
    return dict(zip(map(base64.b64decode, cells[::2]), map(int, cells[1::2])))


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left * 65536 + right -> rank, for every pair of pieces whose concatenation is a piece."""
    if max(ranks.values(), default=0) >= _END:
        raise ValueError("the pair table holds ids below 65535")
    return {ranks[p[:i]] * 65536 + ranks[p[i:]]: r for p, r in ranks.items()
            for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}


def _prime(n: int) -> int:
    n |= 1
    while any(n % d == 0 for d in range(3, int(n ** 0.5) + 1, 2)):
        n += 2
    return n


def perfect_table(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(table, shift): slot of a key is (key + shift[key % len(shift)]) % len(table).  ``shifted_table`` costs the fold less.

    A used slot holds key * 65536 + rank.  Keys of one shift group differ modulo the table's length
    because both lengths are primes whose product exceeds every key.
    """
    size = _prime(max(70_001, int(len(pairs) * _SLOTS_PER_PAIR)))
    groups_n = _prime(max(70_001, len(pairs) // 4))
    groups: dict[int, list[int]] = {}
    for key in pairs:
        groups.setdefault(key % groups_n, []).append(key)
    table, shift = [_FREE] * size, [0] * groups_n
    for g, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        d = 0
        while any(table[(k + d) % size] != _FREE for k in keys):
            d += 1
        shift[g] = d
        for k in keys:
            table[(k + d) % size] = k * 65536 + pairs[k]
    return table, shift


def _literal(values: list[int]) -> Column:
    """An array literal; the cast of the constant string is folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def byte_symbols(words: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, size of every word): each byte's own id, and the sentinel on both sides of a word."""
    of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    out = np.full(int(size.sum()), _END, np.int64)
    inner = np.ones(len(out), bool)
    end = np.cumsum(size)
    inner[end - 1] = inner[end - size] = False
    out[inner] = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    return out, size


def shifted_table(pairs: dict[int, int]) -> np.ndarray:
    """One array in which two look-ups give the rank of a pair: ``t[t[a + _ID] + b + _ID] ^ (a + _ID) << _TAG`` is it, or at least _PLAIN.

    The right symbols of a left one are a row; rows are shifted, the longest first, to where their slots are free.
    A used slot holds its left symbol and the rank, so that no other row finds it; free slots hold 0.
    """
    keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
    left, right = keys >> 16, keys & 0xFFFF
    cut = np.flatnonzero(np.diff(left, prepend=-1))
    ends = np.append(cut[1:], len(left))
    free, shift, low = np.ones(_ID * 4, bool), np.zeros(_ID, np.int64), 0
    for row in np.argsort(cut - ends, kind="stable"):
        cols = right[cut[row]:ends[row]]
        at = max(0, low - int(cols[0]))
        while True:
            if at + int(cols[-1]) + _STEP > len(free):
                free = np.append(free, np.ones(len(free), bool))
            fits = free[at + cols[0]:at + cols[0] + _STEP].copy()
            for c in cols[1:]:
                fits &= free[at + c:at + c + _STEP]
                if not fits.any():
                    break
            if fits.any():
                break
            at += _STEP
        at += int(fits.argmax())
        free[at + cols] = False
        shift[left[cut[row]]] = at
        while not free[low]:
            low += 1
    out = np.zeros(2 * _ID + int(shift.max()) + _ID, np.int64)
    out[_ID:2 * _ID] = shift + _ID
    rank = np.array([pairs[k] for k in keys.tolist()], np.int64)
    out[2 * _ID + shift[left] + right] = (left + _ID << _TAG) | rank
    return out


def fold_merges(state: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array<bigint>) of one word given as its first state (``fold_states``).

    A state is one array: symbols, _ID added to each, with the rank of a pair between its two.  Ranks of pieces are the
    least numbers in it and ranks of no piece the largest, so the least number tells the pair to merge.
    """
    def encode(t: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            return t[t[a] + b].bitwiseXOR(F.shiftleft(a, _TAG))

        def merge(s: Column) -> Column:
            def at(i: Column) -> Column:   # i: 1-based place of the rank of the pair to merge
                new = s[i - 1] + _ID
                return F.when(s[i - 1] < _ID, F.concat(F.slice(s, F.lit(1), i - 3),
                                                       F.array(rank(s[i - 4], new), new, rank(new, s[i + 2])),
                                                       F.slice(s, i + 3, F.size(s)))).otherwise(s)
            return F.transform(F.array(F.array_position(s, F.array_min(s)).cast("int")), at)[0]

        def fold(first: Column) -> Column:   # a word of n bytes has n + 2 symbols and n + 1 ranks
            steps = F.sequence(F.lit(1), F.shiftright(F.size(first), 1) - 2)
            ids = F.aggregate(steps, first, lambda s, _: merge(s), lambda s: F.filter(s, lambda x: x < _ID + _END))
            return F.transform(ids, lambda x: x - _ID)
        return F.transform(F.array(state), fold)[0]

    return F.transform(F.array(_literal(shifted_table(pair_ranks(ranks)).tolist())), encode)[0]


def fold_states(word: pa.ListArray, ranks: dict[bytes, int]) -> pa.ListArray:
    """First states of words given as symbols (``byte_symbols``): each pair of bytes with its rank."""
    return _first_states(word, *_byte_pairs(ranks))


def _first_states(word: pa.ListArray, of_byte: np.ndarray, ranks_of: np.ndarray) -> pa.ListArray:
    off = word.offsets.to_numpy().astype(np.int64)
    flat = word.values.to_numpy()[off[0]:off[-1]]
    off, n = off - off[0], np.diff(off)
    at = of_byte[flat]
    out = np.empty(2 * len(flat), np.int64)
    out[::2] = flat + _ID
    out[1:-1:2] = ranks_of[at[:-1], at[1:]]
    keep = np.ones(len(out), bool)
    keep[2 * off[1:][n > 0] - 1] = False          # nothing stands behind a word's last symbol
    new = np.zeros(len(off), np.int32)
    np.cumsum(np.where(n > 0, 2 * n - 1, 0), out=new[1:])
    return pa.ListArray.from_arrays(pa.array(new), pa.array(out[keep]))


def _byte_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(byte of each symbol that is one, else 256; rank of each pair of bytes, no piece's above all ids)."""
    of_byte = np.full(_ID, 256, np.int64)
    of_byte[[ranks[bytes([i])] for i in range(256)]] = np.arange(256)
    out = np.full((257, 257), 1 << 40, np.int64)
    for p, r in ranks.items():
        if len(p) == 2:
            out[p[0], p[1]] = r
    return of_byte, out


def _begun(file_bytes, step=None):
    """The Arrow step, with the words of its rows as first states; without a step, of the rows it gets."""
    def run(batches):
        pairs = _byte_pairs(load_ranks(file_bytes.value))   # the map itself goes: the step holds its own
        for b in batches if step is None else step(batches):
            i = b.schema.get_field_index("word")
            word = b.column(i)
            cells = _first_states(word, *pairs)
            if word.null_count:
                cells = pa.ListArray.from_arrays(cells.offsets, cells.values, mask=word.is_null())
            yield b.set_column(i, "word", cells)
    return run


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for long words."""
    parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
    n = len(parts)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = nxt[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
            continue
        parts[i], parts[j] = piece, None
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for left in (prev[i], i):
            if left >= 0 and nxt[left] < n and (r := ranks.get(p := parts[left] + parts[nxt[left]])) is not None:
                heapq.heappush(heap, (r, left, p))
    return [ranks[p] for p in parts if p is not None]


@functools.cache
def _suffix_points():
    return [[ord(c) for c in s] for s in SUFFIXES]


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of the pieces that the pattern matches one after the other; they tile the texts."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    cls = tn.class_table()[points]
    start = tn.runs(cls, offsets)
    end = np.append(start[1:], n)
    doc_edge = np.zeros(n + 1, bool)
    doc_edge[offsets] = True
    mark = np.zeros(n + 1, bool)
    space = cls[start] == tn.SPACE
    last = space & doc_edge[end]            # white space that ends a text is one piece
    inner = space & ~doc_edge[end]          # else its last character stands alone or leads the next piece
    mark[start[last]] = True
    mark[start[inner]] = True
    mark[end[inner] - 1] = True
    word = start[~space]
    led = (word > 0) & ~doc_edge[word] & (points[word - 1] == 32)
    mark[word[~led]] = True
    # contractions: an apostrophe that begins a piece, then one of the suffixes
    quote = np.flatnonzero((points == 39) & mark[:-1])
    if len(quote):
        limit = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.append(points, [0, 0, 0])
        taken = np.zeros(len(quote), bool)
        for suffix in _suffix_points():
            k = len(suffix)
            ok = ~taken & (quote + k < limit)
            for i, c in enumerate(suffix):
                ok &= padded[quote + 1 + i] == c
            q = quote[ok]
            mark[q + 1] = False
            nxt = q + 1 + k
            mark[nxt[(nxt < limit[ok])]] |= cls[nxt[nxt < limit[ok]]] == tn.LETTER
            taken |= ok
    return np.flatnonzero(mark[:-1])


_ROWS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("word", pa.list_(pa.int64())),
                   ("known", pa.list_(pa.int64())), ("refs", pa.binary())])
_ROWS_SQL = "kind int, chunk long, doc_id long, word array<bigint>, known array<bigint>, refs binary"


class Words:
    """Place of words by their hash: sorted hashes, grown by merging."""

    def __init__(self, hashes: np.ndarray | None = None):
        h = np.zeros(0, np.uint64) if hashes is None else hashes
        order = np.argsort(h)
        self.hashes, self.place = h[order], order.astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.place[at], np.int32(-1))

    def add(self, h: np.ndarray) -> np.ndarray:
        """Places of new hashes (sorted, not known yet): the next numbers."""
        new = np.arange(len(self), len(self) + len(h), dtype=np.int32)
        at = np.searchsorted(self.hashes, h)
        self.hashes, self.place = np.insert(self.hashes, at, h), np.insert(self.place, at, new)
        return new


class Ids:
    """Ids of words by place, those of the head first; room is doubled when it runs out."""

    def __init__(self, flat: np.ndarray | None = None, length: np.ndarray | None = None):
        self.flat = np.zeros(0, np.uint32) if flat is None else flat.astype(np.uint32)
        self.length = np.zeros(0, np.int32) if length is None else length.astype(np.int32)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.used, self.n = len(self.flat), len(self.length)

    def of(self, refs: np.ndarray) -> np.ndarray:
        """Ids of the words at these places, joined."""
        return tn.ragged_take(self.flat, self.start[refs], self.length[refs])

    @staticmethod
    def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(a):
            return a
        out = np.empty(max(2 * len(a), used + more, 1024), a.dtype)
        out[:used] = a[:used]
        return out

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used, len(flat))
        self.length, self.start = (self._room(a, self.n, len(length)) for a in (self.length, self.start))
        self.flat[self.used:self.used + len(flat)] = flat
        self.length[self.n:self.n + len(length)] = length
        self.start[self.n:self.n + len(length)] = self.used + np.cumsum(length) - length
        self.used, self.n = self.used + len(flat), self.n + len(length)


class Head:
    """The widespread words: their places by hash, their ids by place."""

    def __init__(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray):
        self.words, self.flat, self.length = Words(hashes), flat.astype(np.uint32), length.astype(np.int32)

    def ids(self) -> Ids:
        return Ids(self.flat, self.length)


NO_HEAD = Head(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def cut_text(text: str, limit: int) -> list[str]:
    """Parts of about ``limit`` code points at most, cut where white space begins (longer if there is none)."""
    parts, lo = [], 0
    while len(text) - lo > limit:
        for at in (*range(lo + limit, lo + limit // 2, -1), *range(lo + limit + 1, len(text))):
            if text[at].isspace() and not text[at - 1].isspace() and tn.class_table()[ord(text[at])] == tn.SPACE \
                    and tn.class_table()[ord(text[at - 1])] != tn.SPACE:
                break
        else:
            break
        parts.append(text[lo:at])
        lo = at
    return parts + [text[lo:]]


def _text_slices(column):
    """Slices of an Arrow text column: (row, whether the row's text ends here) per part, and the parts."""
    _, offsets = tn.utf8_buffers(column)
    for lo, hi in tn.slices(offsets, SLICE):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        if hi - lo == 1 and len(texts[0]) > SLICE:
            parts = cut_text(texts[0], SLICE)
            for i, part in enumerate(parts):
                yield [(lo, i == len(parts) - 1)], [part]
        else:
            yield [(lo + i, True) for i in range(hi - lo)], texts


def _pieces_of(texts: list[str]):
    """(distinct hashes, bytes of chosen ones, piece -> hash, first piece of every text) of the joined texts."""
    points, offsets = tn.code_points(texts)
    start = piece_starts(points, offsets)
    end = np.append(start[1:], len(points))[:len(start)]
    h = tn.span_hash(tn.point_prefix(points), start, end)
    uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    first, last = start[first], end[first]

    def words(which: np.ndarray) -> list[bytes]:
        raw = "".join(texts).encode()
        at = np.zeros(len(points) + 1, np.int64)        # where the bytes of a code point begin
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        return [raw[s:e] for s, e in zip(at[first[which]].tolist(), at[last[which]].tolist())]
    return uniq, words, inverse, np.searchsorted(start, offsets)


def _word_columns(words: list[bytes], ranks):
    """(symbols of the words to fold, ids of the words that need no fold): pieces of the vocabulary and long words."""
    known = [None if (r := ranks.get(w)) is None and len(w) <= FOLD_BYTES else merge_long(w, ranks) if r is None else [r] for w in words]
    flat, size = byte_symbols([w if k is None else b"" for w, k in zip(words, known)], ranks)
    off = np.zeros(len(words) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(known, pa.list_(pa.int64()))


def _distinct_words(file_bytes):
    """Words of a task's texts that fit the head: (hash, word, known), each once unless the task meets very many."""
    schema = pa.schema([("h", pa.int64()), ("word", pa.list_(pa.int64())), ("known", pa.list_(pa.int64()))])

    def run(batches):
        ranks, seen = load_ranks(file_bytes.value), Words()
        for b in batches:
            for _, texts in _text_slices(b.column(0)):
                uniq, words_of, _, _ = _pieces_of(texts)
                new = np.flatnonzero(seen.find(uniq) < 0)
                seen.add(uniq[new])
                words = words_of(new)
                fits = np.array([len(w) <= FOLD_BYTES for w in words], bool)
                words, h = [w for w, ok in zip(words, fits) if ok], uniq[new][fits].view(np.int64)
                for lo in range(0, len(words), WORDS_AT_ONCE):
                    word, known = _word_columns(words[lo:lo + WORDS_AT_ONCE], ranks)
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo:lo + WORDS_AT_ONCE]), word, known], schema=schema)
                if len(seen) > CHUNK_WORDS:
                    seen = Words()
    return run


def _split(file_bytes, head):
    """Texts to rows: per slice the words outside the head that are new (kind 0), then the documents (kind 1)."""

    def word_rows(words: list[bytes], chunk: int, ranks):
        for lo in range(0, len(words), WORDS_AT_ONCE):
            part = words[lo:lo + WORDS_AT_ONCE]
            n = len(part)
            word, known = _word_columns(part, ranks)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, chunk)), pa.nulls(n, pa.int64()),
                                              word, known, pa.nulls(n, pa.binary())], schema=_ROWS)

    def doc_rows(docs: list, chunk: int):
        n = len(docs)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(np.full(n, chunk)), pa.array([d for d, _ in docs], pa.int64()),
             pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), pa.array([r for _, r in docs], pa.binary())],
            schema=_ROWS)

    def run(batches):
        ranks, top = load_ranks(file_bytes.value), head.value
        base, met, chunk = len(top.words), Words(), 0
        begun: list[bytes] = []                       # references of a text whose end is still to come
        for b in batches:
            ids = b.column(0).to_pylist()
            for rows, texts in _text_slices(b.column(1)):
                if len(met) > CHUNK_WORDS and not begun:
                    met, chunk = Words(), chunk + 1
                uniq, words_of, inverse, cut = _pieces_of(texts)
                refs = top.words.find(uniq)
                out = np.flatnonzero(refs < 0)
                place = met.find(uniq[out])
                new = out[place < 0]
                place[place < 0] = met.add(uniq[new])
                refs[out] = base + place
                yield from word_rows(words_of(new), chunk, ranks)
                flat = refs[inverse]
                docs = []
                for i, (row, ended) in enumerate(rows):
                    begun.append(flat[cut[i]:cut[i + 1]].tobytes())
                    if ended:
                        docs.append((ids[row], b"".join(begun)))
                        begun = []
                if docs:
                    yield doc_rows(docs, chunk)
    return run


def load_pieces(data: bytes):
    """(joined pieces, start of each id, length of each id)."""
    ranks = load_ranks(data)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    order = [b""] * len(length)
    for p, r in ranks.items():
        length[r], order[r] = len(p), p
    return np.frombuffer(b"".join(order), np.uint8), np.cumsum(length) - length, length


def decode(ids: np.ndarray, pieces) -> bytes:
    """The pieces of the ids, joined."""
    blob, start, length = pieces
    return tn.ragged_take(blob, start[ids], length[ids]).tobytes()


def _decoded_sha256(ids: np.ndarray, pieces) -> str:
    digest = hashlib.sha256()
    for lo in range(0, len(ids), DECODE_IDS):
        digest.update(decode(ids[lo:lo + DECODE_IDS], pieces))
    return digest.hexdigest()


def _assemble(file_bytes, head, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        pieces, top = load_pieces(file_bytes.value), head.value
        met, now = top.ids(), 0
        for b in batches:
            kind, chunk = b.column("kind").to_numpy(), b.column("chunk").to_numpy()
            # a batch may hold words and documents, of several chunks: handle its stretches in turn
            turns = np.flatnonzero((np.diff(kind) != 0) | (np.diff(chunk) != 0)) + 1
            edges = [0, *turns.tolist(), len(kind)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if chunk[lo] != now:
                    met, now = top.ids(), chunk[lo]
                if kind[lo] == 0:
                    col = part.column("ids")
                    off = col.offsets.to_numpy()
                    met.add(col.values.to_numpy()[off[0]:off[-1]].astype(np.uint32), np.diff(off))
                    continue
                n, sha, dec, raw = [], [], [], []
                for refs in part.column("refs"):
                    ids = met.of(np.frombuffer(refs.as_buffer(), np.int32))
                    n.append(len(ids))
                    bits = ids.astype("<u4").tobytes()
                    sha.append(hashlib.sha256(bits).hexdigest())
                    dec.append(_decoded_sha256(ids, pieces))
                    if with_ids:
                        raw.append(bits)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, schema=schema)
    return run


def encode_bytes(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, digests of the ids and of the decoded bytes (and the ids)."""
    with open(rank_file, "rb") as f:
        data = f.read()
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(data)  # the vocabulary file: under 1 MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = fold_merges(F.col("word"), load_ranks(data))
    head = sc.broadcast(learn_head(rows, shipped, fold))  # HEAD_WORDS words of FOLD_BYTES bytes at most
    split = rows.mapInArrow(giving_back(_begun(shipped, _split(shipped, head))), _ROWS_SQL)
    folded = F.when(F.col("kind") == 0, F.coalesce("known", fold))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    folded = split.select("kind", "chunk", "doc_id", folded.alias("ids"), "refs")
    return folded.mapInArrow(giving_back(_assemble(shipped, head, with_ids)), schema)


def learn_head(rows: DataFrame, shipped, fold: Column) -> Head:
    """The words that the most tasks of a sample meet, two at least; any sample gives right results."""
    share = min(1.0, HEAD_DOCS / max(1, rows.count()))
    sample = rows.select("text").sample(fraction=share, seed=7)
    met = sample.mapInArrow(giving_back(_distinct_words(shipped)), "h long, word array<bigint>, known array<bigint>") \
        .groupBy("h").agg(F.count("*").alias("n"), F.first("word").alias("word"), F.first("known").alias("known"))
    words = met.where("n > 1").orderBy(F.desc("n"), "h").limit(HEAD_WORDS).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    # stored before the fold: a plan with shuffles is described anew after each of them, literal rank map included
    words = staged(words.select("h", "word", "known"), "head-words", narrow=True) \
        .mapInArrow(giving_back(_begun(shipped)), "h long, word array<bigint>, known array<bigint>")
    got = staged(words.select("h", F.coalesce("known", fold).cast("array<int>").alias("ids")), "head", narrow=True).toArrow()
    if not got.num_rows:
        return NO_HEAD
    ids = got["ids"].combine_chunks()
    return Head(got["h"].to_numpy().view(np.uint64), ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()))
