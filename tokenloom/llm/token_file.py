"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with control bytes apart.

Format.  A file set is a folder with ``ids`` (Parquet container, one file per shard; shards and the rows in
them are in ascending document order) and ``vocab`` (rank, id).  A row is a segment of whole documents:

- ``shard``, ``first`` (ids before the segment in its shard), ``n_ids``
- ``doc_ids`` and ``lengths`` of its documents
- ``control``: two bits per id, four ids to a byte (lowest bits first): data bytes of the id, less one
- ``data``: the 1 to 4 low bytes of each id's frequency rank, little endian

The rank of an id is its place by falling count over the whole corpus (ties by id), so the 256 most
frequent ids take one byte.  A segment is closed at ``SEGMENT_IDS`` ids and never cuts a document, so any
row can be decoded alone: a lost task re-reads its rows only.  Decoding is a table lookup: the control
byte gives four lengths at once, running sums give the places, and the data bytes are gathered.

Encoding.  The tokenizer's model runs once per distinct word of a worker (bounded cache); splitting into
words and lower-casing are vectorised for texts whose characters the vectorised rules are known to treat
as the library does (below U+0250 and general punctuation, without the text of an added token); every
other text goes through the library whole.  The counts are one small table per task; only the vocabulary
(one row per id of the tokenizer) reaches the driver, and one count of ids per shard is broadcast.

Defined results: a null text is empty (the end id alone); rows with a null id come first; rows that repeat
an id stand next to each other, ordered by their ids; extra columns are ignored; an empty table gives
empty files and no rows.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import textnum as tn
from tokenloom.llm.stage import staged

SEGMENT_IDS = 1 << 18
CACHE_WORDS = 1_000_000
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")   # fixed values: contractions of the tokenizer's pattern


# --- variable-length coding -----------------------------------------------------------------------

#: data bytes of the four ids of a control byte
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(values, "<u4")
    more = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[:len(v)] = more
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of a pair of byte strings."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    start = np.cumsum(size) - size
    out = raw[start]
    for i in range(1, 4):
        longer = size > i
        out[longer] |= raw[start[longer] + i] << np.uint32(8 * i)
    return out


# --- encoding -------------------------------------------------------------------------------------

@functools.cache
def _byte_chars():
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, with a cache of distinct words."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(spec)
        self.added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self._reset()

    def _reset(self):
        self.index: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, key: int, word: str) -> int:
        if not word.isascii() or not word.isprintable():
            word = word.encode().decode("latin-1").translate(_byte_chars())
        ids = [t.id for t in self.lib.model.tokenize(word)]
        at = len(self.index)
        if at == len(self.start):
            self.start, self.length = np.resize(self.start, 2 * at), np.resize(self.length, 2 * at)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[at], self.length[at] = self.used, len(ids)
        self.used += len(ids)
        self.index[key] = at
        return at

    def plain(self, texts: list[str]) -> np.ndarray:
        """Which texts the vectorised rules cover."""
        points, offsets = tn.code_points(texts)
        odd = ((points >= 0x250) & ((points < 0x2010) | (points > 0x2027))) | (points == 0x130)
        count = np.concatenate(([0], np.cumsum(odd)))[offsets]
        ok = np.diff(count) == 0
        for i, t in enumerate(texts):
            if ok[i] and "<|" in t and any(a in t for a in self.added):
                ok[i] = False
        return ok

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ok = self.plain(texts)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(~ok):
            out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        which = np.flatnonzero(ok)
        if len(which):
            lower = [texts[i].lower() for i in which]
            points, offsets = tn.code_points(lower)
            start, end = word_spans(points, offsets)
            h = tn.span_hash(tn.point_prefix(points), start, end)
            uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if len(self.index) + len(uniq) > CACHE_WORDS:
                self._reset()
            joined, ref = "".join(lower), np.empty(len(uniq), np.int64)
            for i, (key, s, e) in enumerate(zip(uniq.tolist(), start[first].tolist(), end[first].tolist())):
                at = self.index.get(key)
                ref[i] = self._add(key, joined[s:e]) if at is None else at
            word = ref[inverse] if len(uniq) else np.zeros(0, np.int64)
            ids = tn.ragged_take(self.flat, self.start[word], self.length[word])
            ends = np.concatenate(([0], np.cumsum(self.length[word])))[np.searchsorted(start, offsets)]
            for j, i in enumerate(which):
                out[i] = ids[ends[j]:ends[j + 1]]
        return out


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased texts: contractions, letter runs, single numbers, runs of other characters."""
    cls = tn.class_table()[points] if len(points) else np.zeros(0, np.uint8)
    mark = np.zeros(len(points) + 1, bool)
    mark[tn.runs(cls, offsets)] = True
    mark[:-1] |= cls == tn.NUMBER
    mark[-1] = True
    quote = np.flatnonzero((points == 39) & mark[:-1])
    if len(quote):
        limit = offsets[np.searchsorted(offsets, quote, "right")]
        padded, taken = np.append(points, [0, 0, 0]), np.zeros(len(quote), bool)
        for suffix in SUFFIXES:
            ok = ~taken & (quote + len(suffix) < limit)
            for i, c in enumerate(suffix):
                ok &= padded[quote + 1 + i] == ord(c)
            mark[quote[ok] + 1] = False
            mark[quote[ok] + 1 + len(suffix)] = True
            taken |= ok
    edge = np.flatnonzero(mark)
    start, end = edge[:-1], edge[1:]
    keep = cls[start] != tn.SPACE
    return start[keep], end[keep]


@functools.lru_cache(1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def _tokenize(spec, end_id: int, width: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = _encoder(spec.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=sizes[1:])
            for lo, hi in tn.slices(sizes):
                ids = [np.append(x, end_id).astype(width).tobytes() for x in enc.encode(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], schema=schema)
    return run


def _count(size: int, width: str):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, np.frombuffer(x.as_buffer(), width), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], schema=schema)
    return run


_SEGMENT = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
_SEGMENT_SQL = ("shard int, first long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
                "control binary, data binary")


def _segments(rank_of, width: str):
    def run(batches):
        shard, before = TaskContext.get().partitionId(), 0
        docs, lens, ids, held = [], [], [], 0

        def close():
            control, data = pack(rank_of.value[np.concatenate(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=_SEGMENT)
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), width)
                docs.append(d)
                lens.append(len(x))
                ids.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield close()
                    before += held
                    docs, lens, ids, held = [], [], [], 0
        if docs:
            yield close()
    return run


def write_token_file(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, write the file set to ``path`` in ascending id order."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    size = max(_encoder(spec).size, end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = staged(rows.mapInArrow(_tokenize(spark.sparkContext.broadcast(spec), end_id, width), "doc_id long, ids binary"), "ids")
    counts = ids.select("ids").mapInArrow(_count(size, width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]  # one row per id of the tokenizer
    spark.createDataFrame([(i, x) for i, x in enumerate(order)], "rank int, id int").coalesce(1) \
        .write.parquet(f"{path}/vocab")
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(len(order))
    ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids") \
        .mapInArrow(_segments(spark.sparkContext.broadcast(rank_of), width), _SEGMENT_SQL) \
        .write.option("compression", "none").parquet(f"{path}/ids")


def _documents(id_of, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for b in batches:
            for base, docs, lens, control, data, n in zip(*(b.column(c).to_pylist() for c in
                                                          ("base", "doc_ids", "lengths", "control", "data", "n_ids"))):
                raw = id_of.value[unpack(control, data, n)].astype("<u4").tobytes()
                ends = np.concatenate(([0], np.cumsum(lens)))
                parts = [raw[4 * s:4 * e] for s, e in zip(ends, ends[1:])]
                cols = [pa.array(docs, pa.int64()), pa.array(base + ends[:-1], pa.int64()), pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_ids, schema=schema)
    return run


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    vocab = spark.read.schema("rank int, id int").parquet(f"{path}/vocab").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r.id for r in vocab], np.uint32))
    rows = spark.read.schema(_SEGMENT_SQL).parquet(f"{path}/ids")
    per_shard = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    total = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = per_shard.select("shard", F.coalesce(total, F.lit(0)).alias("before"))  # one row per shard
    placed = rows.join(F.broadcast(base), "shard").select((F.col("before") + F.col("first")).alias("base"), "doc_ids",
                                                          "lengths", "control", "data", "n_ids")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.mapInArrow(_documents(id_of, with_ids), schema)
