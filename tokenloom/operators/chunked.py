"""Look-ups of long lists in tables: words to ids, ids to words, without a row per token in any shuffle.

Rows are dealt by their key into chunks of about ``CHUNK_BYTES``.  A chunk's distinct items are looked up (one join
of distinct items with the vocabulary table, or a step that tells an item's value by itself), come back to the chunk,
and an Arrow step puts them in the rows' places.  So what crosses a shuffle is a row's text or list, once, and
one row per distinct item of a chunk; a task holds one chunk.

Rows of one key are in one chunk.  Where rows are merged by key, their items are put in order by (place, value), as
an ordered regroup of all of the key's items would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..session import stage_dir

CHUNK_BYTES = 16 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b" \t\n\r\f")] = True     # the class of functions.text.WORD_SPLIT


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back, for rows that are made once and read more than once."""
    path = stage_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_chunks(rows: DataFrame, by: list[str], size: Column) -> DataFrame:
    """``rows`` with the chunk ``_c`` that the columns ``by`` name, so that a chunk has about CHUNK_BYTES of ``size``."""
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // CHUNK_BYTES))
    return rows.withColumn("_c", F.pmod(F.xxhash64(*by), F.lit(int(n))).cast("int"))


def whole(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """The column as one array of this type."""
    parts = [c.cast(kind) for c in column.chunks]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def split_words(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(first word of every row, all words): the words of ``functions.text.words``, none for null."""
    texts = pc.fill_null(whole(column, pa.large_string()), "")
    _, ends, data = texts.buffers()
    off = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if ends is not None and len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    blank = _SEPARATOR[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    lo, hi = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1     # a row's ends are ends of words too
    first[lo], last[hi] = ~blank[lo], ~blank[hi]
    start = np.flatnonzero(first)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - start, out=ends[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[~blank].tobytes()))
    return np.searchsorted(start, off), words


def list_items(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(first item of every row, all items) of a column of lists, none for null."""
    parts = [c for c in column.chunks if len(c)]
    size = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in parts]
    items = [c.flatten() for c in parts]
    off = np.zeros(sum(map(len, size)) + 1, np.int64)
    np.cumsum(np.concatenate(size) if size else off[1:], out=off[1:])
    return off, pa.concat_arrays(items) if items else pa.array([], column.type.value_type)


def _merged(keys: list[tuple], off: np.ndarray, codes: np.ndarray, order: Callable[[int], object]):
    """(a row of every key, first item of each, codes) with the rows of one key put together."""
    rows: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        rows.setdefault(k, []).append(i)
    if len(rows) == len(keys):
        return np.arange(len(keys)), off, codes
    parts = []
    for same in rows.values():
        if len(same) == 1:
            parts.append(codes[off[same[0]]:off[same[0] + 1]])
        else:
            mine = [(p, order(c), c) for i in same for p, c in enumerate(codes[off[i]:off[i + 1]].tolist())]
            parts.append(np.array([c for _, _, c in sorted(mine)], codes.dtype))
    size = np.array([len(p) for p in parts], np.int64)
    return np.array([s[0] for s in rows.values()]), np.concatenate([[0], np.cumsum(size)]), np.concatenate(parts)


def chunk_step(keys: list[str], items: Callable, values: Callable, schema: pa.Schema, merge: bool):
    """Arrow step over one chunk: (rows, looked-up table or None) to ``keys`` and the list made of their items' values.

    ``items`` gives (first item of every row, all items) of the column ``_items``; ``values`` takes the distinct items
    and the looked-up table and gives (order of one item, list column of (first code of every row, codes)).
    """
    def run(table: pa.Table, found: pa.Table | None = None) -> pa.Table:
        off, flat = items(table.column("_items"))
        coded = flat.dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order, build = values(coded.dictionary, found)
        cols = table.select(keys)
        if merge:
            at, off, codes = _merged(list(zip(*[c.to_pylist() for c in cols.columns])), off, codes, order)
            if len(at) < table.num_rows:
                cols = cols.take(pa.array(at))
        return pa.Table.from_arrays([*cols.columns, build(off, codes).cast(schema.types[-1])], names=schema.names)
    return run


def distinct_items(items: Callable, kind: pa.DataType):
    """Arrow step over one chunk: its distinct items."""
    def run(table: pa.Table) -> pa.Table:
        _, flat = items(table.column("_items"))
        item = pc.unique(flat).drop_null().cast(kind)
        return pa.Table.from_arrays([pa.repeat(table.column("_c")[0], len(item)), item], names=["_c", "_item"])
    return run


def out_schema(df: DataFrame, keys: list[str], out: str, kind: str) -> StructType:
    """Schema of ``keys`` and a column of this type."""
    return df.select(*keys, F.lit(None).cast(kind).alias(out)).schema


def look_up(rows: DataFrame, keys: list[str], items: Callable, table: DataFrame, values: Callable, schema: StructType,
            merge: bool) -> DataFrame:
    """``rows`` (``keys``, ``_items``, ``_c``) through ``table`` (``_item``, ``_value``): see :func:`chunk_step`."""
    item = table.schema["_item"].dataType
    one = StructType().add("_c", "integer").add("_item", item)
    distinct = rows.select("_c", "_items").groupBy("_c").applyInArrow(distinct_items(items, to_arrow_type(item)), one)
    found = distinct.join(table.withColumnRenamed("_item", "_key"), F.col("_item") == F.col("_key")).select("_c", "_item", "_value")
    step = chunk_step(keys, items, values, to_arrow_schema(schema), merge)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return step(left, right)
    return rows.groupBy("_c").cogroup(found.groupBy("_c")).applyInArrow(both, schema)


def told(rows: DataFrame, keys: list[str], items: Callable, values: Callable, schema: StructType, merge: bool) -> DataFrame:
    """The same where ``values`` tells an item's value by itself, so nothing is joined."""
    step = chunk_step(keys, items, values, to_arrow_schema(schema), merge)

    def one(table: pa.Table) -> pa.Table:
        return step(table)
    return rows.groupBy("_c").applyInArrow(one, schema)


def ragged(flat: np.ndarray, size: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first element of every row, elements) of rows whose items are stretches of ``flat``, ``size`` long each."""
    n = size[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    start = (np.cumsum(size) - size)[codes]
    return ends[off], flat[np.arange(int(ends[-1])) + np.repeat(start - ends[:-1], n)]
