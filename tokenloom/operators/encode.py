"""K1 / K3 / K4: text -> ids and ids -> text against a vocabulary table.

Both go through ``chunked``: the distinct words (or ids) of a chunk of rows are joined with the vocabulary (broadcast
only if its counted size allows, else a sort-merge join) and put in the rows' places; a learned-BPE tokenizer's pieces
are bounded, so its words are merged and its ids spelt in the chunk.  Unknown words become ``unk``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE_INDEX
from ..functions.text import words
from . import chunked, merge_segments
from .bpe import WORD_MARK, Subwords, _encoder
from .vocab import Vocabulary


def explode_words(df: DataFrame, keys: list[str], text: Column | str) -> DataFrame:
    """One row per word: ``keys + (_pos, _tok)``."""
    return df.select(*keys, F.posexplode(words(text)).alias("_pos", "_tok"))


def lookup_tokens(tokens: DataFrame, vocab: Vocabulary, tok_col: str = "_tok", out: str = "_id") -> DataFrame:
    """Attach the vocabulary id of ``tok_col`` (unk when absent)."""
    v = vocab.lookup().withColumnRenamed("token", "_vtok").withColumnRenamed("id", "_vid")
    j = tokens.join(v, tokens[tok_col] == F.col("_vtok"), "left")
    unk = F.lit(vocab.unk_id if vocab.unk_id is not None else 0)
    return j.withColumn(out, F.coalesce(F.col("_vid"), unk).cast("int")).drop("_vtok", "_vid")


def lookup_ids(tokens: DataFrame, vocab: Vocabulary, tok_col: str = "_tok", out: str = "_ids") -> DataFrame:
    """Attach the ids of ``tok_col`` as an array: one id for a whole-word vocabulary, the pieces of the
    word for :class:`~.bpe.Subwords` (each distinct word of ``tokens`` is merged once, then joined back;
    the size of the word table is known when the join runs, so AQE picks its form)."""
    if not isinstance(vocab, Subwords):
        return lookup_tokens(tokens, vocab, tok_col, "_one").withColumn(out, F.array("_one")).drop("_one")
    distinct = tokens.select(F.col(tok_col).alias("_word")).where(F.col("_word").isNotNull()).distinct()
    words_ = vocab.encode_words(distinct, "_word").withColumnRenamed("_ids", out)
    return tokens.join(words_, tokens[tok_col] == F.col("_word"), "left").drop("_word")


WORDS_AT_ONCE = 100_000     # words that are merged together


def _word_ids(unk: int):
    """Items' values: the id of each word, ``unk`` for words that were not found."""
    def values(words: pa.Array, found: pa.Table):
        at = pc.index_in(words, value_set=chunked.whole(found.column("_item"), words.type)).to_numpy(zero_copy_only=False)
        known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
        ids = np.full(len(words), unk, np.int32)
        ids[known] = found.column("_value").to_numpy()[at[known].astype(np.int64)]
        return ids.__getitem__, lambda off, codes: pa.LargeListArray.from_arrays(pa.array(off), pa.array(ids[codes]))
    return values


def _in_order(merges: list[tuple]) -> bool:
    """Whether every merge's symbols are made, once, by earlier merges or are characters: so it is for a learned list."""
    made: set[str] = set()
    for a, b, _ in merges:
        if any(len(s) > 1 and s not in made for s in (a, b)) or a + b in made:
            return False
        made.add(a + b)
    return True


def _words_merger(merges: list[tuple], vocab_rows: list[tuple]):
    """Function of a list of words: (ids, ids per word), the words merged all at once.

    The same as ``bpe._encoder`` word by word.  Symbols are numbers: a character's code point, after them the merged pieces.
    """
    chars = 0x110000
    numbers = {a + b: chars + i for i, (a, b, _) in enumerate(merges)}
    number = lambda s: ord(s) if len(s) == 1 else numbers[s]
    how = merge_segments.ranked([(number(a), number(b), numbers[a + b]) for a, b, _ in merges]) if merges else ()
    names = list(numbers)
    ids = {tok: i for i, tok in vocab_rows}
    byte_id = [ids[f"<0x{b:02X}>"] for b in range(256)]

    def piece(symbol: int) -> list[int]:
        s = chr(symbol) if symbol < chars else names[symbol - chars]
        return [ids[s]] if s in ids else [byte_id[b] for b in s.encode("utf-8")]

    def merged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sym = np.frombuffer("".join(WORD_MARK + w for w in words).encode("utf-32-le"), np.int32)
        size = np.array([len(w) + 1 for w in words], np.int32)
        if how:
            sym, size = merge_segments.merge_words(sym, size, *how)
        found, code = np.unique(sym, return_inverse=True)
        pieces = [piece(x) for x in found.tolist()]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends, flat = chunked.ragged(np.array([i for p in pieces for i in p], np.int32), np.array([len(p) for p in pieces], np.int64), ends, code)
        return flat, np.diff(ends)
    return merged


def _word_pieces(merges: list[tuple], vocab_rows: list[tuple]):
    """Items' values: the ids of the pieces of each word."""
    in_order = _in_order(merges)
    made: list = []         # the encoder, made once a task

    def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not made:
            made.append((_words_merger if in_order else _encoder)(merges, vocab_rows))
        if in_order:
            return made[0](words)
        pieces = [made[0](w) for w in words]
        return np.array([i for p in pieces for i in p], np.int32), np.array([len(p) for p in pieces], np.int64)

    def values(words: pa.Array, found):
        parts = [encoded(words.slice(lo, WORDS_AT_ONCE).to_pylist()) for lo in range(0, len(words), WORDS_AT_ONCE)]
        flat, size = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int32, np.int64)))
        start = np.cumsum(size) - size

        def build(off, codes):
            ends, ids = chunked.ragged(flat, size, off, codes)
            return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))
        return (lambda c: flat[start[c]:start[c] + size[c]].tolist()), build
    return values


def encode_rows(df: DataFrame, keys: list[str], text_col: str, vocab: Vocabulary, out: str = "input_ids",
                merge: bool = False) -> DataFrame:
    """``keys + out array<int>``, a row per row: ids of the words of ``text_col``, no special tokens.

    Rows without a word get an empty array.  With ``merge`` rows of the same keys become one, their words in order of
    place, then id.
    """
    rows = df.select(*keys, F.col(text_col).alias("_items"))
    # rows of one key stay together only where they must: a key may be null, or the same, in very many rows
    rows = chunked.in_chunks(rows, keys if merge else [*keys, "_items"], F.octet_length("_items"))
    schema = chunked.out_schema(df, keys, out, "array<int>")
    if isinstance(vocab, Subwords):
        pieces = [(r["id"], r["token"]) for r in vocab.table.select("id", "token").collect()]   # merges and alphabet
        return chunked.told(rows, keys, chunked.split_words, _word_pieces(vocab.merges, pieces), schema, merge)
    unk = vocab.unk_id if vocab.unk_id is not None else 0
    table = vocab.lookup().select(F.col("token").alias("_item"), F.col("id").cast("int").alias("_value"))
    return chunked.look_up(rows, keys, chunked.split_words, table, _word_ids(unk), schema, merge)


def encode_texts(df: DataFrame, keys: list[str], text_col: str, vocab: Vocabulary,
                 out: str = "input_ids") -> DataFrame:
    """``keys + out array<int>``: ids of the words of ``text_col``, no special tokens, one row per distinct keys.

    Rows whose text has no word end with an empty array (kept, not dropped).
    """
    return encode_rows(df, keys, text_col, vocab, out, merge=True)


def _id_items(pad: int):
    def items(column: pa.ChunkedArray):
        off, ids = chunked.list_items(column)
        return off, pc.if_else(pc.equal(ids, IGNORE_INDEX), pa.scalar(pad, ids.type), ids)
    return items


def _id_tokens(sep: str):
    """Items' values: the token of each id, '' for ids that were not found."""
    def values(ids: pa.Array, found: pa.Table):
        tokens = chunked.whole(found.column("_value"), pa.large_string())
        at = pc.index_in(ids, value_set=chunked.whole(found.column("_item"), ids.type), skip_nulls=True)
        tokens = pc.fill_null(tokens.take(at), "")

        def build(off, codes):
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off), tokens.take(pa.array(codes))), pa.scalar(sep, pa.large_string()))
        return (lambda c: tokens[c].as_py()), build
    return values


def _id_bytes(vocab_rows: list[tuple]):
    """Items' values: the bytes that each id's piece stands for, none for ids that were not found."""
    def spelt(token: str) -> bytes:
        return bytes([int(token[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", token) else token.encode()
    piece = {i: spelt(t) for i, t in vocab_rows}

    def values(ids: pa.Array, found):
        mine = [piece.get(i, b"") for i in ids.to_pylist()]
        flat, size = np.frombuffer(b"".join(mine), np.uint8), np.array([len(p) for p in mine], np.int64)

        def build(off, codes):
            ends, data = chunked.ragged(flat, size, off, codes)
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        return mine.__getitem__, build
    return values


def decode_ids(df: DataFrame, keys: list[str], ids_col: str, vocab: Vocabulary,
               out: str = "text", sep: str = " ") -> DataFrame:
    """K3: ids -> tokens joined by ``sep``; ``IGNORE_INDEX`` shows as the pad token.

    A row with an empty or null id list is kept, with an empty text.  With ``Subwords`` the pieces
    are put together to words: byte pieces become bytes again, word marks become spaces.
    """
    items = _id_items(vocab.pad_id if vocab.pad_id is not None else 0)
    rows = df.select(*keys, F.col(ids_col).cast("array<int>").alias("_items"))
    # ids are read twice, or more: what made them (an encoding) is not done again
    rows = chunked.in_chunks(chunked.stored(rows, "ids"), keys, 8 * F.greatest(F.size("_items"), F.lit(0)))
    if isinstance(vocab, Subwords):
        pieces = [(r["id"], r["token"]) for r in vocab.table.select("id", "token").collect()]   # merges and alphabet
        got = chunked.told(rows, keys, items, _id_bytes(pieces), chunked.out_schema(df, keys, "_bytes", "binary"), True)
        whole = F.decode("_bytes", "UTF-8")
        return got.select(*keys, F.ltrim(F.replace(whole, F.lit(WORD_MARK), F.lit(" "))).alias(out))
    table = vocab.by_id().select(F.col("id").cast("int").alias("_item"), F.col("token").alias("_value"))
    return chunked.look_up(rows, keys, items, table, _id_tokens(sep), chunked.out_schema(df, keys, out, "string"), True)
