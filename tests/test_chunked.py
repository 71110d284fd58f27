"""Encoding, packing and decoding move texts, lists and distinct words, never a row per token."""

import re

import pyarrow as pa
import pytest

from conftest import lid
from tokenloom.operators import chunked
from tokenloom.operators.bpe import Subwords, bpe_vocabulary
from tokenloom.operators.encode import decode_ids, encode_texts
from tokenloom.operators.pack import pack_text

TEXTS = ["a b c", "", None, " \t a b  c\r\n", "\x0ba \x0c b", "é a 名 b", "\n", "zz a"]
DOCS = [(1, "a b c"), (1, "c a"), (1, None), (2, ""), (None, "b zz"), (None, "a"), (3, "d e\tf")]


def _subwords(spark):
    merges = [("▁", "a", 3), ("z", "z", 2)]
    return Subwords.of(bpe_vocabulary(spark, merges, ["▁", *"abcdef"]), merges)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_words_is_the_word_rule():
    column = pa.chunked_array([pa.array(TEXTS[:3]), pa.array(TEXTS).slice(3), pa.array([], pa.string())])
    off, words = chunked.split_words(column)
    got = [words.slice(i, j - i).to_pylist() for i, j in zip(off, off[1:])]
    assert got == [[w for w in re.split("[ \t\n\r\f]+", t or "") if w] for t in TEXTS]
    off, words = chunked.split_words(pa.chunked_array([], pa.string()))
    assert off.tolist() == [0] and len(words) == 0


@pytest.mark.parametrize("subwords", [False, True])
def test_no_row_per_token_in_plans(spark, letters_vocab, subwords):
    vocab = _subwords(spark) if subwords else letters_vocab
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "ordinal long, text string")
    enc = encode_texts(docs, ["ordinal"], "text", vocab)
    for df in (enc, pack_text(docs, "ordinal", "text", vocab, 4, 4).select("batch", "input_ids"), decode_ids(enc, ["ordinal"], "input_ids", vocab)):
        assert "posexplode" not in _plan(df), _plan(df)


def test_rows_of_one_key_are_merged_by_place_then_id(spark, letters_vocab, monkeypatch):
    monkeypatch.setattr(chunked, "CHUNK_BYTES", 4)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r["doc_id"]: r["input_ids"] for r in encode_texts(docs, ["doc_id"], "text", letters_vocab).collect()}
    a, b, c, d, e, f = map(lid, "abcdef")
    assert got == {1: [a, c, a, b, c], 2: [], None: [a, b, 0], 3: [d, e, f]}


def test_subwords_of_one_key_and_back(spark, monkeypatch):
    monkeypatch.setattr(chunked, "CHUNK_BYTES", 4)
    sub = _subwords(spark)
    docs = spark.createDataFrame(DOCS + [(4, "é 名a")], "doc_id long, text string")
    enc = encode_texts(docs, ["doc_id"], "text", sub)
    back = {r["doc_id"]: r["text"] for r in decode_ids(enc, ["doc_id"], "input_ids", sub).collect()}
    assert back[2] == "" and back[3] == "d e f" and back[4] == "é 名a"
    assert sorted(back[1].split()) == ["a", "a", "b", "c", "c"] and sorted(back[None].split()) == ["a", "b", "zz"]


def test_decode_merges_keys_and_unknown_ids(spark, letters_vocab):
    rows = [(1, [lid("b"), lid("c")]), (1, [lid("a")]), (2, [None, 999, lid("z")]), (None, None), (3, [])]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    got = {r["k"]: r["text"] for r in decode_ids(df, ["k"], "ids", letters_vocab).collect()}
    assert got == {1: "a b c", 2: "  z", None: "", 3: ""}


def test_packed_rows_of_one_ordinal_stay_apart(spark, letters_vocab):
    rows = spark.createDataFrame([(0, "a b"), (0, "a b"), (1, "c")], "ordinal long, text string")
    got = [r["input_ids"] for r in pack_text(rows, "ordinal", "text", letters_vocab, 5, 1000).collect()]
    assert got == [[lid(x) for x in "ababc"]]
