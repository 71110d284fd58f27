"""Vocabulary tables and embedding micro-fixtures."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.embeddings import mean_rows, resize_long, with_fallback_mean
from tokenloom.operators.vocab import (Vocabulary, char_coverage, check_subset, merge_vocab, remap_ids,
                                       vocab_from_counts, word_counts)


def _vocab(spark, tokens):
    rows = [(i, t, 0.0) for i, t in enumerate(tokens)]
    return Vocabulary(spark.createDataFrame(rows, "id int, token string, score float"), len(rows), None, None, None)


def test_vocab_merge(spark):
    merged = merge_vocab(_vocab(spark, ["a", "b", "c"]), _vocab(spark, ["c", "d", "a", "e"]))
    rows = sorted((r["id"], r["token"], r["score"]) for r in merged.table.collect())
    assert [(i, t) for i, t, _ in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert rows[3][2] == 0.0 and rows[4][2] == 0.0
    assert merged.size == 5


def test_subset_check_names_missing(spark):
    with pytest.raises(ValueError, match="'x' of the new vocabulary is missing"):
        check_subset(_vocab(spark, ["a", "x"]), _vocab(spark, ["a", "b"]))
    check_subset(_vocab(spark, ["b"]), _vocab(spark, ["a", "b"]))


def test_remap(spark):
    m = remap_ids(_vocab(spark, ["c", "a"]), _vocab(spark, ["a", "b", "c"]))
    assert sorted((r["new_id"], r["old_id"]) for r in m.collect()) == [(0, 2), (1, 0)]


def test_vocab_ids_dense_and_ordered(spark):
    counts = spark.createDataFrame([("x", 3), ("y", 5), ("z", 3), ("<s>", 9)], "token string, count long")
    v = vocab_from_counts(counts)
    rows = sorted((r["id"], r["token"]) for r in v.table.collect())
    assert rows == [(0, "<unk>"), (1, "<s>"), (2, "</s>"), (3, "y"), (4, "x"), (5, "z")]


def test_word_counts(spark):
    df = spark.createDataFrame([(" a  b\n",), ("a\tc",)], "text string")
    got = {r["token"]: r["count"] for r in word_counts(df).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_char_coverage(spark):
    df = spark.createDataFrame([("aaaa bbb c",)], "text string")
    got = {r["ch"]: r["kept"] for r in char_coverage(df, 0.7).collect()}
    # a: 4/8 before 0 -> kept, b: before 4/8 < 0.7 -> kept, c: before 7/8 -> dropped
    assert got == {"a": 1, "b": 1, "c": 0}


def test_mean_rows(spark):
    emb = spark.createDataFrame([(0, [1.0, 3.0]), (1, [3.0, 5.0])], "id int, vec array<float>")
    mem = spark.createDataFrame([(10, 0), (10, 1)], "new_id int, old_id int")
    r = mean_rows(mem, emb).collect()[0]
    assert r["id"] == 10 and list(r["vec"]) == [2.0, 4.0]
    # a new id with no member rows gets the table mean (deliberate departure)
    ids = spark.createDataFrame([(10,), (11,)], "new_id int")
    got = {(x["id"], x["dim"]): x["value"] for x in with_fallback_mean(mem.where("old_id < 0"), emb, ids).collect()}
    assert got[(11, 0)] == 2.0 and got[(11, 1)] == 4.0


def test_new_special_token_row(spark):
    emb = spark.createDataFrame([(0, [0.0, 2.0]), (1, [2.0, 4.0])], "id int, vec array<float>")
    got = {(r["id"], r["dim"]): r["value"] for r in resize_long(emb).collect()}
    assert got[(2, 0)] == 1.0 and got[(2, 1)] == 3.0


def test_gather_reports_missing_rows(spark):
    from tokenloom.operators.embeddings import gather_rows, missing_rows
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, vec array<float>")
    good = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "new_id int, old_id int")
    assert {r["id"]: list(r["vec"]) for r in gather_rows(good, emb).collect()} == {0: [3, 4], 1: [1, 2], 2: [3, 4]}
    bad = spark.createDataFrame([(0, 0), (1, 9)], "new_id int, old_id int")
    assert [r["id"] for r in missing_rows(bad, emb).collect()] == [9]
    with pytest.raises(Exception, match="no embedding row for id 9"):
        gather_rows(bad, emb).collect()
