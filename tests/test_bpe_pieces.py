"""encode_bpe, pt_pack_bpe and decode_bpe learn a vocabulary of the reference's 10,000 pieces, not a few merges."""

import random

import pytest

import __spark_entry__ as E
from tokenloom.operators.bpe import train_bpe
from tokenloom.plans import queries

RNG = random.Random(3)
WORDS = sorted({"".join(RNG.choices("abcdefghij", k=RNG.randint(5, 9))) for _ in range(200)})
TEXTS = [" ".join(RNG.choices(WORDS, k=150)) for _ in range(12)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pieces"))
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(100, None, "en"), (101, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture
def asked(monkeypatch):
    """The numbers of merges that are asked for."""
    got = []

    def train(words, n_merges, **more):
        got.append(n_merges)
        return train_bpe(words, n_merges, **more)
    monkeypatch.setattr(queries, "train_bpe", train)
    monkeypatch.setattr(queries, "stage_table", lambda build, *_: build())
    return got


ROOM = 10_000 - 3 - 256 - 11      # beside specials, bytes, the word mark and ten letters


def test_decode_bpe_learns_the_whole_vocabulary(spark, folder, asked):
    got = {r["doc_id"]: r["text"] for r in E.queries()["decode_bpe"](spark, folder).collect()}
    assert got == dict(enumerate(TEXTS)) | {100: "", 101: ""}
    assert asked == [ROOM]


def test_encode_bpe_learns_the_whole_vocabulary(spark, folder, asked):
    """So few words are all pieces of their own at this size."""
    got = {r["doc_id"]: r for r in E.queries()["encode_bpe"](spark, folder).collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == dict.fromkeys(range(len(TEXTS)), 150) | {100: 0, 101: 0}
    assert len({i for r in got.values() for i in r["input_ids"].split()}) == len(WORDS)
    assert asked == [ROOM]


def test_pt_pack_bpe_learns_the_whole_vocabulary(spark, folder, asked):
    got = E.queries()["pt_pack_bpe"](spark, folder).collect()
    assert sorted((r["batch"], r["block"], r["n_tokens"]) for r in got) == [(0, n, 512) for n in range(12 * 150 // 512)]
    assert asked == [ROOM]
