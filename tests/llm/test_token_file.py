import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tokenloom.llm import token_file as T
from tokenloom.session import stage_dir
from llm_fixtures import docs_of  # noqa: F401

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    with open(FILE, encoding="utf-8") as f:
        return T.Encoder(f.read())


def test_coding_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 5, 999):
        v = np.array([rng.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5]) for _ in range(n)], np.uint32)
        control, data = T.pack(v)
        assert len(control) == -(-n // 4) and (T.unpack(control, data, n) == v).all()


def test_every_covered_character_equals_the_library(enc):
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    texts = [f"ab{c}cd {c} {c}{c}1" for c in chars]
    assert enc.plain(texts).sum() == len(chars) - 1
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == enc.lib.encode(t, add_special_tokens=False).ids, t


def test_random_texts_equal_the_library(enc):
    rng = random.Random(4)
    bits = ["'", "s", "t", "re", "VE", "ll", "d", "m", " ", "\n", "a", "Z", "é", "٣", "5", "½", "!", "ª", "中", "😀", "'s", "x", "İ",
            "é", "<|endoftext|>", "<|"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert enc.encode([t, "x y", t])[2].tolist() == enc.lib.encode(t, add_special_tokens=False).ids, t


def test_a_full_cache_changes_nothing(enc, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    for t in ("one two three four", "five one six", "two two seven"):
        assert enc.encode([t])[0].tolist() == enc.lib.encode(t, add_special_tokens=False).ids


def test_files(spark, enc, docs_of, monkeypatch):
    texts = {7: "Hello there, it's 5 o'clock.", 3: None, 9: "", 1: "x " * 5000, 4: "Hello there", 12: "same", 11: "same"}
    rows = list(texts.items()) + [(None, "no id"), (4, "repeated id")]
    path = stage_dir(spark, "t")
    T.write_token_file(docs_of(rows), FILE, path)
    got = sorted(T.read_token_file(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([d for d, _ in rows], key=lambda x: -1 if x is None else x)
    start = 0
    want = {d: [enc.lib.encode(t or "", add_special_tokens=False).ids + [2] for e, t in rows if e == d] for d, _ in rows}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.start == start and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()
    from collections import Counter
    count = Counter(i for v in want.values() for ids in v for i in ids)
    assert [r.id for r in vocab] == [i for i, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    empty = stage_dir(spark, "t")
    T.write_token_file(docs_of([]), FILE, empty)
    assert T.read_token_file(spark, empty).collect() == []
