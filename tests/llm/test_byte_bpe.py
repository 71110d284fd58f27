import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tokenloom.llm import byte_bpe as B
from tokenloom.llm import textnum as tn
from llm_fixtures import docs_of  # noqa: F401

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    with open(FILE, "rb") as f:
        ranks = B.load_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_pattern():
    rng = random.Random(3)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "٣", "5", "½", "!", "$", "中", "😀", "\x1c", "'s"]
    for _ in range(5000):
        ts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3)]
        points, offsets = tn.code_points(ts)
        want = [offsets[i] + m.start() for i, t in enumerate(ts) for m in regex.finditer(P.PATTERN, t)]
        assert B.piece_starts(points, offsets).tolist() == want, ts


def test_long_words_merge_alike(lib):
    ranks, enc = lib
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choices(["a", "e", "in", "ing", "é", "#", "=", "1"], k=rng.randint(1, 90))).encode()
        assert w in ranks or B.merge_long(w, ranks) == enc._encode_single_piece(w)


def test_perfect_table(lib):
    pairs = B.pair_ranks(lib[0])
    table, shift = B.perfect_table(pairs)
    assert all(table[(k + shift[k % len(shift)]) % len(table)] == k * 65536 + r for k, r in pairs.items())
    assert sum(x != 1 << 50 for x in table) == len(pairs)


def test_shifted_table(lib):
    """Two reads give every pair's rank, and for any other pair a number that is neither a rank nor a symbol of the state."""
    pairs = B.pair_ranks(lib[0])
    table = B.shifted_table(pairs)

    def ranks(a, b):
        return table[table[a + 65536] + b + 65536] ^ (a + 65536 << 17)
    keys = np.array(list(pairs))
    assert (ranks(keys >> 16, keys & 65535) == list(pairs.values())).all()
    rng = np.random.default_rng(4)
    some = rng.integers(0, 1 << 32, 200_000)
    some = np.append(some[~np.isin(some, keys)], [65535, 65535 << 16, (1 << 32) - 1])
    assert (ranks(some >> 16, some & 65535) >= 131072).all()


def test_fold_from_first_states(lib, spark):
    """The fold starts from states that hold the ranks of byte pairs; words of 0 to 64 bytes, and rows without a word."""
    import pyarrow as pa
    ranks, enc = lib
    rng = random.Random(8)
    words = ["".join(rng.choices(["a", "b", "e", "in", "ing", "the", "é", "中", "#", "1"], k=rng.randint(1, 30))).encode()[:64] for _ in range(400)]
    words += [b"a", b"ab", b"abab", b"\xff\x00"]
    symbols, size = B.byte_symbols(words, ranks)
    column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(symbols))
    states = B.fold_states(column.slice(5), ranks)
    assert states.to_pylist() == B.fold_states(column, ranks).to_pylist()[5:]
    assert [s[::2] for s in states.to_pylist()] == [[x + 65536 for x in w] for w in column.to_pylist()[5:]]
    rows = [(i, s) for i, s in enumerate(states.to_pylist(), 5)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, state array<bigint>")
    got = {r.i: r.ids for r in df.select("i", B.fold_merges(df.state, ranks).alias("ids")).collect()}
    assert got.pop(-1) is None
    assert got == {i: enc._encode_single_piece(w) for i, w in enumerate(words) if i >= 5}


def test_rows_equal_the_library(lib, docs_of):
    ranks, enc = lib
    texts = [None, "", "Hello, world! It's 2024.\n\n  Größe déjà-vu  ", "#" * 5000 + " " + "ab" * 700, "<|endoftext|> don't 中文 😀\t\r\n x",
             "The the the", "The the the", "word " * 20000]
    rows = list(enumerate(texts)) + [(None, "no id")]
    got = {r.doc_id: r for r in B.encode_bytes(docs_of(rows), FILE, with_ids=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        r = got[i]
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), ids.tobytes())
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode_bytes(docs_of([]), FILE).collect() == []


@pytest.mark.parametrize("with_head", [False, True])
def test_small_chunks_give_the_same(lib, monkeypatch, with_head):
    """Many chunks per task: batches then hold the end of one chunk and the start of the next."""
    ranks, enc = lib
    with open(FILE, "rb") as f:
        data = f.read()

    class Shipped:
        value = data
    import pyarrow as pa
    monkeypatch.setattr(B, "CHUNK_WORDS", 5)
    texts = [f"alpha{i} beta {i} gamma" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(B, "SLICE", 50)
    monkeypatch.setattr(B, "WORDS_AT_ONCE", 3)
    parts = [b for lo in range(40) for b in [batch.slice(lo, 1)]]

    class Top:
        """A head of a few words, some of them everywhere."""
        words = [" beta", "alpha", " gamma", "nowhere"]
        points, offsets = tn.code_points(words)
        known = [enc._encode_single_piece(w.encode()) for w in words]
        value = B.Head(tn.span_hash(tn.point_prefix(points), offsets[:-1], offsets[1:]), np.concatenate(known).astype(np.uint32),
                       np.array([len(k) for k in known])) if with_head else B.NO_HEAD
    rows = pa.Table.from_batches(list(B._split(Shipped, Top)(iter(parts))))
    ids = []
    for word, known in zip(rows["word"].to_pylist(), rows["known"].to_pylist()):
        ids.append(known if known is not None else None if word is None else enc._encode_single_piece(enc.decode_bytes(word[1:-1])))
    table = pa.table({"kind": rows["kind"], "chunk": rows["chunk"], "doc_id": rows["doc_id"], "ids": pa.array(ids, pa.list_(pa.int64())), "refs": rows["refs"]})
    for size in (1, 7, 1000):
        out = pa.Table.from_batches(list(B._assemble(Shipped, Top, True)(iter(table.combine_chunks().to_batches(max_chunksize=size)))))
        assert [np.frombuffer(x, "<u4").tolist() for x in out["ids"].to_pylist()] == [enc.encode_ordinary(t) for t in texts]


def test_a_long_text_is_cut_at_borders_of_pieces(lib, docs_of, monkeypatch):
    ranks, enc = lib
    rng = random.Random(9)
    bits = ["word", "'s", "'ll", " ", "  ", "\n", "\t", "é中", "12", "!!", "\x1c", "\x85", "\u2009", "no"]
    for _ in range(300):
        t = "".join(rng.choices(bits, k=rng.randint(0, 60)))
        parts = B.cut_text(t, 12)
        assert "".join(parts) == t
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    monkeypatch.setattr(B, "SLICE", 40)
    monkeypatch.setattr(B, "CHUNK_WORDS", 5)
    long = " ".join(f"item{i} isn't  {i}" for i in range(400))
    got = B.encode_bytes(docs_of([(1, long), (2, "x" * 500), (3, "short")]).coalesce(1), FILE, with_ids=True).collect()
    want = {1: long, 2: "x" * 500, 3: "short"}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: enc.encode_ordinary(t) for i, t in want.items()}


def test_places_and_ids_grow():
    rng = np.random.default_rng(2)
    words, ids = B.Words(), B.Ids()
    known = {}
    for _ in range(20):
        h = np.setdiff1d(np.unique(rng.integers(0, 1 << 20, 50).astype(np.uint64)), words.hashes)
        for key, place in zip(h.tolist(), words.add(h).tolist()):
            known[key] = place
        length = rng.integers(0, 5, len(h))
        ids.add(rng.integers(0, 9, int(length.sum())).astype(np.uint32), length)
    assert sorted(known.values()) == list(range(len(words))) and ids.n == len(words)
    assert words.find(np.array(list(known), np.uint64)).tolist() == list(known.values())
    assert words.find(np.array([1 << 30], np.uint64)).tolist() == [-1]
    assert ids.of(np.array([3, 0])).tolist() == [*ids.flat[ids.start[3]:ids.start[3] + ids.length[3]], *ids.flat[:ids.length[0]]]
    assert ids.start[:ids.n].tolist() == (np.cumsum(ids.length[:ids.n]) - ids.length[:ids.n]).tolist()
