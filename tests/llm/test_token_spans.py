import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tokenloom.llm import token_spans as S
from tokenloom.llm.byte_bpe import load_ranks
from llm_fixtures import docs_of  # noqa: F401

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    with open(FILE, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(f.read()), special_tokens={})


def brute(lib, text, spans):
    """Byte by byte: the section of each byte, then the section with most bytes of each token."""
    raw = text.encode()
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    stretch = [0] * len(raw)          # 2 i + 1: section i; 2 i: the gap before it
    for b in range(len(raw)):
        stretch[b] = 2 * sum(at[e] <= b for _, e in spans)
        for i, (s, e) in enumerate(spans):
            if at[s] <= b < at[e]:
                stretch[b] = 2 * i + 1
    tokens, cross, pos = {}, {}, 0
    for t in lib.encode_ordinary(text):
        n = len(lib.decode_single_token_bytes(t))
        part = stretch[pos:pos + n]
        best = max(sorted(set(part)), key=lambda x: part.count(x))
        key = best // 2 if best % 2 else -1
        tokens[key] = tokens.get(key, 0) + 1
        cross[key] = cross.get(key, 0) + (len(set(part)) > 1)
        pos += n
    return tokens, cross


def test_sections_equal_brute_force(spark, lib):
    rng = random.Random(6)
    rows = []
    for d in range(60):
        text = "".join(rng.choices(["hello ", "wörld", "中文", "😀", "\n", "\n\n", "  ", "12", "ing", "."], k=rng.randint(0, 25)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=2 * rng.randint(0, 4)))
        spans = list(zip(cuts[::2], cuts[1::2]))
        rows.append((d, text, spans))
    df = spark.createDataFrame(rows, f"doc_id long, text string, parts {S.SECTION}").withColumn("section", F.lit("x"))
    got = {}
    for r in S.attribute_tokens(df, FILE, P.PATTERN, sections_col="parts").collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
    for d, text, spans in rows:
        tokens, cross = brute(lib, text, spans)
        want = {i: (tokens.get(i, 0), cross.get(i, 0)) for i in range(len(spans))}
        if tokens.get(-1) or not spans:
            want[-1] = (tokens.get(-1, 0), cross.get(-1, 0))
        assert got[d] == want, (text, spans)


def test_lines_add_up(lib, docs_of):
    texts = ["a b\nc\n\n\nlong line here", None, "", "\n", "x" * 5000 + "\n" + "word " * 40_000, "same", "same"]
    rows = list(enumerate(texts)) + [(None, "two\nlines")]
    got = S.attribute_tokens(docs_of(rows), FILE, P.PATTERN).collect()
    for d, t in rows:
        mine = [r for r in got if r.doc_id == d]
        assert sum(r.n_tokens for r in mine) == len(lib.encode_ordinary(t or ""))
        if t:
            assert [(t or "")[r.start:r.end] for r in sorted(mine, key=lambda r: r.section)] == t.splitlines(keepends=True)
        else:
            assert [(r.section, r.n_tokens) for r in mine] == [(-1, 0)]
    assert S.attribute_tokens(docs_of([]), FILE, P.PATTERN).collect() == []


def test_overlaps_are_refused(spark):
    df = spark.createDataFrame([(1, "abcdef", [(0, 4), (2, 6)])], f"doc_id long, text string, parts {S.SECTION}")
    with pytest.raises(Exception, match="must not overlap"):
        S.attribute_tokens(df, FILE, P.PATTERN, sections_col="parts").collect()


def test_ties_go_to_the_earlier_section():
    section, crossing = S.allocate(np.array([2, 4]), np.array([[0, 1], [1, 3], [3, 4]]))
    assert section.tolist() == [0, 1] and crossing.all()
