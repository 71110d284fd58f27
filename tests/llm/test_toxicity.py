import random
import zlib
from bisect import bisect_left, bisect_right

import numpy as np

from tokenloom.llm import toxicity as T
from llm_fixtures import docs_of  # noqa: F401

CALM = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("bar", "den", "fol", "gim", "hus", "jat", "")]
SLUR = "grumpf"      # not in the built-in lexicon: must be learned, in compounds too


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        words = rng.choices(CALM, k=rng.randint(20, 120))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", SLUR, SLUR + rng.choice(CALM), "you", "stupid"])
        docs.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    return docs, labels


def auc(rows):
    pos, neg = [s for s, y in rows if y], sorted(s for s, y in rows if not y)
    return sum((bisect_left(neg, s) + bisect_right(neg, s)) / 2 for s in pos) / (len(pos) * len(neg))


def test_held_out_accuracy(spark, docs_of, monkeypatch):
    monkeypatch.setattr(T, "TREES", 6)
    docs, labels = corpus(600, 3)
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    given = [(d, (1 - y) if d in held else y) for d, y in labels]       # held-out labels must not be read: they lie
    given += [(None, 1), (5, None), (10**6, 1)]
    rows = docs + [(700, None), (701, ""), (None, "idiot"), (702, "calm " * 100_000), (702, "calm " * 100_000)]
    got = T.score_toxicity(docs_of(rows), spark.createDataFrame(given, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id for r in got if r.held_out} == held | {d for d in (700, 701, 702) if zlib.crc32(str(d).encode()) % 4 == 2}
    true = dict(labels)
    assert auc([(r.score, true[r.doc_id]) for r in got if r.doc_id in held]) > 0.95


def test_without_both_labels_all_scores_are_zero(spark, docs_of):
    docs, _ = corpus(10, 1)
    for given in ([], [(d, 0) for d in range(10)]):
        labels = spark.createDataFrame(given, "doc_id long, toxic int")
        assert {(r.score, r.predicted) for r in T.score_toxicity(docs_of(docs), labels).collect()} == {(0.0, 0)}
    assert T.score_toxicity(docs_of([]), labels).collect() == []


def test_features_do_not_depend_on_the_batch():
    docs, _ = corpus(40, 8)
    texts = [t for _, t in docs] + ["", "ALL CAPS!! YOU IDIOT", "st0p 1diot y0u", "soooo b4d", "İstanbul ẞ ŉ", "one\ntwo\n"]
    lex = (np.zeros(0, np.uint64), np.zeros(0))
    whole = T.features(texts, lex, lex)
    assert whole.shape == (len(texts), len(T.FEATURES)) and np.isfinite(whole).all()
    assert np.array_equal(whole, np.concatenate([T.features([t], lex, lex) for t in texts]))
    names = list(T.FEATURES)
    assert whole[41][names.index("near_second")] > 0 and whole[42][names.index("hidden_hits")] > 0
