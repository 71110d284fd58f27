import random
import zlib

import numpy as np
import pytest

from tokenloom.llm import language_id as L
from llm_fixtures import docs_of  # noqa: F401

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ré"], "bb": ["sch", "en", "ung", "ß", "ich"], "cc": ["the", "ing", "er", "wh", "of"]}


def text_of(lang, rng, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    return [(i, text_of(lang, rng, rng.randint(3, 80)), lang) for i in range(400) for lang in [list(SYLLABLES)[i % 3]]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, has_letter string, windows int") \
        if rows and len(rows[0]) == 6 else spark.createDataFrame([(*r, "x", "y", 1) for r in rows],
                                                                "doc_id long, text string, lang string, score string, has_letter string, windows int")


@pytest.fixture(scope="module")
def net(spark, corpus):
    return L.train(frame(spark, corpus))


def test_held_out_accuracy_and_odd_rows(spark, corpus, net):
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (None, text_of("cc", random.Random(1), 9), None),
           (903, "ich " * 60000, None), (0, corpus[0][1], "aa")]
    out = L.identify(frame(spark, corpus + odd), net).collect()
    assert len(out) == len(corpus) + len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    truth = {i: lang for i, _, lang in corpus}
    test = [by[i][0] for i in truth if held_out(i)]
    assert test and all(r.held_out for r in test)
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in out)
    assert [(by[i][0].lang_pred, by[i][0].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[None][0].lang_pred == "cc" and not by[None][0].held_out and by[903][0].lang_pred == "bb"
    assert by[0][0][2:] == by[0][1][2:]


def test_held_out_rows_and_their_languages_teach_nothing(spark, corpus, net):
    changed = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in corpus]
    other = L.train(frame(spark, changed))
    assert other.classes == net.classes and all(np.array_equal(other.p[k], net.p[k]) for k in net.p)


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (2, None, "aa")]
    assert L.train(frame(spark, rows)) is None
    out = L.identify(frame(spark, rows), None).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in out} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert L.identify(frame(spark, []), None).collect() == [] and L.train(frame(spark, [])) is None
    one = L.train(frame(spark, [(1, "alpha beta", "aa"), (3, "gamma delta", "aa"), (4, "epsilon", "aa"), (5, "zeta", "aa")]))
    assert {(r.lang_pred, r.score) for r in L.identify(frame(spark, [(1, "word", None)]), one).collect()} == {("aa", 1.0)}


def test_tables_equal_the_convolution(net):
    """Pair look-ups give the same probabilities as convolutions written out."""
    rng = np.random.default_rng(1)
    windows = np.zeros((7, L.WINDOW + L._REACH - 1), np.uint8)
    windows[:, :L.WINDOW] = rng.integers(0, 256, (7, L.WINDOW))
    got = net.scorer().probabilities(windows)
    for row, p in zip(windows, got):
        emb = net.p["emb"][row]
        conv = np.array([sum(emb[i + k] @ net.p["conv"][k] for k in range(L._REACH)) for i in range(L.WINDOW)])
        logits = np.maximum(conv.max(axis=0) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
        want = np.exp(logits - logits.max())
        assert np.allclose(p, want / want.sum(), atol=1e-4)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    net = L.ByteNet(["a", "b", "c"])
    x = np.zeros((6, L.WINDOW + L._REACH - 1), np.uint8)
    x[:, :L.WINDOW] = rng.integers(97, 105, (6, L.WINDOW))
    y, w = rng.integers(0, 3, 6), np.ones(6)

    def loss():
        tables = [net.p["emb"] @ net.p["conv"][k] for k in range(L._REACH)]
        conv = sum(t[x[:, k:k + L.WINDOW]] for k, t in enumerate(tables))
        logits = np.maximum(conv.max(axis=1) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
        top = logits.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(6), y]))
    grad = net._gradient(x, y, w)
    for name, at in (("emb", (100, 2)), ("conv", (1, 3, 20)), ("bias", (5,)), ("out", (9, 1)), ("out_bias", (2,))):
        eps, old = 1e-5, net.p[name][at]
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at]))


def test_windows_tile_a_text():
    for n in (0, 1, 127, 128, 129, 256, 1000):
        starts = L.tiles(n)
        seen = np.zeros(n, int)
        for s in starts:
            seen[s:s + L.WINDOW] += 1
        assert (seen >= 1).all() and len(starts) == -(-n // L.WINDOW)
