"""Language identification by a byte convolutional network trained here in numpy.

The network reads a window of ``WINDOW`` bytes: an embedding per byte, convolutions of several widths, the maximum of every
filter over the window, a rectifier and a softmax over the languages.  It is fitted on the driver on windows of a bounded
sample of labelled texts (``PER_LANGUAGE`` texts of every language, ``TRAIN_DOCS`` in all, ``TRAIN_WINDOWS`` windows
a text), picked by the hash of the id.

Texts are scored whole, in batches of windows that tile their UTF-8 bytes (the last window ends with the text).  As the
input is bytes, a filter is a sum of one number per offset and byte value; offsets are joined in pairs, so a
convolution is two table look-ups a position.  A text's probabilities are the mean of its windows' softmax, weighted
by the letters (ASCII letters and bytes over 127) in a window.

Defined results: a null text or one without a letter gives ``und`` and score 0, as does every text when nothing could be
learned; a null id is neither held out nor learned from; with one language only, the score is 1; every input row
gives one row; extra columns are ignored; ties go to the language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import textnum as tn

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16               # of every width
EMBEDDING = 8
PER_LANGUAGE = 1_500       # labelled texts of a language in the sample, about
TRAIN_DOCS = 12_000        # labelled texts in the sample, at most
TRAIN_WINDOWS = 3          # windows of a sampled text, at most
EPOCHS = 5
BATCH = 128
STEP = 3e-3
WINDOWS_AT_ONCE = 32       # positions * filters floats that stay in a core's cache
_REACH = max(WIDTHS)
_ALL = FILTERS * len(WIDTHS)


def tiles(size: int) -> np.ndarray:
    """Starts of the windows of a text of ``size`` bytes; the last one ends with the text."""
    if size <= WINDOW:
        return np.zeros(min(size, 1), np.int64)
    starts = np.arange(0, size - WINDOW + 1, WINDOW, dtype=np.int64)
    return starts if starts[-1] + WINDOW == size else np.append(starts, size - WINDOW)


def cut_windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of WINDOW bytes and the zeros that the widest filter reads past the end."""
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < end[:, None]
    out = np.zeros((len(start), WINDOW + _REACH - 1), np.uint8)
    out[:, :WINDOW] = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else 0
    return out


class ByteNet:
    """Parameters, fitting and scoring of the network."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = len(classes)
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBEDDING)), "bias": np.zeros(_ALL),
                  "out": rng.normal(0, 0.1, (_ALL, n)), "out_bias": np.zeros(n)}
        # one block of filters per width; an offset beyond a filter's width is kept at zero
        conv = np.zeros((_REACH, EMBEDDING, _ALL))
        self.mask = np.zeros((_REACH, 1, _ALL))
        for i, w in enumerate(WIDTHS):
            f = slice(i * FILTERS, (i + 1) * FILTERS)
            conv[:w, :, f] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
            self.mask[:w, :, f] = 1
        self.p["conv"] = conv

    def tables(self) -> list[np.ndarray]:
        """For every offset, what each byte value adds to each filter."""
        return [(self.p["emb"] @ self.p["conv"][k]).astype(np.float32) for k in range(_REACH)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> "ByteNet":
        """Adam on the mean cross entropy; languages weigh alike."""
        rng = np.random.default_rng(seed)
        n_classes = len(self.classes)
        weight = (len(labels) / (n_classes * np.maximum(np.bincount(labels, minlength=n_classes), 1)))[labels]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        total = epochs * -(-len(windows) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo:lo + BATCH]
                grad = self._gradient(windows[pick], labels[pick], weight[pick])
                step += 1
                rate = STEP * (1 - 0.9 * step / total)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        tables, p = self.tables(), self.p
        conv = sum(tables[k][x[:, k:k + WINDOW]] for k in range(_REACH))          # windows, positions, filters
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0, :] + p["bias"]
        hidden = np.maximum(top, 0)
        logits = hidden @ p["out"] + p["out_bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        d = prob
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None] / len(y)
        dh = (d @ p["out"].T) * (top > 0)
        grad = {"out": hidden.T @ d, "out_bias": d.sum(axis=0), "bias": dh.sum(axis=0)}
        d_conv, d_emb = np.zeros_like(p["conv"]), np.zeros_like(p["emb"])
        rows = np.arange(len(x))[:, None]
        for k in range(_REACH):
            byte = x[rows, at + k]                                                 # the byte under offset k of the best place
            d_conv[k] = np.einsum("bfe,bf->ef", p["emb"][byte], dh)
            np.add.at(d_emb, byte.ravel(), (dh[:, :, None] * p["conv"][k].T[None]).reshape(-1, EMBEDDING))
        grad["conv"], grad["emb"] = d_conv * self.mask, d_emb
        return grad

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Pair tables of a fitted network: one look-up covers two offsets."""

    def __init__(self, net: ByteNet):
        self.out, self.out_bias, self.bias = (net.p[k].astype(np.float32) for k in ("out", "out_bias", "bias"))
        t = net.tables() + [np.zeros((256, _ALL), np.float32)] * (_REACH % 2)
        self.pairs = [(k, (t[k][:, None] + t[k + 1][None]).reshape(65536, _ALL)) for k in range(0, len(t), 2)]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        n = len(windows)
        wide = np.pad(windows, ((0, 0), (0, _REACH % 2 + 1))).astype(np.int32)
        code = wide[:, :-1] * 256 + wide[:, 1:]
        conv = None
        for k, table in self.pairs:
            part = np.take(table, code[:, k:k + WINDOW].ravel(), axis=0)
            conv = part if conv is None else np.add(conv, part, out=conv)
        top = conv.reshape(n, WINDOW, _ALL)
        while top.shape[1] > 1:               # halves meet, so that every step runs over whole stretches of memory
            half = -(-top.shape[1] // 2)
            top = np.maximum(top[:, :half], top[:, -half:])
        hidden = np.maximum(top[:, 0] + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def _letter_table() -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[65:91] = t[97:123] = t[128:] = 1
    return t


def text_probabilities(scorer: Scorer, data: np.ndarray, offsets: np.ndarray, n_classes: int) -> np.ndarray:
    """Mean probabilities of every text of a slice (zeros for a text without letter bytes)."""
    n = len(offsets) - 1
    starts = [tiles(int(s)) for s in np.diff(offsets)]
    count = np.array([len(s) for s in starts], np.int64)
    start = np.concatenate([np.zeros(0, np.int64), *starts]) + np.repeat(offsets[:-1], count)
    doc = np.repeat(np.arange(n), count)
    end = offsets[1:][doc]
    letters = np.concatenate(([0], np.cumsum(_letter_table()[data])))
    weight = letters[np.minimum(start + WINDOW, end)] - letters[start]
    total = np.zeros((n, n_classes))
    for lo in range(0, len(start), WINDOWS_AT_ONCE):
        s = slice(lo, lo + WINDOWS_AT_ONCE)
        prob = scorer.probabilities(cut_windows(data, start[s], end[s]))
        np.add.at(total, doc[s], prob * weight[s][:, None])
    mass = np.bincount(doc, weights=weight, minlength=n)
    return total / np.where(mass > 0, mass, 1)[:, None]


def _sample_windows(batches):
    """(lang, h, doc_id, windows): some windows of every text, evenly spread."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("doc_id", pa.int64()), ("windows", pa.binary())])
    for b in batches:
        data, offsets = tn.utf8_buffers(b.column("text"))
        cuts = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            starts = tiles(hi - lo)
            starts = starts[np.unique(np.linspace(0, len(starts) - 1, TRAIN_WINDOWS).astype(np.int64))] if len(starts) else starts
            cuts.append(cut_windows(data, lo + starts, np.full(len(starts), hi)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), b.column("doc_id"), pa.array(cuts, pa.binary())], schema=schema)


def _remainder(col):
    return F.pmod(F.crc32(col.cast("string")), F.lit(4))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """The network fitted on rows whose id has another remainder than 2, or None without labelled texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    known = rows.where("lang is not null").where(_remainder(F.col("doc_id")) != 2).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))       # one row a language
    langs = {r.lang: r.n for r in counts.collect()}
    if not langs:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, PER_LANGUAGE / n))) for k, n in sorted(langs.items())])
    picked = known.withColumn("h", F.xxhash64("doc_id")).where(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))
    cut = picked.select("text", "lang", "h", "doc_id").mapInArrow(_sample_windows, "lang string, h long, doc_id long, windows binary")
    t = cut.orderBy("h", "doc_id", "lang", "windows").limit(TRAIN_DOCS).toArrow()   # TRAIN_WINDOWS short windows a row
    classes = sorted(set(t["lang"].to_pylist()))
    number = {c: i for i, c in enumerate(classes)}
    width = WINDOW + _REACH - 1
    windows = [np.frombuffer(w, np.uint8).reshape(-1, width) for w in t["windows"].to_pylist()]
    labels = np.repeat([number[c] for c in t["lang"].to_pylist()], [len(w) for w in windows])
    return ByteNet(classes).fit(np.concatenate(windows), labels)


def _predict(shipped):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        net: ByteNet = shipped.value
        scorer = net.scorer()
        names = np.array(net.classes, object)
        for b in batches:
            data, offsets = tn.utf8_buffers(b.column("text"))
            has = b.column("has_letter").to_numpy(zero_copy_only=False)
            for lo, hi in tn.slices(offsets):
                part = offsets[lo:hi + 1]
                prob = text_probabilities(scorer, data[part[0]:part[-1]], part - part[0], len(names))
                best = prob.argmax(axis=1) if len(names) else np.zeros(hi - lo, np.int64)
                ok = has[lo:hi]
                lang = np.where(ok, names[best], "und")
                score = np.where(ok, np.clip(prob[np.arange(hi - lo), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(lang.tolist(), pa.string()),
                                                  pa.array(score)], schema=schema)
    return run


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    if net is None:
        out = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        shipped = docs.sparkSession.sparkContext.broadcast(net)      # some 100 kB
        out = rows.mapInArrow(_predict(shipped), "doc_id long, lang_pred string, score double")
    held = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
