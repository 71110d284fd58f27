"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features (per text, rates are per word or per character): densities of a built-in lexicon and of a learned
one (whole words, and word beginnings of 5 to 8 letters, which catch inflected and compounded forms),
hits near a second-person pronoun, hits only seen after undoing character substitutions, capitals,
punctuation, mixed-character and stretched words, repetition and length.

Learning.  Labels come from at most ``SAMPLE`` labelled rows (those with the least hash of the id; the bound
is this parameter), never from rows whose crc32(doc_id) mod 4 is 2, nor from the columns lang, source or
doc_id.  The learned lexicon keeps entries seen in at least ``SUPPORT`` of the toxic texts and ``ODDS`` times as
often as in others, counting equal texts once.  Trees are fitted on rows with remainder 0 and 1, the
calibration on rows with remainder 3, so it sees scores of rows the trees did not.

Scoring is one narrow pass over all texts; nothing is shuffled but the labels.

Defined results: a null text is an empty text and gets a score; ids without a label are only scored; null
labels are ignored, repeated labels of an id count as their maximum; without rows of both labels the score
is 0 for every text; every input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tokenloom.llm import textnum as tn
from tokenloom.llm.stage import giving_back, staged

SAMPLE = 20_000
SUPPORT = 0.01
LEAST = 4
ODDS = 5.0
ENTRIES = 2_000          # bound of the learned lexicon
TREES, DEPTH, STEP = 30, 4, 0.2
THRESHOLD = 0.3
BEGINNINGS = (5, 6, 7, 8)

# Common insults, and second-person pronouns of the languages at hand.
INSULTS = ("idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown clowns "
           "jerk fool ugly garbage filth vermin imbecile cretin dimwit shut kill hate die "
           "dummkopf arschloch abschaum widerlich connard imbécile salaud ordure estúpido imbécil basura asqueroso").split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous votre ton ta tes tú usted ustedes vos".split()
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u"}

FEATURES = ("insult_rate", "insult_log", "learned_rate", "learned_log", "learned_sum", "learned_most", "begin_rate",
            "begin_log", "begin_sum", "second_rate", "near_second", "hidden_hits", "caps_rate", "caps_words", "punct_rate",
            "shout_rate", "symbol_rate", "digit_rate", "mixed_words", "stretched", "variety", "word_len", "log_words", "line_rate")


def _hash_words(words) -> np.ndarray:
    points, offsets = tn.code_points(list(words))
    return np.sort(tn.span_hash(tn.point_prefix(points), offsets[:-1], offsets[1:]))


@functools.cache
def _fixed():
    fold = np.arange(0x110000, dtype=np.uint32)
    for a, b in SUBSTITUTES.items():
        fold[ord(a)] = ord(b)
    return _hash_words(INSULTS), _hash_words(SECOND), fold


def _letters(points, offsets):
    """Letter runs: (start, end, document)."""
    cls = tn.class_table()[points] if len(points) else np.zeros(0, np.uint8)
    start = tn.runs(cls, offsets) if len(points) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(points))[:len(start)]
    keep = cls[start] == tn.LETTER
    start, end = start[keep], end[keep]
    return cls, start, end, np.searchsorted(offsets, start, "right") - 1


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0.0)


def _entries(pre, start, end):
    """Hashes of whole words and of their beginnings: yields (length or 0, hashes, which words)."""
    yield 0, tn.span_hash(pre, start, end), slice(None)
    for k in BEGINNINGS:
        long = end - start > k
        yield k, tn.mix(tn.span_hash(pre, start[long], start[long] + k) + np.uint64(k)), long


def features(texts: list[str], words, begins) -> np.ndarray:
    """Feature matrix of a few texts; ``words`` and ``begins`` are (sorted hashes, weights)."""
    n = len(texts)
    raw, offsets = tn.code_points(texts)
    low_texts = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower()[0] for c in t) for t in texts]
    points, _ = tn.code_points(low_texts)
    insults, second, fold = _fixed()
    cls, start, end, doc = _letters(points, offsets)
    size = np.diff(offsets)
    per = lambda mask_doc, w=None: np.bincount(mask_doc, weights=w, minlength=n).astype(float)
    chars = np.repeat(np.arange(n), size)
    n_words, n_chars = np.maximum(per(doc), 1), np.maximum(size, 1).astype(float)
    pre = tn.point_prefix(points)
    h = tn.span_hash(pre, start, end)
    fixed_hit = _lookup(insults, np.ones(len(insults)), h) > 0
    w_word = _lookup(*words, h)
    w_begin = np.zeros(len(h))
    for k, hk, which in _entries(pre, start, end):
        if k:
            w_begin[which] = np.maximum(w_begin[which], _lookup(*begins, hk))
    is_second = _lookup(second, np.ones(len(second)), h) > 0
    hit = fixed_hit | (w_word > 0) | (w_begin > 0)
    # hits with a pronoun among the five words on either side (of the same text)
    near = np.zeros(len(h), bool)
    for d in range(1, 6):
        if len(h) > d:
            same = doc[d:] == doc[:-d]
            near[d:] |= same & is_second[:-d]
            near[:-d] |= same & is_second[d:]
    # hits of words made readable again: runs of letters after undoing substitutions
    plain = fold[points]
    _, s2, e2, doc2 = _letters(plain, offsets)
    h2 = tn.span_hash(tn.point_prefix(plain), s2, e2)
    changed = np.concatenate(([0], np.cumsum(plain != points)))
    hidden = ((_lookup(insults, np.ones(len(insults)), h2) > 0) | (_lookup(*words, h2) > 0)) & (changed[e2] > changed[s2])
    upper = raw != points
    up_count = np.concatenate(([0], np.cumsum(upper)))
    all_caps = (end - start > 1) & (up_count[end] - up_count[start] == end - start)
    other = cls == tn.OTHER
    number = cls == tn.NUMBER
    shout = (points == 33) | (points == 63)
    symbol = np.isin(points, np.array([ord(c) for c in "%$#&*@^~|<>"], np.uint32))
    # a letter run that touches a digit or symbol on both sides belongs to a mixed word
    odd = np.concatenate(([False], number | symbol, [False]))
    mixed = odd[start] & odd[end + 1] if len(start) else np.zeros(0, bool)
    same3 = np.zeros(len(points), bool)
    if len(points) > 2:
        same3[2:] = (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (cls[2:] == tn.LETTER)
    distinct = per(np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)[0].astype(np.int64)) if len(h) else np.zeros(n)
    most = np.zeros(n)
    np.maximum.at(most, doc, np.maximum(w_word, w_begin))
    begin_doc = per(doc[w_begin > 0])
    learned = per(doc[w_word > 0])
    cols = (per(doc[fixed_hit]) / n_words, np.log1p(per(doc[fixed_hit])), learned / n_words, np.log1p(learned),
            np.log1p(per(doc, w_word)), most, begin_doc / n_words, np.log1p(begin_doc), np.log1p(per(doc, w_begin)),
            per(doc[is_second]) / n_words, np.log1p(per(doc[hit & near])), np.log1p(per(doc2[hidden])),
            per(chars[upper]) / n_chars, per(doc[all_caps]) / n_words, per(chars[other]) / n_chars, per(chars[shout]) / n_words,
            per(chars[symbol]) / n_words, per(chars[number]) / n_chars, per(doc[mixed]) / n_words, per(chars[same3]) / n_words,
            distinct / n_words, per(doc, (end - start).astype(float)) / n_words, np.log1p(per(doc)),
            per(chars[points == 10]) / n_words)
    return np.stack(cols, axis=1)


def _texts(column):
    texts = [t or "" for t in column.to_pylist()]
    sizes = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=sizes[1:])
    for lo, hi in tn.slices(sizes):
        yield lo, hi, texts[lo:hi]


def _feature_rows(lexicon, extra: list[tuple[str, pa.DataType]]):
    schema = pa.schema(extra + [("features", pa.list_(pa.float64()))])

    def run(batches):
        words, begins = lexicon.value
        for b in batches:
            for lo, hi, texts in _texts(b.column("text")):
                m = features(texts, words, begins)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c, _ in extra] + [flat], schema=schema)
    return run


def _entry_counts(batches):
    """Per task: (length, hash, texts with label 0, texts with label 1) of words and beginnings."""
    schema = pa.schema([("k", pa.int32()), ("h", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
    for b in batches:
        label = np.array(b.column("label").to_pylist(), np.int64)
        for lo, hi, texts in _texts(b.column("text")):
            low = [t.lower() for t in texts]
            points, offsets = tn.code_points(low)
            _, start, end, doc = _letters(points, offsets)
            pre = tn.point_prefix(points)
            for k, h, which in _entries(pre, start, end):
                pairs = np.unique(np.stack([h, doc[which].astype(np.uint64)]), axis=1)
                uniq, inverse = np.unique(pairs[0], return_inverse=True)
                toxic = label[lo + pairs[1].astype(np.int64)]
                n1 = np.bincount(inverse, weights=toxic, minlength=len(uniq)).astype(np.int64)
                n0 = np.bincount(inverse, minlength=len(uniq)).astype(np.int64) - n1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uniq), k, np.int32)), pa.array(uniq.view(np.int64)),
                                                  pa.array(n0), pa.array(n1)], schema=schema)


def learn_lexicon(sample: DataFrame):
    """((hashes, weights) of words, the same of beginnings) from rows (text, label)."""
    once = sample.groupBy(F.sha2(F.col("text"), 256).alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    once = staged(once.select("text", "label"), "lexicon-sample")
    total = {r.label: r.n for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    least = max(LEAST, SUPPORT * n1)
    odds = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    rows = once.mapInArrow(giving_back(_entry_counts), "k int, h long, n0 long, n1 long").groupBy("k", "h") \
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= least) \
        .withColumn("weight", F.log(odds)).where(odds >= ODDS).orderBy(F.desc(F.col("n1") * F.col("weight")), "k", "h") \
        .limit(ENTRIES).collect()

    def table(part):
        h = np.array([r.h for r in part], np.int64).view(np.uint64)
        order = np.argsort(h)
        return h[order], np.array([r.weight for r in part], float)[order]
    return table([r for r in rows if r.k == 0]), table([r for r in rows if r.k])


def _remainder(col):
    return F.pmod(F.crc32(col.cast("string")), F.lit(4))


class ToxicityModel:
    """Lexicon, trees and calibration learned from (doc_id, text) and (doc_id, toxic)."""

    # Spark's learners are imported where they are used: Python workers load this module for its Arrow steps and keep it

    def __init__(self, docs: DataFrame, labels: DataFrame):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.regression import IsotonicRegression
        spark = docs.sparkSession
        known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
            .agg(F.max("toxic").cast("int").alias("label")).where(_remainder(F.col("doc_id")) != 2)
        picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # 20,000 ids and labels at most
        sample = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .join(F.broadcast(picked), "doc_id").select("text", "label", _remainder(F.col("doc_id")).alias("part")),
                        "toxicity-sample")
        n = {r.label: r.n for r in sample.where("part <> 3").groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.trees = self.calibration = None
        if not (n.get(0) and n.get(1)):
            return
        self.lexicon = spark.sparkContext.broadcast(learn_lexicon(sample.where("part <> 3").select("text", "label")))
        kinds = [("label", pa.int32()), ("part", pa.int64())]
        rows = staged(sample.select("text", "label", F.col("part").cast("long").alias("part"))
                      .mapInArrow(giving_back(_feature_rows(self.lexicon, kinds)), "label int, part long, features array<double>"),
                      "toxicity-features")
        rows = rows.select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("vector"))
        self.trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP,
                                   seed=7, minInstancesPerNode=3).fit(rows.where("part <> 3").coalesce(4))
        held = self._raw(rows.where("part = 3")).select("label", "raw")
        counts = held.agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).first()
        if counts.n and counts.a != counts.b:
            self.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)

    def _raw(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    def score(self, docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The carried columns, held_out, score, predicted of every row."""
        from pyspark.ml.functions import array_to_vector
        rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
        if self.trees is None:
            out = rows.select(*carry, F.lit(0.0).alias("score"))
        else:
            kept = rows.select(*carry).schema
            schema = to_arrow_schema(kept)
            sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
            rows = rows.select(*dict.fromkeys((*carry, "text"))).mapInArrow(
                giving_back(_feature_rows(self.lexicon, [(f.name, f.type) for f in schema])), f"{sql}, features array<double>")
            out = self._raw(rows.select(*carry, array_to_vector("features").alias("vector")))
            if self.calibration is None:
                out = out.withColumn("score", F.col("raw"))
            else:
                # the calibration is a step function; a small share of the tree score orders rows within a step
                out = self.calibration.transform(out).withColumn("score", 0.98 * F.col("calibrated") + 0.02 * F.col("raw"))
        held = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
        return out.select(*carry, held.alias("held_out"), F.col("score").cast("double").alias("score"),
                          (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ToxicityModel(docs, labels).score(docs)
