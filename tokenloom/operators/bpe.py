"""Byte-pair merges learned from a word table, encoding with them,
and decomposition of new pieces into old ids.

Training keeps the distinct words on the executors, in blocks.  A round cuts them where neighbours are too rare to be merged
in it and brings the distinct pieces left to the driver, which learns from them, exactly, all merges down to a
count (``merge_segments``; partial sums absorb hot words).  The
merge list is the one sequential BPE produces with ties broken by (count desc, left, right); lineage is cut with
a reliable checkpoint every few rounds.

Contract (not SentencePiece's exact trainer): words are whitespace words with a
leading word mark, symbols start as characters, pairs touching a digit are never
merged (split_digits), characters outside the coverage set fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from . import merge_segments
from .vocab import SPECIAL_TOKENS, Vocabulary

# Fixed value: the word-start mark (U+2581) used by SentencePiece-style vocabularies.
WORD_MARK = "▁"
_DIGIT = re.compile("[0-9]")
MOST_PAIRS = 200_000     # pairs on the driver in a round of training


def byte_tokens() -> list[str]:
    """The 256 byte-fallback pieces, built from their rule: ``<0x00>`` .. ``<0xFF>``."""
    return [f"<0x{b:02X}>" for b in range(256)]


def word_table(counts: DataFrame, token: str = "token", count: str = "count") -> DataFrame:
    """``(word, cnt, syms)``: symbols of the marked word joined by single spaces.

    Words never contain whitespace, so a space separates symbols unambiguously and
    merges become codegen'd ``regexp_replace`` calls instead of array rebuilding.
    """
    marked = F.concat(F.lit(WORD_MARK), F.col(token))
    chars = F.filter(F.split(marked, ""), lambda c: c != "")
    return counts.select(F.col(token).alias("word"), F.col(count).cast("bigint").alias("cnt"),
                         F.array_join(chars, " ").alias("syms"))


def _pair_rows(words: DataFrame, split_digits: bool, sign: int = 1) -> DataFrame:
    arr = F.split("syms", " ")
    n = F.size(arr)
    z = F.arrays_zip(F.slice(arr, 1, n - 1).alias("a"), F.slice(arr, 2, n).alias("b"))
    p = words.select((F.col("cnt") * sign).alias("cnt"), F.explode(z).alias("p"))
    p = p.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "cnt")
    if split_digits:
        p = p.where(~(F.col("a").rlike("[0-9]") | F.col("b").rlike("[0-9]")))
    return p


def pair_counts(words: DataFrame, split_digits: bool = True) -> DataFrame:
    """``(a, b, cnt)``: adjacent symbol pairs weighted by word count."""
    return _pair_rows(words, split_digits).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))


def train_bpe(words: DataFrame, n_merges: int, hot: int = 4_000_000, split_digits: bool = True,
              checkpoint_every: int = 8, log=None) -> list[tuple]:
    """A3: up to ``n_merges`` merges ``(a, b, count)`` in rank order, the list that sequential BPE gives.

    The words stay on the executors, in blocks (``merge_segments``).  A round counts all pairs, picks a least count, brings to the
    driver the distinct segments that the pairs of this count or more leave of the words (about ``hot`` symbols in all), learns
    there all merges down to the least count, and rewrites the blocks.  If more than ``hot`` symbols, or pairs, share the first
    count, the pair that comes first among them is merged alone.  The blocks are cut from their lineage every
    ``checkpoint_every`` rounds; between checkpoints one state of them is stored, the last.
    """
    spark = words.sparkSession
    sc = spark.sparkContext
    work = spread(words.where(F.instr("syms", " ") > 0).select("cnt", "syms"))
    start = work.select(F.explode(F.split("syms", " ")).alias("s")).distinct().collect()   # the alphabet
    names = sorted(r["s"] for r in start)
    numbers = {s: i for i, s in enumerate(names)}
    most = min(hot, MOST_PAIRS)
    bits = (hot >> 14).bit_length()          # one in 2^bits segments tells how many there are

    def plain() -> np.ndarray:
        return np.array([not (split_digits and _DIGIT.search(s)) for s in names], bool)

    def first_pair(counts: DataFrame) -> list[tuple[int, int, int, int]]:
        """The one pair that sequential BPE merges next."""
        place = {i: n for n, i in enumerate(sorted(range(len(names)), key=names.__getitem__))}
        order = F.split(F.lit(",".join(str(place[i]) for i in range(len(names)))), ",").cast("array<int>")
        a, b = F.shiftright("key", merge_segments.BITS), F.col("key").bitwiseAND(F.lit(merge_segments.LOW))
        row = counts.orderBy(F.desc("n"), F.get(order, a.cast("int")), F.get(order, b.cast("int"))).limit(1).collect()
        if not row:
            return []
        x, y = row[0]["key"] >> merge_segments.BITS, row[0]["key"] & merge_segments.LOW
        return [(x, y, numbers.setdefault(names[x] + names[y], len(names)), row[0]["n"])]

    def least_count(known, times: np.ndarray, missing: int) -> int | None:
        """The lowest of some counts whose segments have at most ``hot`` symbols; None if the first count has more."""
        levels, k = [], 1
        while k <= len(times) and k <= 4 * missing + 64:      # so many pairs mostly give the merges that are missing
            levels.append(int(times[k - 1]))
            k += max(1, k // 2)
        levels = sorted(set(levels), reverse=True)
        sizes = blocks.mapInArrow(merge_segments.segment_sizes(plain(), known, levels, bits), merge_segments.SIZES) \
            .distinct().groupBy("level").agg(F.sum("size").alias("n")).collect()      # a row per level
        sizes = {r["level"]: r["n"] << bits for r in sizes}
        fitting = [least for i, least in enumerate(levels) if max(sizes.get(j, 0) for j in range(i + 1)) <= hot]
        return fitting[-1] if fitting else None

    def segments_of(known, least: int) -> merge_segments.Segments:
        rows = blocks.mapInArrow(merge_segments.segments(plain(), known, least), merge_segments.SEGMENTS) \
            .groupBy("segment").agg(F.sum("n").alias("n")).toArrow()
        text = b"".join(rows["segment"].to_pylist())
        size = np.array([len(x) // 4 for c in rows["segment"].chunks for x in c.to_pylist()], np.int64)
        return merge_segments.Segments(np.frombuffer(text, np.int32), size, rows["n"].to_numpy(), names, numbers)

    blocks = work.mapInArrow(merge_segments.build(numbers), merge_segments.SCHEMA).checkpoint(eager=True)
    before = None
    merges: list[tuple] = []
    rounds = 0
    while len(merges) < n_merges:
        counts = blocks.mapInArrow(merge_segments.count(plain()), merge_segments.COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
        top = counts.orderBy(F.desc("n"), "key").limit(most).toArrow()
        if before is not None:
            before.unpersist()               # the round's blocks are made
        keys, times = top["key"].to_numpy(), top["n"].to_numpy()
        if not len(keys):
            break
        if len(keys) == most:                # pairs of the last count may be missing
            keys, times = keys[times > times[-1]], times[times > times[-1]]
        missing, base = n_merges - len(merges), len(names)
        least = None
        if len(keys):
            by_key = np.argsort(keys)
            known = sc.broadcast((keys[by_key], times[by_key]))       # ``most`` pairs
            least = least_count(known, times, missing)
            if least is not None:
                batch, again = segments_of(known, least).learn(least, missing)
            known.unpersist()
        if least is None:
            batch = first_pair(counts)
            again = batch[0][2] < base
            if not again:
                names.append(names[batch[0][0]] + names[batch[0][1]])
        merges += [(names[a], names[b], n) for a, b, _, n in batch]
        rounds += 1
        if log:
            log(rounds, len(batch), len(merges))
        if len(merges) >= n_merges:
            break
        # a result that was a symbol before may make pairs that are merged already: it is applied by itself
        steps = [m[:3] for m in batch]
        out = blocks.mapInArrow(merge_segments.rewrite([steps[:-1], steps[-1:]] if again else [steps]), merge_segments.SCHEMA)
        before, blocks = blocks, out.checkpoint(eager=True) if rounds % checkpoint_every == 0 else out.persist()
    blocks.unpersist()
    if before is not None:
        before.unpersist()
    return merges


def merges_table(spark, merges: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(merges)],
                                 "rank int, a string, b string, count long")


def bpe_vocabulary(spark, merges: list[tuple], alphabet: list[str]) -> Vocabulary:
    """Specials, 256 byte pieces, merged pieces in rank order, then the alphabet."""
    pieces: list[str] = list(SPECIAL_TOKENS) + byte_tokens()
    seen = set(pieces)
    for a, b, _ in merges:
        if a + b not in seen:
            seen.add(a + b)
            pieces.append(a + b)
    for ch in alphabet:
        if ch not in seen:
            seen.add(ch)
            pieces.append(ch)
    rows = [(i, p, 0.0 if i < 3 + 256 else float(-i)) for i, p in enumerate(pieces)]
    table = spark.createDataFrame(rows, "id int, token string, score float")
    return Vocabulary(table, len(pieces), 0, 1, 2)


def _encoder(merges: list[tuple], vocab_rows: list[tuple]):
    """Plain BPE for one word (small helper run inside Arrow batches, once per distinct word).

    Pairs wait in a heap by (rank, place) over a linked list of symbols, so a word of n
    characters takes n log n steps; a learned merge list never makes a pair of lower rank than
    the one just merged, so this equals merging pair by pair in rank order.
    """
    ranks = {(a, b): i for i, (a, b, _) in enumerate(merges)}
    ids = {tok: i for i, tok in vocab_rows}
    byte_id = [ids[f"<0x{b:02X}>"] for b in range(256)]

    def encode(word: str, mark: bool = True) -> list[int]:
        syms: list[str | None] = list((WORD_MARK if mark else "") + word)
        n = len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(syms, syms[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (syms[i], syms[j]) != pair:
                continue
            syms[i], syms[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    p = (syms[left], syms[after[left]])
                    if p in ranks:
                        heapq.heappush(heap, (ranks[p], left, p))
        res: list[int] = []
        for s in syms:
            if s is None:
                continue
            if s in ids:
                res.append(ids[s])
            else:
                res.extend(byte_id[b] for b in s.encode("utf-8"))
        return res
    return encode


def encode_words_udf(merges: list[tuple], vocab: Vocabulary, mark: bool = True):
    """Arrow-batched UDF: word -> ids.  Merges and pieces are bounded by the vocabulary size."""
    vocab_rows = [(r["id"], r["token"]) for r in vocab.table.select("id", "token").collect()]
    enc = _encoder(merges, vocab_rows)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def bpe_ids(words: pd.Series) -> pd.Series:
        return words.map(lambda w: enc(w, mark))
    return bpe_ids


@dataclass
class Subwords(Vocabulary):
    """The learned-BPE tokenizer: its vocabulary and merges.

    Wherever a :class:`Vocabulary` encodes whole words, ``Subwords`` encodes each distinct word
    once with the merges and joins the ids back (see ``encode.lookup_ids``).
    """

    merges: list = field(default_factory=list)

    @classmethod
    def of(cls, vocab: Vocabulary, merges: list[tuple]) -> "Subwords":
        return cls(vocab.table, vocab.size, vocab.unk_id, vocab.bos_id, vocab.eos_id, vocab.pad_id, merges=merges)

    def encode_words(self, words: DataFrame, col: str) -> DataFrame:
        """``(col, _ids)`` of distinct words."""
        return words.select(col, encode_words_udf(self.merges, self)(col).alias("_ids"))


def encode_bpe(df: DataFrame, key: str, text: str, merges: list[tuple], vocab: Vocabulary) -> DataFrame:
    """K2: texts encoded with the learned merges; every distinct word is merged once."""
    from .encode import encode_texts
    return encode_texts(df, [key], text, Subwords.of(vocab, merges))


def decompose(new_tokens: DataFrame, merges: list[tuple], old: Vocabulary,
              id_col: str = "id", token_col: str = "token") -> DataFrame:
    """Each new piece encoded with the old vocabulary; a leading lone word mark is dropped
    (found by token, not by a fixed id).  A piece may end with no old id; the mean step
    then gives it the table mean."""
    udf = encode_words_udf(merges, old)
    mark_id = old.ids_of([WORD_MARK]).get(WORD_MARK, -1)
    enc = new_tokens.select(F.col(id_col).alias("new_id"), F.col(token_col).alias("token"),
                            udf(token_col).alias("_ids"))
    first = F.element_at("_ids", 1)
    old_ids = F.when(first == F.lit(mark_id), F.slice("_ids", 2, 1 << 30)).otherwise(F.col("_ids"))
    return enc.select("new_id", "token", old_ids.alias("old_ids"))
