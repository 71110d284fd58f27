"""Vocabulary tables: word counts, id assignment, union, difference, subset check,
remap, size ratio and character coverage.

A vocabulary is a table ``(id int, token string, score float)`` with dense ids.
Lookups are joins against it (broadcast only when its counted size is small).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import broadcast_if_small
from ..functions.text import words
from .ordinal import with_ordinal_n

# Special pieces of the base tokenizer and their ids (unk, bos, eos).
SPECIAL_TOKENS = ["<unk>", "<s>", "</s>"]
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2

VOCAB_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("token", T.StringType(), False),
    T.StructField("score", T.FloatType(), False),
])


@dataclass
class Vocabulary:
    """A vocabulary table plus its special ids (resolved by token, never assumed)."""

    table: DataFrame
    size: int
    unk_id: int | None = UNK_ID
    bos_id: int | None = BOS_ID
    eos_id: int | None = EOS_ID
    pad_id: int | None = None

    def __post_init__(self):
        if self.pad_id is None:
            # missing pad -> unk, else eos
            self.pad_id = self.unk_id if self.unk_id is not None else self.eos_id

    def broadcastable(self) -> bool:
        from ..functions.joins import broadcast_limit
        return self.size * 64 <= broadcast_limit(self.table.sparkSession)

    def lookup(self) -> DataFrame:
        """``(token, id)``, broadcast when the counted size allows it."""
        return broadcast_if_small(self.table.select("token", "id"), rows=self.size, bytes_per_row=64)

    def by_id(self) -> DataFrame:
        return broadcast_if_small(self.table.select("id", "token"), rows=self.size, bytes_per_row=64)

    def ids_of(self, tokens: list[str]) -> dict[str, int]:
        """Plan-time lookup of a few literal tokens (bounded by ``len(tokens)``)."""
        if not tokens:
            return {}
        rows = self.table.where(F.col("token").isin(tokens)).select("token", "id").collect()
        return {r["token"]: int(r["id"]) for r in rows}


def specials_table(spark: SparkSession, specials: list[str] = SPECIAL_TOKENS) -> DataFrame:
    return spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(specials)], VOCAB_SCHEMA)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A1: ``(token, count)`` over whitespace words (map-side partial counts absorb hot words)."""
    return (texts.select(F.explode(words(text_col)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def vocab_from_counts(counts: DataFrame, specials: list[str] = SPECIAL_TOKENS) -> Vocabulary:
    """Specials first, then words by (count desc, token asc); score = -id for words."""
    spark = counts.sparkSession
    sp = specials_table(spark, specials)
    plain = counts.join(F.broadcast(sp.select("token")), "token", "left_anti")
    ranked, n_words = with_ordinal_n(plain, F.col("count").desc(), F.col("token").asc())
    n0 = len(specials)
    body = ranked.select(
        (F.col("ordinal") + n0).cast("int").alias("id"),
        F.col("token"),
        (-(F.col("ordinal") + n0)).cast("float").alias("score"),
    )
    table = sp.unionByName(body)
    size = n0 + n_words
    ids = {t: i for i, t in enumerate(specials)}
    return Vocabulary(table, size, ids.get("<unk>"), ids.get("<s>"), ids.get("</s>"))


def build_vocab(texts: DataFrame, text_col: str = "text") -> Vocabulary:
    return vocab_from_counts(word_counts(texts, text_col))


def vocabulary_from_table(table: DataFrame, unk: str = "<unk>", bos: str = "<s>",
                          eos: str = "</s>", pad: str | None = None) -> Vocabulary:
    """Wrap an existing ``(id, token, score)`` table; specials are found by token."""
    table = table.select(F.col("id").cast("int"), "token", F.col("score").cast("float"))
    names = [t for t in (unk, bos, eos, pad) if t]
    found = Vocabulary(table, 0).ids_of(names) if names else {}
    size = table.count()
    return Vocabulary(table, size, found.get(unk), found.get(bos), found.get(eos),
                      found.get(pad) if pad else None)


def merge_vocab(base: Vocabulary, new: Vocabulary) -> Vocabulary:
    """U4 + J1: base kept as is; new pieces missing from base appended in their own id order, score 0."""
    added = new.table.join(base.table.select("token"), "token", "left_anti")
    ranked, n_added = with_ordinal_n(added.select("id", "token"), F.col("id").asc(), name="_rank")
    appended = ranked.select(
        (F.col("_rank") + F.lit(base.size)).cast("int").alias("id"),
        "token",
        F.lit(0.0).cast("float").alias("score"),
    )
    table = base.table.unionByName(appended)
    size = base.size + n_added
    return Vocabulary(table, size, base.unk_id, base.bos_id, base.eos_id, base.pad_id)


def missing_tokens(new: Vocabulary | DataFrame, old: Vocabulary | DataFrame) -> DataFrame:
    """Tokens of ``new`` absent from ``old`` (empty when ``new`` is a subset)."""
    n = new.table if isinstance(new, Vocabulary) else new
    o = old.table if isinstance(old, Vocabulary) else old
    return n.select("id", "token").join(o.select("token"), "token", "left_anti")


def check_subset(new: Vocabulary, old: Vocabulary) -> None:
    """Raise naming a token of ``new`` missing from ``old``; only one row reaches the driver."""
    first = missing_tokens(new, old).select("token").limit(1).collect()
    if first:
        raise ValueError(f"token {first[0]['token']!r} of the new vocabulary is missing from the old one")


def remap_ids(new: Vocabulary, old: Vocabulary) -> DataFrame:
    """``(new_id, old_id, token)`` through the token (equi inner join)."""
    return (new.table.select(F.col("id").alias("new_id"), "token")
            .join(old.table.select(F.col("id").alias("old_id"), "token"), "token"))


def vocab_ratio(new: DataFrame, old: DataFrame) -> DataFrame:
    """A8 as a one-row table: sizes and new/old in percent (2 decimals); one pass, no join."""
    tagged = (new.select(F.lit(1).alias("_n"), F.lit(0).alias("_o"))
              .unionByName(old.select(F.lit(0).alias("_n"), F.lit(1).alias("_o"))))
    sizes = tagged.agg(F.sum("_o").cast("bigint").alias("old_size"),
                       F.sum("_n").cast("bigint").alias("new_size"))
    return sizes.select("old_size", "new_size",
                        F.round(F.lit(100.0) * F.col("new_size") / F.col("old_size"), 2).alias("ratio_pct"))


def char_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Character frequencies over the words of the text (separators excluded).

    Counted on distinct words weighted by their count, not on every character of
    the corpus: the word aggregation is partial per task, and the character rows
    then scale with the vocabulary instead of the text.
    """
    return char_counts_from_words(word_counts(texts, text_col))


def char_counts_from_words(counts: DataFrame, token: str = "token", count: str = "count") -> DataFrame:
    chars = F.explode(F.split(F.col(token), ""))
    return (counts.select(chars.alias("ch"), F.col(count).alias("_c")).where(F.col("ch") != "")
            .groupBy("ch").agg(F.sum("_c").alias("cnt")))


def char_coverage(texts: DataFrame, coverage: float = 0.9995, text_col: str = "text",
                  counts: DataFrame | None = None) -> DataFrame:
    """A2: the most frequent characters whose share *before* them is under ``coverage``.

    The distinct-character table is bounded by the size of Unicode, so one ordered
    window over it is safe at any corpus size.  ``counts`` reuses word counts already made.
    """
    cc = char_counts(texts, text_col) if counts is None else char_counts_from_words(counts)
    w = Window.orderBy(F.col("cnt").desc(), F.col("ch").asc())
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1)))
    before = F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (cc.select("ch", "cnt", before.alias("cum_before"), total.alias("total"))
            .withColumn("kept", (F.col("cum_before") < F.lit(coverage) * F.col("total")).cast("int")))
