"""Q3-Q9: training examples from rendered turns.

``encode_units`` tokenizes every segment of every turn with one explode, one
vocabulary join and one regroup per row key; the example builders are then pure
higher-order-function expressions on the row (no further shuffle), except the
collator, whose window is bounded by the batch size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IGNORE_INDEX
from ..functions.text import words
from .bpe import Subwords
from .encode import lookup_ids, lookup_tokens
from .vocab import Vocabulary

PAIR_IDS = "array<struct<src:array<int>,tgt:array<int>>>"

SRC, TGT, ALT = 0, 1, 2


def units(pairs: Column, alt: Column | None = None) -> Column:
    """Flatten rendered turns to ``array<struct<turn, side, segs>>`` (alt = second target)."""
    u = F.flatten(F.transform(pairs, lambda p, i: F.array(
        F.struct(i.alias("turn"), F.lit(SRC).alias("side"), p["src"].alias("segs")),
        F.struct(i.alias("turn"), F.lit(TGT).alias("side"), p["tgt"].alias("segs")))))
    if alt is not None:
        last = F.size(pairs) - 1
        u = F.concat(u, F.array(F.struct(last.alias("turn"), F.lit(ALT).alias("side"), alt.alias("segs"))))
    return u


def encode_units(df: DataFrame, key: str, units_col: str, vocab: Vocabulary) -> DataFrame:
    """``(key, _n, pairs, _alt)``: the ids of every turn's two sides, and of the second target.

    One explode path: a literal segment becomes one item carrying its id, a text
    segment one item per word; a single vocabulary join resolves the words.
    """
    u = df.select(key, F.size(F.filter(units_col, lambda x: x["side"] == SRC)).alias("_n"),
                  F.explode(units_col).alias("u"))
    s = u.select(key, "_n", F.col("u.turn").alias("turn"), F.col("u.side").alias("side"),
                 F.posexplode("u.segs").alias("seg", "s"))
    item = "struct<w:int,tok:string,lit:int>"
    items = F.when(F.col("s.i").isNotNull(),
                   F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("string").alias("tok"),
                                    F.col("s.i").alias("lit")))) \
             .otherwise(F.transform(words(F.col("s.t")), lambda w, j: F.struct(
                 j.alias("w"), w.alias("tok"), F.lit(None).cast("int").alias("lit")))).cast(f"array<{item}>")
    x = s.select(key, "_n", "turn", "side", "seg", F.explode(items).alias("x"))
    x = x.select(key, "_n", "turn", "side", "seg", F.col("x.w").alias("wpos"), F.col("x.tok").alias("_tok"),
                 F.col("x.lit").alias("_lit"))
    if isinstance(vocab, Subwords):
        ided = lookup_ids(x, vocab).withColumn(
            "_v", F.when(F.col("_lit").isNotNull(), F.array("_lit")).otherwise(F.col("_ids")))
    else:
        ided = lookup_tokens(x, vocab).withColumn("_v", F.coalesce("_lit", "_id"))
    if isinstance(vocab, Subwords) or not vocab.broadcastable():
        ided = ided.repartition(key)  # a shuffled lookup lost the rows' partitioning: one exchange for all regroups
    # ids of one side of one turn, then the sides of a row: each turn is gathered once
    ids = F.transform(F.sort_array(F.collect_list(F.struct("seg", "wpos", "_v"))), lambda e: e["_v"])
    ids = F.flatten(ids) if isinstance(vocab, Subwords) else ids
    sides = ided.groupBy(key, "_n", "turn", "side").agg(ids.alias("_ids"))
    none = F.array().cast("array<int>")
    turns = sides.groupBy(key, "_n", "turn").agg(
        *[F.coalesce(F.first(F.when(F.col("side") == n, F.col("_ids")), ignorenulls=True), none).alias(c)
          for c, n in (("src", SRC), ("tgt", TGT), ("alt", ALT))])
    rows = turns.groupBy(key, "_n").agg(F.sort_array(F.collect_list(F.struct("turn", "src", "tgt", "alt"))).alias("_t"))
    # turns without any id (empty texts) have no rows above: put them back as empty pairs
    empty = F.struct(F.lit(0).alias("turn"), none.alias("src"), none.alias("tgt"), none.alias("alt"))
    whole = F.when(F.size("_t") == F.col("_n"), F.col("_t")).otherwise(_with_gaps(F.col("_t"), F.col("_n"), empty))
    rows = rows.withColumn("_t", whole)
    return rows.withColumn("pairs", F.transform("_t", lambda t: F.struct(t["src"].alias("src"), t["tgt"].alias("tgt")))) \
        .withColumn("_alt", F.element_at("_t", -1)["alt"]).drop("_t")


def _with_gaps(turns: Column, n: Column, empty: Column) -> Column:
    """``n`` turns with ``empty`` ones where a turn is missing (one merge over both orders)."""
    by_turn = F.map_from_entries(F.transform(turns, lambda t: F.struct(t["turn"], t)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(by_turn, i), empty))


def pair_ids(encoded: DataFrame) -> Column:
    """``array<struct<src, tgt>>`` per turn, from :func:`encode_units` output."""
    return F.col("pairs")


def alt_ids() -> Column:
    return F.col("_alt")


def supervised(pairs: Column, max_src: int, max_tgt: int) -> tuple[Column, Column, Column]:
    """Q3-Q6: truncate each turn, keep the turn prefix within ``max_src + max_tgt``
    (stop at the first turn that does not fit), mask sources with IGNORE_INDEX."""
    budget = max_src + max_tgt
    trunc = F.transform(pairs, lambda p: F.struct(F.slice(p["src"], 1, max_src).alias("s"),
                                                  F.slice(p["tgt"], 1, max_tgt).alias("t")))
    init = F.struct(F.lit(0).alias("tot"), F.lit(0).alias("k"), F.lit(False).alias("stop"))

    def step(acc, p):
        n = F.size(p["s"]) + F.size(p["t"])
        fits = (~acc["stop"]) & (acc["tot"] + n <= budget)
        return F.when(fits, F.struct((acc["tot"] + n).alias("tot"), (acc["k"] + 1).alias("k"),
                                     F.lit(False).alias("stop"))) \
                .otherwise(F.struct(acc["tot"].alias("tot"), acc["k"].alias("k"), F.lit(True).alias("stop")))
    k = F.aggregate(trunc, init, step, lambda acc: acc["k"])
    kept = F.slice(trunc, 1, k)
    input_ids = F.flatten(F.transform(kept, lambda p: F.concat(p["s"], p["t"])))
    labels = F.flatten(F.transform(kept, lambda p: F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), F.size(p["s"])), p["t"])))
    return input_ids, F.array_repeat(F.lit(1), F.size(input_ids)), labels


def one_turn(pairs: Column) -> tuple[Column, Column]:
    """Earlier (source, target) pairs and the last source form the prompt; last target = answer."""
    n = F.size(pairs)
    earlier = F.flatten(F.transform(F.slice(pairs, 1, n - 1), lambda p: F.concat(p["src"], p["tgt"])))
    last = F.element_at(pairs, n)
    return F.concat(earlier, last["src"]), last["tgt"]


def unsupervised(pairs: Column, max_src: int, max_tgt: int) -> tuple[Column, Column, Column]:
    """Q7: ids = source (truncated), labels = target (truncated); lengths differ."""
    src, tgt = one_turn(pairs)
    src = F.slice(src, 1, max_src)
    return src, F.array_repeat(F.lit(1), F.size(src)), F.slice(tgt, 1, max_tgt)


def pairwise(pairs: Column, rejected: Column, max_src: int, max_tgt: int) -> tuple[Column, Column, Column]:
    """Q8: prompt, chosen = response[0], rejected = response[1], each truncated."""
    src, chosen = one_turn(pairs)
    return F.slice(src, 1, max_src), F.slice(chosen, 1, max_tgt), F.slice(rejected, 1, max_tgt)


def collate(df: DataFrame, ordinal: str, pad_id: int, batch_size: int = 8,
            padding_side: str = "left", ids: str = "input_ids", batch_col: str | None = None) -> DataFrame:
    """Q9: causal-LM collator per batch of ``batch_size`` rows: pad to the batch's longest
    row, mask pads with 0, labels = ids with every pad id replaced by IGNORE_INDEX.

    The batch is ``ordinal div batch_size``, or ``batch_col`` when already assigned."""
    if batch_col is not None:
        d = df.withColumn("_batch", F.col(batch_col))
    else:
        d = df.withColumn("_batch", (F.col(ordinal) / F.lit(batch_size)).cast("bigint"))
    w = F.max(F.size(ids)).over(Window.partitionBy("_batch"))
    d = d.withColumn("_w", w).withColumn("_pad", F.col("_w") - F.size(ids))
    pad = F.array_repeat(F.lit(pad_id), F.col("_pad"))
    zeros = F.array_repeat(F.lit(0), F.col("_pad"))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    if padding_side == "left":
        padded, mask = F.concat(pad, F.col(ids)), F.concat(zeros, ones)
    else:
        padded, mask = F.concat(F.col(ids), pad), F.concat(ones, zeros)
    d = d.withColumn("input_ids_p", padded).withColumn("attention_mask_p", mask)
    d = d.withColumn("labels_p", F.transform("input_ids_p",
                                             lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x)))
    return (d.drop(ids, "_w", "_pad")
             .withColumnRenamed("input_ids_p", ids)
             .withColumnRenamed("attention_mask_p", "attention_mask")
             .withColumnRenamed("labels_p", "labels")
             .withColumnRenamed("_batch", "batch"))
