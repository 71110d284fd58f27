"""Vocabulary flows: learn a BPE vocabulary from corpus lines, extend a base
vocabulary and its embedding table with it, or prune a vocabulary and its table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import WORD_MARK, bpe_vocabulary, byte_tokens, decompose, train_bpe, word_table
from ..operators.embeddings import extend_long, gather_rows, with_fallback_mean
from ..operators.vocab import (SPECIAL_TOKENS, Vocabulary, char_coverage, check_subset, merge_vocab,
                               remap_ids, vocab_ratio, word_counts)
from ..sources.corpus import corpus_lines


@dataclass
class LearnedBPE:
    merges: list
    vocab: Vocabulary


def learn_bpe_vocabulary(texts: DataFrame, key: str, vocab_size: int, text_col: str = "text",
                         coverage: float = 0.9995, max_sentence_bytes: int = 2000) -> LearnedBPE:
    """The trainer's settings as Spark jobs: lines of at most ``max_sentence_bytes`` (S6),
    word counts (A1), character coverage (A2), merges until ``vocab_size`` pieces (A3)."""
    lines = corpus_lines(texts, key, text_col, max_sentence_bytes)
    counts = word_counts(lines, "line").checkpoint(eager=True)
    kept = (char_coverage(lines, coverage, "line", counts=counts).where(F.col("kept") == 1)
            .orderBy(F.col("cnt").desc(), F.col("ch").asc()).select("ch").collect())  # bounded by Unicode
    alphabet = [WORD_MARK] + [r["ch"] for r in kept]
    base = len(SPECIAL_TOKENS) + len(byte_tokens()) + len(alphabet)
    merges = train_bpe(word_table(counts), max(0, vocab_size - base))
    return LearnedBPE(merges, bpe_vocabulary(texts.sparkSession, merges, alphabet))


def extend_vocab(old: LearnedBPE, new: Vocabulary, old_emb: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Base vocabulary + the new pieces it lacks (U4); every added piece is decomposed with
    the old tokenizer (J5) and its row is the mean of those old rows (A4; the table mean
    when none exists); old rows are kept (A6).  Returns the merged vocabulary and the
    extended table in long form ``(id, dim, value)``."""
    merged = merge_vocab(old.vocab, new)
    old_emb = old_emb.where(F.col("id") < old.vocab.size)  # the old model's rows only
    added = merged.table.where(F.col("id") >= old.vocab.size).select("id", "token")
    parts = decompose(added, old.merges, old.vocab).select("new_id", F.explode("old_ids").alias("old_id"))
    rows = with_fallback_mean(parts, old_emb, added.select(F.col("id").alias("new_id")))
    return merged, extend_long(old_emb, rows)


@dataclass
class Pruned:
    remap: DataFrame
    embeddings: DataFrame
    ratio: DataFrame


def prune_vocab(new: Vocabulary, old: Vocabulary, old_emb: DataFrame) -> Pruned:
    """Subset check (J2), new id -> old id (J3), rows gathered and renumbered (J4), size ratio."""
    check_subset(new, old)
    remap = remap_ids(new, old)
    rows = gather_rows(remap, old_emb, mapping_rows=new.size)
    return Pruned(remap, rows, vocab_ratio(new.table, old.table))

