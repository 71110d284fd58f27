"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole given
tables.  Arrays are returned as space-joined text so that the SQL oracle can be
compared cell by cell; the library operators themselves return ``array<int>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import ids_text
from ..functions.joins import broadcast_if_small
from ..functions.text import words
from ..operators.align import add_system, align_columns, query_text, system_prompts
from ..operators.batched import map_batches
from ..operators.bpe import (WORD_MARK, Subwords, bpe_vocabulary, byte_tokens, decompose, encode_bpe, merges_table,
                             pair_counts, train_bpe, word_table)
from ..operators.embeddings import extend_long, gather_rows, mean_rows_long, resize_long, to_long
from ..operators.encode import decode_ids, encode_texts
from ..operators.examples import collate
from ..operators.filters import pretrain_filter, sft_filter
from ..operators.mix import concat, interleave_over, interleave_probs, interleave_under
from ..operators.ordinal import assign_batches, ordinal_from_key, with_ordinal, with_ordinal_n
from ..operators.pack import batch_offsets, pack_text
from ..operators.split import first_n_per_group, seeded_rank, split_exact, split_head
from ..operators.templates import seg_text
from ..operators.vocab import (SPECIAL_TOKENS, build_vocab, char_coverage, check_subset, merge_vocab, missing_tokens,
                               remap_ids, vocab_ratio, word_counts)
from ..session import ensure_checkpoint_dir, stage_dir
from ..sources.conversations import pair_rows, prompt_rows, sft_rows
from ..sources.corpus import corpus_lines
from ..sources.files import load_datasets, write_text
from ..sources.sinks import fingerprint, shard_rows_for, stage_table, write_byte_shards, write_shards, write_vocab
from ..sources.tables import table
from ..streaming.encode import (StreamRules, read_stream, run_batches, run_buffer_shuffle, run_row_batches, run_stateless,
                                shuffle_buffers, split_head_stream, stream_filter)
from .instruct import pair_examples, prompt_examples, render, sft_examples
from .pretrain import pretrain_blocks
from .vocabulary import extend_vocab, learn_bpe_vocabulary

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


# Query parameter: rows per packing batch (the flows' default is 1000).  At 100 the smallest correctness tables
# already hold ten batches, so the rules at batch borders are compared.
PACK_ROWS = 100


@register("pt_pack")
def q_pt_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretraining blocks of 512 ids per batch of 100 documents."""
    blocks = pretrain_blocks(_docs(spark, sf_dir), block=512, batch_rows=PACK_ROWS)
    return blocks.select("batch", "block", ids_text("input_ids").alias("input_ids"),
                         F.size("input_ids").cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------- shared inputs

def _vocab_of(spark: SparkSession, sf_dir: str, where: str | None = None):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    if where is not None:
        docs = docs.where(where)
    return build_vocab(docs, "text")


def _lang_vocabs(spark: SparkSession, sf_dir: str):
    """Base = words of English documents, new = words of the other languages."""
    base = _vocab_of(spark, sf_dir, "lang = 'en'")
    new = _vocab_of(spark, sf_dir, "NOT (lang <=> 'en')")
    return base, new


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"), "label")


def _long_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("dim").cast("bigint").alias("dim"),
                     F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- filters, offsets, lines

@register("pt_filter")
def q_pt_filter(spark, sf_dir):
    """documents whose prompt is truthy (not null, not '')."""
    rows = pretrain_filter(_docs(spark, sf_dir).withColumnRenamed("text", "prompt"), "prompt")
    return rows.select("doc_id", F.length("prompt").cast("bigint").alias("n_chars"))


@register("pt_pack_offsets")
def q_pt_pack_offsets(spark, sf_dir):
    """Per document its batch, token count, tokens before it in the batch, batch total."""
    rows = pretrain_filter(_docs(spark, sf_dir), "text")
    rows = ordinal_from_key(rows, "doc_id").withColumn("n_tokens", F.size(words("text")).cast("bigint"))
    d = batch_offsets(rows.select("doc_id", "ordinal", "n_tokens"), "ordinal", "n_tokens", PACK_ROWS)
    return d.select("doc_id", F.col("_batch").alias("batch"), "n_tokens",
                    F.col("_off").alias("token_offset"), F.col("_tot").alias("batch_tokens"))


@register("corpus_lines")
def q_corpus_lines(spark, sf_dir):
    """Non-empty lines of at most 2000 bytes."""
    lines = corpus_lines(_docs(spark, sf_dir), "doc_id", "text", 2000)
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@register("word_counts")
def q_word_counts(spark, sf_dir):
    """A1: whitespace word counts of the corpus."""
    return word_counts(_docs(spark, sf_dir), "text").select("token", F.col("count").cast("bigint"))


@register("char_coverage")
def q_char_coverage(spark, sf_dir):
    """A2: characters by frequency, running share, kept under coverage 0.9995."""
    cc = char_coverage(_docs(spark, sf_dir), 0.9995, "text")
    return cc.select("ch", F.col("cnt").cast("bigint"), F.col("cum_before").cast("bigint"),
                     F.col("kept").cast("bigint"))


# ---------------------------------------------------------------- encode / decode / stats

@register("encode_ws")
def q_encode_ws(spark, sf_dir):
    """K1, K4: every document to ids of the corpus vocabulary."""
    docs = pretrain_filter(_docs(spark, sf_dir), "text")
    vocab = build_vocab(docs, "text")
    enc = encode_texts(docs, ["doc_id"], "text", vocab)
    return enc.select("doc_id", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("decode")
def q_decode(spark, sf_dir):
    """K3: packed blocks back to text through the vocabulary."""
    docs = _docs(spark, sf_dir)
    vocab = build_vocab(pretrain_filter(docs, "text"), "text")
    blocks = pretrain_blocks(docs, vocab=vocab, block=512, batch_rows=PACK_ROWS)
    dec = decode_ids(blocks, ["batch", "block"], "input_ids", vocab, out="text")
    return dec.select("batch", "block", "text")


@register("token_stats")
def q_token_stats(spark, sf_dir):
    """Dataset length and total token count after the filter."""
    docs = pretrain_filter(_docs(spark, sf_dir), "text")
    return docs.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                    F.sum(F.size(words("text"))).cast("bigint").alias("n_tokens"))


# ---------------------------------------------------------------- vocabulary tables

@register("vocab_merge")
def q_vocab_merge(spark, sf_dir):
    """Base vocabulary plus the new pieces it lacks, appended with score 0."""
    base, new = _lang_vocabs(spark, sf_dir)
    merged = merge_vocab(base, new)
    return merged.table.select(F.col("id").cast("bigint"), "token", F.col("score").cast("double"))


@register("vocab_missing")
def q_vocab_missing(spark, sf_dir):
    """Tokens of the new vocabulary missing from the base (what the subset check reports)."""
    base, new = _lang_vocabs(spark, sf_dir)
    return missing_tokens(new, base).select(F.col("id").cast("bigint"), "token")


@register("vocab_remap")
def q_vocab_remap(spark, sf_dir):
    """New id -> old id through the token (new = other languages, old = merged)."""
    base, new = _lang_vocabs(spark, sf_dir)
    old = merge_vocab(base, new)
    check_subset(new, old)
    return remap_ids(new, old).select(F.col("new_id").cast("bigint"), F.col("old_id").cast("bigint"), "token")


@register("vocab_ratio")
def q_vocab_ratio(spark, sf_dir):
    """Pruned / original vocabulary size in percent."""
    base, new = _lang_vocabs(spark, sf_dir)
    old = merge_vocab(base, new)
    return vocab_ratio(new.table, old.table)


# ---------------------------------------------------------------- embeddings

def _vocab_rows(spark, sf_dir, vocab) -> DataFrame:
    """An embedding table for every id of a vocabulary: the given vectors in turn (id modulo their number)."""
    emb = _embeddings(spark, sf_dir).select(F.col("id").alias("_k"), "vec")
    n = emb.count()
    ids = vocab.table.select("id", (F.col("id") % F.lit(n)).cast("int").alias("_k"))
    return ids.join(emb, "_k").select("id", "vec")


def _row_digest(rows: DataFrame) -> DataFrame:
    """One number per embedding row: the sum of (dim + 1) * value."""
    total = F.aggregate(F.transform("vec", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select(F.col("id").cast("bigint").alias("id"), F.size("vec").cast("bigint").alias("dims"),
                       F.round(total, 4).alias("digest"))


@register("embed_prune")
def q_embed_prune(spark, sf_dir):
    """The row of every kept token gathered from the old table and renumbered."""
    base, new = _lang_vocabs(spark, sf_dir)
    old = merge_vocab(base, new)
    return _row_digest(gather_rows(remap_ids(new, old), _vocab_rows(spark, sf_dir, old)))


@register("embed_mean")
def q_embed_mean(spark, sf_dir):
    """A4: mean row of each group of old rows (group = label)."""
    emb = _embeddings(spark, sf_dir)
    members = emb.select(F.col("label").alias("new_id"), F.col("id").alias("old_id"))
    means = mean_rows_long(members, emb.select("id", "vec"))
    return _long_out(means.withColumnRenamed("new_id", "id"))


@register("embed_resize")
def q_embed_resize(spark, sf_dir):
    """A5: one new special token appended after the last row, set to the table mean."""
    emb = _embeddings(spark, sf_dir).select("id", "vec")
    return _long_out(resize_long(emb, n_new=1))


@register("embed_extend")
def q_embed_extend(spark, sf_dir):
    """A4 + A6: old rows kept; one new row per label (ids after the last), the mean of its members."""
    emb = _embeddings(spark, sf_dir)
    top = emb.agg(F.max("id")).first()[0]
    labels, n_labels = with_ordinal_n(emb.select("label").distinct(), F.col("label").asc(), name="_r")
    members = (emb.select("label", F.col("id").alias("old_id"))
               .join(broadcast_if_small(labels, rows=n_labels, bytes_per_row=16), "label")
               .select((F.col("_r") + F.lit(int(top) + 1)).cast("int").alias("new_id"), "old_id"))
    new_rows = mean_rows_long(members, emb.select("id", "vec")).withColumnRenamed("new_id", "id")
    return _long_out(extend_long(emb.select("id", "vec"), new_rows))


# ---------------------------------------------------------------- limits, splits, shuffle

@register("max_samples")
def q_max_samples(spark, sf_dir):
    """L1: first 10 rows of every dataset (dataset = document source), in file order."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    return first_n_per_group(docs, "source", "doc_id", 10).select("source", "doc_id")


@register("split_exact")
def q_split_exact(spark, sf_dir):
    """L2: exact 10% eval split by seeded hash (seed 42)."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    return split_exact(docs, "doc_id", 0.1, seed=42).select("doc_id", "split")


@register("split_head")
def q_split_head(spark, sf_dir):
    """The first 100 packed blocks are the eval set."""
    blocks = pretrain_blocks(_docs(spark, sf_dir), block=512, batch_rows=PACK_ROWS).select("batch", "block")
    ranked = with_ordinal(blocks, F.col("batch").asc(), F.col("block").asc())
    return split_head(ranked, "ordinal", 100).select("batch", "block", "split")


@register("shuffle")
def q_shuffle(spark, sf_dir):
    """L4: seeded shuffle order of the documents (seed 7)."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    return seeded_rank(docs, "doc_id", 7, name="rank").select("doc_id", "rank")


# ---------------------------------------------------------------- instruction data

def _conv(spark, sf_dir):
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def _conv_vocab(conv):
    return build_vocab(conv, "text")


@register("align")
def q_align(spark, sf_dir):
    """Raw instruction/input/output columns renamed to prompt/query/response, system added."""
    raw = sft_rows(_conv(spark, sf_dir)).select(
        "conv_id", F.col("prompt").alias("instruction"), F.col("system").alias("input"),
        F.col("response").alias("output"))
    aligned = add_system(align_columns(raw), "Be brief.")
    return aligned.select("conv_id", "prompt", "query", "response", "system")


@register("build_query")
def q_build_query(spark, sf_dir):
    """Prompt + newline + query when the query (here: the system message) is truthy."""
    rows = sft_rows(_conv(spark, sf_dir)).withColumn("query", F.col("system"))
    return rows.select("conv_id", query_text("prompt", "query").alias("query_text"))


def _render_query(template_name):
    def q(spark, sf_dir):
        conv = _conv(spark, sf_dir)
        vocab = _conv_vocab(conv)
        r, _ = render(sft_filter(sft_rows(conv)), template_name, vocab)
        t = r.select("conv_id", F.posexplode("pairs").alias("turn", "p"))
        return t.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                        seg_text(F.col("p.src")).alias("source"), seg_text(F.col("p.tgt")).alias("target"))
    q.__doc__ = f"T1-T6: {template_name} template rendered per turn (segments joined, specials by name)."
    return q


for _name in ("default", "alpaca", "chatglm2", "llama2", "llama2_zh"):
    register(f"render_{_name}")(_render_query(_name))


@register("sft_encode")
def q_sft_encode(spark, sf_dir):
    """Supervised examples, default template, limits 96 + 160."""
    conv = _conv(spark, sf_dir)
    ex = sft_examples(sft_rows(conv), "conv_id", "default", _conv_vocab(conv), 96, 160)
    return ex.select("conv_id", ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"),
                     ids_text("attention_mask").alias("attention_mask"),
                     F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("unsup_encode")
def q_unsup_encode(spark, sf_dir):
    """Prompt-only examples, alpaca template, limits 256 / 128."""
    conv = _conv(spark, sf_dir)
    ex = prompt_examples(prompt_rows(conv), "conv_id", "alpaca", _conv_vocab(conv), 256, 128)
    return ex.select("conv_id", ids_text("input_ids").alias("input_ids"), ids_text("labels").alias("labels"))


@register("rm_encode")
def q_rm_encode(spark, sf_dir):
    """Reward pairs (first two answers), llama2 template, limits 512 / 64."""
    conv = _conv(spark, sf_dir)
    ex = pair_examples(pair_rows(conv), "conv_id", "llama2", _conv_vocab(conv), 512, 64)
    return ex.select("conv_id", ids_text("prompt_ids").alias("prompt_ids"),
                     ids_text("chosen_ids").alias("chosen_ids"), ids_text("rejected_ids").alias("rejected_ids"))


@register("collate")
def q_collate(spark, sf_dir):
    """Q9: supervised examples padded per batch of 8 (left, pad = unk), pads masked in labels."""
    conv = _conv(spark, sf_dir)
    vocab = _conv_vocab(conv)
    ex = sft_examples(sft_rows(conv), "conv_id", "default", vocab, 96, 160).select("conv_id", "input_ids")
    # batches of 8 examples in conv_id order; only the keys are ranked (see assign_batches)
    ex = assign_batches(ex, "conv_id", 8, name="_b")
    out = collate(ex, "conv_id", vocab.pad_id, batch_size=8, padding_side="left", batch_col="_b")
    return out.select("conv_id", "batch", ids_text("input_ids").alias("input_ids"),
                      ids_text("attention_mask").alias("attention_mask"), ids_text("labels").alias("labels"))


# ---------------------------------------------------------------- mixing

# Fixed query parameters: datasets = documents by language, in this order.
MIX_LANGS = ["en", "fr", "de", "es"]


def _lang_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    other = docs.where(~F.coalesce(F.col("lang").isin(MIX_LANGS), F.lit(False))).select("lang").first()
    if other is not None:
        raise ValueError(f"documents of language {other['lang']!r} belong to no dataset of the mix")
    return [docs.where(F.col("lang") == lg).select("doc_id") for lg in MIX_LANGS]


@register("mix_concat")
def q_mix_concat(spark, sf_dir):
    """Datasets concatenated; system prompts 'x|y' spread over four datasets."""
    systems = system_prompts("Answer briefly.|Réponds brièvement.", len(MIX_LANGS))
    mixed = concat(_lang_sets(spark, sf_dir), "doc_id", MIX_LANGS, systems)
    return mixed.select("position", "dataset", "doc_id", "system")


@register("mix_under")
def q_mix_under(spark, sf_dir):
    """Round-robin interleave until the first dataset is exhausted."""
    return interleave_under(_lang_sets(spark, sf_dir), "doc_id", MIX_LANGS).select("position", "dataset", "doc_id")


@register("mix_over")
def q_mix_over(spark, sf_dir):
    """Round-robin interleave, shorter datasets cycling, until the last is exhausted."""
    return interleave_over(_lang_sets(spark, sf_dir), "doc_id", MIX_LANGS).select("position", "dataset", "doc_id")


@register("mix_probs")
def q_mix_probs(spark, sf_dir):
    """Seeded interleave with probabilities 0.4/0.3/0.2/0.1 until a dataset is exhausted."""
    mixed = interleave_probs(_lang_sets(spark, sf_dir), "doc_id", [0.4, 0.3, 0.2, 0.1], 42, MIX_LANGS)
    return mixed.select("position", "dataset", "doc_id")


@register("mix_probs_over")
def q_mix_probs_over(spark, sf_dir):
    """The same draws, datasets cycling, until every dataset is exhausted."""
    mixed = interleave_probs(_lang_sets(spark, sf_dir), "doc_id", [0.4, 0.3, 0.2, 0.1], 42, MIX_LANGS, until="all")
    return mixed.select("position", "dataset", "doc_id")


# ---------------------------------------------------------------- byte-pair vocabulary

BPE_MERGES = 32  # query parameter: merges learned per registered BPE query


# Query parameter: merges of the queries at vocabulary size.  They have no SQL: the recursive SQL of the small ones
# recounts every pair for each merge.  Tests hold the merge list to sequential BPE.
FULL_MERGES = 1_000

# Pieces of the vocabulary that encode_bpe, pt_pack_bpe and decode_bpe learn: the reference's target_vocab_size.
VOCAB_PIECES = 10_000


def _bpe(spark, sf_dir, where: str | None = None, n_merges: int = BPE_MERGES, pieces: int | None = None):
    """Word table, merges and BPE vocabulary learned from the (filtered) documents.

    With ``pieces`` as many merges are learned as a vocabulary of that size has room for beside its fixed pieces and alphabet.
    The merges are a cached table (S7): another query of the session over the same files reads them back.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    if where is not None:
        docs = docs.where(where)
    counts = word_counts(docs, "text").checkpoint(eager=True)
    cov = char_coverage(docs, 0.9995, "text", counts=counts).where(F.col("kept") == 1) \
        .orderBy(F.col("cnt").desc(), F.col("ch").asc()).select("ch").collect()  # bounded by Unicode
    alphabet = [WORD_MARK] + [r["ch"] for r in cov]
    if pieces is not None:
        n_merges = max(0, pieces - len(SPECIAL_TOKENS) - len(byte_tokens()) - len(alphabet))
    learned = stage_table(lambda: merges_table(spark, train_bpe(word_table(counts), n_merges)), spark,
                          f"{ensure_checkpoint_dir(spark).rstrip('/')}/learned-merges", fingerprint(docs, n_merges=n_merges))
    merges = [(r["a"], r["b"], r["count"]) for r in learned.orderBy("rank").collect()]   # n_merges rows
    return docs, merges, bpe_vocabulary(spark, merges, alphabet)


@register("bpe_pairs")
def q_bpe_pairs(spark, sf_dir):
    """A3, round 1: adjacent symbol pair counts of the marked corpus words (digits never paired)."""
    wt = word_table(word_counts(_docs(spark, sf_dir), "text"))
    return pair_counts(wt).select("a", "b", F.col("cnt").cast("bigint").alias("cnt"))


@register("bpe_merges")
def q_bpe_merges(spark, sf_dir):
    """A3: the first merges learned from the corpus, in rank order (exact batched rounds)."""
    _, merges, _ = _bpe(spark, sf_dir)
    return merges_table(spark, merges)


@register("encode_bpe")
def q_encode_bpe(spark, sf_dir):
    """K2: documents encoded with a learned vocabulary of 10,000 pieces (distinct words of a chunk once)."""
    docs, merges, vocab = _bpe(spark, sf_dir, pieces=VOCAB_PIECES)
    enc = encode_bpe(docs, "doc_id", "text", merges, vocab)
    return enc.select("doc_id", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("pt_pack_bpe")
def q_pt_pack_bpe(spark, sf_dir):
    """K2, Q1, Q2: pretraining blocks of 512 ids of a learned vocabulary of 10,000 pieces per batch of 100 documents."""
    docs, merges, vocab = _bpe(spark, sf_dir, pieces=VOCAB_PIECES)
    blocks = pretrain_blocks(docs, vocab=Subwords.of(vocab, merges), block=512, batch_rows=100)
    return blocks.select("batch", "block", ids_text("input_ids").alias("input_ids"),
                         F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("decode_bpe")
def q_decode_bpe(spark, sf_dir):
    """K2, K3: documents through a learned vocabulary of 10,000 pieces and back to their words, one space apart."""
    docs, merges, vocab = _bpe(spark, sf_dir, pieces=VOCAB_PIECES)
    sub = Subwords.of(vocab, merges)
    return decode_ids(encode_texts(docs, ["doc_id"], "text", sub), ["doc_id"], "input_ids", sub)


@register("sft_encode_bpe")
def q_sft_encode_bpe(spark, sf_dir):
    """T5, K2, Q3-Q6: supervised examples in learned-BPE ids (template default, limits 96 + 160)."""
    conv = _conv(spark, sf_dir)
    _, merges, vocab = _bpe(spark, sf_dir)
    out = sft_examples(sft_rows(conv), "conv_id", "default", Subwords.of(vocab, merges), 96, 160)
    return out.select("conv_id", ids_text("input_ids").alias("input_ids"),
                      ids_text("attention_mask").alias("attention_mask"), ids_text("labels").alias("labels"))


@register("vocab_decompose")
def q_vocab_decompose(spark, sf_dir):
    """New pieces (other languages, absent from the English vocabulary) as old BPE ids."""
    _, merges, old = _bpe(spark, sf_dir, "lang = 'en'")
    base, new = _lang_vocabs(spark, sf_dir)
    added = missing_tokens(new, base)
    dec = decompose(added, merges, old)
    return dec.select(F.col("new_id").cast("bigint"), "token", ids_text("old_ids").alias("old_ids"))


@register("bpe_merges_full")
def q_bpe_merges_full(spark, sf_dir):
    """A3 at vocabulary size: the first 1,000 merges of the corpus, in rank order."""
    _, merges, _ = _bpe(spark, sf_dir, n_merges=FULL_MERGES)
    return merges_table(spark, merges)


@register("encode_bpe_full")
def q_encode_bpe_full(spark, sf_dir):
    """K2 at vocabulary size: documents encoded with 1,000 learned merges."""
    docs, merges, vocab = _bpe(spark, sf_dir, n_merges=FULL_MERGES)
    enc = encode_bpe(docs, "doc_id", "text", merges, vocab)
    return enc.select("doc_id", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("pt_pack_bpe_full")
def q_pt_pack_bpe_full(spark, sf_dir):
    """K2, Q1, Q2 at vocabulary size: blocks of 512 ids of 1,000 learned merges per batch of 100 documents."""
    docs, merges, vocab = _bpe(spark, sf_dir, n_merges=FULL_MERGES)
    blocks = pretrain_blocks(docs, vocab=Subwords.of(vocab, merges), block=512, batch_rows=PACK_ROWS)
    return blocks.select("batch", "block", ids_text("input_ids").alias("input_ids"),
                         F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("decode_bpe_full")
def q_decode_bpe_full(spark, sf_dir):
    """K2, K3 at vocabulary size: documents through 1,000 learned merges and back to their words, one space apart."""
    docs, merges, vocab = _bpe(spark, sf_dir, n_merges=FULL_MERGES)
    sub = Subwords.of(vocab, merges)
    return decode_ids(encode_texts(docs, ["doc_id"], "text", sub), ["doc_id"], "input_ids", sub)


@register("pt_pack_cached")
def q_pt_pack_cached(spark, sf_dir):
    """The blocks of ``pt_pack`` made and published in a cache, then asked for again and read from it."""
    docs, cache = _docs(spark, sf_dir), stage_dir(spark, "pt-cache")
    pretrain_blocks(docs, block=512, batch_rows=PACK_ROWS, cache_path=cache)
    hit = pretrain_blocks(docs, block=512, batch_rows=PACK_ROWS, cache_path=cache)
    return hit.select("batch", "block", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


def _batch_totals(rows):
    """G1: a batch function of pandas rows: many rows in, one out."""
    return rows.assign(n_rows=len(rows), n_chars=rows["text"].str.len().sum())[["n_rows", "n_chars"]].head(1)


@register("map_batches")
def q_map_batches(spark, sf_dir):
    """G1: a user's function over batches of 100 filtered documents, in order."""
    rows = ordinal_from_key(pretrain_filter(_docs(spark, sf_dir), "text"), "doc_id")
    out = map_batches(rows, "ordinal", _batch_totals, "n_rows bigint, n_chars bigint", batch_rows=PACK_ROWS)
    return out.select("batch", "n_rows", "n_chars")


# ---------------------------------------------------------------- files and streams

FILE_FORMATS = ["csv", "json", "text", "parquet"]
STREAM_FILES = 12  # query parameter: input files of a stream


@register("src_formats")
def q_src_formats(spark, sf_dir):
    """Documents written as csv / json / txt / parquet folders, registered in a
    dataset_info.json, loaded back by name with column maps and system prompts 'A|B'."""
    import json as _json
    docs = _docs(spark, sf_dir)
    base = stage_dir(spark, "src_formats")
    info = {}
    for fmt in FILE_FORMATS:
        w = docs.select("text").write.mode("overwrite")
        path = f"{base}/docs_{fmt}"
        if fmt == "csv":
            w.options(header=True, escape='"').csv(path)
        elif fmt == "json":
            w.json(path)
        elif fmt == "text":
            w.text(path)
        else:
            w.parquet(path)
        info[f"docs_{fmt}"] = {"file_name": f"docs_{fmt}", "columns": {"prompt": "text"}}
    write_text(spark, f"{base}/dataset_info.json", _json.dumps(info))
    names = ", ".join(f"docs_{fmt}" for fmt in FILE_FORMATS)
    sets = load_datasets(spark, base, names, system_prompt="A|B")
    stats = [d.groupBy("dataset", "system").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(F.length("prompt")).cast("bigint").alias("n_chars")) for d in sets]
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.select("dataset", "system", "n_rows", "n_chars")


def _stream_input(spark, sf_dir, name, files_per_trigger: int = 4):
    """The filtered documents with their dense ordinal, written as ``STREAM_FILES`` files and read back as a
    stream of micro-batches."""
    docs = _docs(spark, sf_dir)
    base = stage_dir(spark, name)
    rows, n = with_ordinal_n(pretrain_filter(docs, "text"), F.col("doc_id").asc())
    per_file = max(1, -(-n // STREAM_FILES))
    (rows.withColumn("part", (F.col("ordinal") / F.lit(per_file)).cast("bigint"))
         .repartition("part").write.partitionBy("part").parquet(f"{base}/in"))
    stream = read_stream(spark, f"{base}/in", "doc_id bigint, text string, ordinal bigint, part bigint",
                         max_files_per_trigger=files_per_trigger)
    return docs, base, stream_filter(stream.withColumnRenamed("text", "prompt"))


@register("stream_encode")
def q_stream_encode(spark, sf_dir):
    """Documents streamed file by file, filtered, tokenized per micro-batch."""
    StreamRules(max_steps=1000).check()
    docs, base, stream = _stream_input(spark, sf_dir, "stream_encode")
    vocab = build_vocab(pretrain_filter(docs, "text"), "text")
    run_batches(stream, lambda b, i: encode_texts(b, ["doc_id"], "prompt", vocab),
                f"{base}/out", f"{base}/ckpt")
    enc = spark.read.parquet(f"{base}/out")
    return enc.select("doc_id", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("stream_pack")
def q_stream_pack(spark, sf_dir):
    """Streamed packing; every batch of 100 filtered rows, whatever file or micro-batch its rows
    come in, loses its own remainder."""
    StreamRules(max_steps=1000).check()
    docs, base, stream = _stream_input(spark, sf_dir, "stream_pack", 1)
    vocab = build_vocab(pretrain_filter(docs, "text"), "text")
    run_row_batches(stream, lambda rows: pack_text(rows, "ordinal", "prompt", vocab, block=512, batch_rows=PACK_ROWS,
                                                   batch_col="batch"),
                    f"{base}/out", f"{base}/ckpt", f"{base}/carry", PACK_ROWS)
    out = spark.read.parquet(f"{base}/out")
    return out.select("batch", "block", ids_text("input_ids").alias("input_ids"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"))


@register("embed_shards")
def q_embed_shards(spark, sf_dir):
    """Pruned embedding rows written in shards of at most 64 KB of values, read back."""
    base, new = _lang_vocabs(spark, sf_dir)
    old = merge_vocab(base, new)
    rows = gather_rows(remap_ids(new, old), _vocab_rows(spark, sf_dir, old))
    path = stage_dir(spark, "embed_shards")
    dim = rows.select(F.size("vec").alias("d")).first()  # the dimension comes from the data
    bound = shard_rows_for(64 << 10, dim["d"] if dim else 1)
    write_shards(rows, path, bound)
    back = spark.read.parquet(path)
    sizes = back.groupBy(F.input_file_name()).count()
    too_large = sizes.where(F.col("count") > bound).count()
    if too_large:
        raise ValueError(f"{too_large} shards exceed {bound} rows")
    return _row_digest(back)


@register("text_shards")
def q_text_shards(spark, sf_dir):
    """S9 for rows of unequal size: documents in files of at most 1 MB of text, each row read back beside its file's index row."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path, bound = stage_dir(spark, "text_shards"), 1 << 20
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    index = write_byte_shards(docs, path, "doc_id", size, bound).withColumnRenamed("n_bytes", "index_bytes")
    rows = spark.read.parquet(path).select("doc_id", size.alias("n_bytes"), F.col("_metadata.file_path").alias("file"))
    held = rows.join(broadcast_if_small(index, bytes_per_row=400), "file")
    return held.select("doc_id", "n_bytes", ((F.col("index_bytes") <= bound) | (F.col("n_rows") == 1)).alias("fits"),
                       F.col("doc_id").between(F.col("first_key"), F.col("last_key")).alias("covered"))


@register("first_example")
def q_first_example(spark, sf_dir):
    """The first supervised example decoded; ignored label positions show as the pad token."""
    conv = _conv(spark, sf_dir)
    vocab = _conv_vocab(conv)
    ex = sft_examples(sft_rows(conv), "conv_id", "default", vocab, 96, 160)
    first = ex.orderBy("conv_id").limit(1)
    inputs = decode_ids(first, ["conv_id"], "input_ids", vocab, out="inputs")
    labels = decode_ids(first, ["conv_id"], "labels", vocab, out="labels")
    return inputs.join(labels, "conv_id").select("conv_id", "inputs", "labels")


@register("extend_vocab")
def q_extend_vocab(spark, sf_dir):
    """BPE vocabularies learned from English / other documents (400 pieces
    each), the second appended to the first, new rows = mean of their old-piece rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    old = learn_bpe_vocabulary(docs.where("lang = 'en'"), "doc_id", 400)
    new = learn_bpe_vocabulary(docs.where("NOT (lang <=> 'en')"), "doc_id", 400)
    _, rows = extend_vocab(old, new.vocab, _embeddings(spark, sf_dir).select("id", "vec"))
    return _long_out(rows)


@register("stream_split")
def q_stream_split(spark, sf_dir):
    """L3, X3 on a stream: the first 100 filtered rows are the eval set."""
    StreamRules(max_steps=1000, val_size=100).check()
    _, base, stream = _stream_input(spark, sf_dir, "stream_split", 2)
    run_stateless(split_head_stream(stream, 100).select("doc_id", "split"), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("doc_id", "split")


SHUFFLE_BUFFER = 64  # query parameter: rows of a streamed shuffle's buffer


@register("stream_shuffle")
def q_stream_shuffle(spark, sf_dir):
    """L4 on a stream: seeded order (seed 42) inside every buffer of 64 filtered rows."""
    _, base, stream = _stream_input(spark, sf_dir, "stream_shuffle", 2)
    run_row_batches(stream.select("doc_id", "ordinal"), lambda rows: shuffle_buffers(rows, "doc_id", 42, SHUFFLE_BUFFER),
                    f"{base}/out", f"{base}/ckpt", f"{base}/carry", SHUFFLE_BUFFER)
    return spark.read.parquet(f"{base}/out").select("doc_id", F.col("batch").cast("bigint").alias("buffer"),
                                                    F.col("rank").cast("bigint").alias("rank"))


@register("stream_buffer_shuffle")
def q_stream_buffer_shuffle(spark, sf_dir):
    """L4 on a stream: a rolling buffer of 64 filtered rows with seeded replacement (seed 42)."""
    _, base, stream = _stream_input(spark, sf_dir, "stream_buffer_shuffle", 2)
    run_buffer_shuffle(stream.select("doc_id", "ordinal"), f"{base}/out", f"{base}/ckpt", f"{base}/carry", SHUFFLE_BUFFER, 42)
    return spark.read.parquet(f"{base}/out").select("doc_id", "rank")


@register("stream_filter")
def q_stream_filter(spark, sf_dir):
    """Filter and projection as a stateless streaming query into a Parquet sink."""
    _, base, stream = _stream_input(spark, sf_dir, "stream_filter")
    run_stateless(stream.select("doc_id", F.length("prompt").cast("bigint").alias("n_chars")),
                  f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("doc_id", "n_chars")


@register("vocab_sink")
def q_vocab_sink(spark, sf_dir):
    """The merged vocabulary written as a Parquet table and read back."""
    base, new = _lang_vocabs(spark, sf_dir)
    path = stage_dir(spark, "vocab_sink")
    write_vocab(merge_vocab(base, new).table, path)
    return spark.read.parquet(path).select(F.col("id").cast("bigint"), "token", F.col("score").cast("double"))
