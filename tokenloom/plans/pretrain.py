"""Continued pretraining: documents -> F1 -> ordinal -> whitespace ids -> packed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import pretrain_filter
from ..operators.ordinal import assign_batches
from ..operators.pack import pack_text
from ..operators.vocab import Vocabulary, build_vocab
from ..sources.sinks import fingerprint, stage_table


def pretrain_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    vocab: Vocabulary | None = None, block: int = 512,
                    batch_rows: int = 1000, cache_path: str | None = None,
                    overwrite_cache: bool = False) -> DataFrame:
    """Blocks of ``block`` ids per batch of ``batch_rows`` filtered rows, in row order.

    Without a vocabulary one is learned from the same documents (count desc, token).
    With ``cache_path`` the encoded table is written there and reused by later calls for
    the same inputs, vocabulary and settings unless ``overwrite_cache`` (S7).
    """
    if cache_path is not None:
        special = None if vocab is None else [vocab.size, vocab.unk_id, vocab.bos_id, vocab.eos_id,
                                              fingerprint(vocab.table)]
        name = fingerprint(docs, key=key, text=text, block=block, batch_rows=batch_rows, vocab=special)
        return stage_table(lambda: pretrain_blocks(docs, key, text, vocab, block, batch_rows), docs.sparkSession,
                           cache_path, name, overwrite_cache)
    rows = pretrain_filter(docs.select(key, F.col(text).alias("prompt")), "prompt")
    if vocab is None:
        vocab = build_vocab(rows, "prompt")
    rows = assign_batches(rows, key, batch_rows, name="_bt")
    return pack_text(rows, key, "prompt", vocab, block=block, batch_rows=batch_rows, batch_col="_bt")


def prepare_pretraining(spark, dataset_dir: str, dataset: str, vocab: Vocabulary | None = None,
                        block: int = 512, batch_rows: int = 1000, val_size: float = 0.0, seed: int = 42,
                        system_prompt: str | None = None, max_samples: int | None = None,
                        cache_path: str | None = None, overwrite_cache: bool = False,
                        mix_strategy: str = "concat", interleave_probs: list[float] | None = None,
                        schemas: dict | None = None) -> dict:
    """The pretraining preparation end to end: registry -> read + align (datasets mixed by
    ``mix_strategy``, in their ingest order) -> F1 -> ids -> blocks -> train/eval split of the
    blocks (exact seeded split; no eval set when ``val_size`` is 0).

    Returns ``{"train_dataset": df}`` or ``{"train_dataset": df, "eval_dataset": df}``.
    """
    from ..operators.mix import mix
    from ..operators.split import split_exact
    from ..sources.files import load_datasets

    sets = load_datasets(spark, dataset_dir, dataset, system_prompt, max_samples, schemas)
    mixed = mix([d.select("ordinal", "prompt") for d in sets], "ordinal", mix_strategy, interleave_probs, seed)
    blocks = pretrain_blocks(mixed.select("position", F.col("prompt").alias("text")), key="position",
                             vocab=vocab, block=block, batch_rows=batch_rows,
                             cache_path=cache_path, overwrite_cache=overwrite_cache)
    if val_size <= 1e-6:
        return {"train_dataset": blocks}
    keyed = blocks.withColumn("_k", F.concat_ws(":", F.col("batch").cast("string"), F.col("block").cast("string")))
    split = split_exact(keyed, "_k", val_size, seed=seed)
    return {"train_dataset": split.where(F.col("split") == "train").drop("_k", "split"),
            "eval_dataset": split.where(F.col("split") == "eval").drop("_k", "split")}
