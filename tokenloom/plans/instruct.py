"""Instruction data: aligned rows -> template -> supervised / prompt-only / pairwise examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import examples as ex
from ..operators.align import query_text
from ..operators.filters import pair_filter, prompt_only_filter, sft_filter
from ..operators.templates import (Template, effective_system, get_template, id_seg, render_turns,
                                   seg_array, special_ids, text_seg, turns_of)
from ..operators.vocab import Vocabulary


def _tpl(template: str | Template) -> Template:
    return template if isinstance(template, Template) else get_template(template)


def render(rows: DataFrame, template: str | Template, vocab: Vocabulary, response=None) -> DataFrame:
    """Adds ``pairs`` (rendered segments per turn) to aligned rows."""
    tpl = _tpl(template)
    ids = special_ids(tpl, vocab)
    q = query_text("prompt", "query" if "query" in rows.columns else None)
    sys = effective_system(tpl, F.col("system") if "system" in rows.columns else F.lit(None).cast("string"))
    hist = F.col("history") if "history" in rows.columns else F.lit(None)
    resp = F.col("response") if response is None else response
    turns = turns_of(tpl, hist, q, resp)
    return rows.withColumn("pairs", render_turns(tpl, turns, sys, ids)), ids


def sft_examples(rows: DataFrame, key: str, template: str | Template, vocab: Vocabulary,
                 max_source_length: int = 512, max_target_length: int = 512) -> DataFrame:
    """F2 -> render -> tokenize -> Q3/Q4/Q5/Q6."""
    r, _ = render(sft_filter(rows), template, vocab)
    enc = ex.encode_units(r.select(key, ex.units(F.col("pairs")).alias("u")), key, "u", vocab)
    ids, mask, labels = ex.supervised(ex.pair_ids(enc), max_source_length, max_target_length)
    return enc.select(key, ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def prompt_examples(rows: DataFrame, key: str, template: str | Template, vocab: Vocabulary,
                    max_source_length: int = 512, max_target_length: int = 512) -> DataFrame:
    """F4 -> render -> tokenize -> T7/Q7."""
    r, _ = render(prompt_only_filter(rows), template, vocab)
    enc = ex.encode_units(r.select(key, ex.units(F.col("pairs")).alias("u")), key, "u", vocab)
    ids, mask, labels = ex.unsupervised(ex.pair_ids(enc), max_source_length, max_target_length)
    return enc.select(key, ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def pair_examples(rows: DataFrame, key: str, template: str | Template, vocab: Vocabulary,
                  max_source_length: int = 512, max_target_length: int = 512) -> DataFrame:
    """F3 -> render with the chosen answer, second target = rejected answer -> Q8."""
    kept = pair_filter(rows)
    r, ids = render(kept, template, vocab, response=F.element_at("response", 1))
    rejected = seg_array([text_seg(F.element_at("response", 2)), id_seg(ids.eos, ids.eos_name)])
    u = r.select(key, ex.units(F.col("pairs"), rejected).alias("u"))
    enc = ex.encode_units(u, key, "u", vocab)
    p, c, rj = ex.pairwise(ex.pair_ids(enc), ex.alt_ids(), max_source_length, max_target_length)
    return enc.select(key, p.alias("prompt_ids"), c.alias("chosen_ids"), rj.alias("rejected_ids"))


STAGES = ("sft", "rm", "ppo", "dpo")


def prepare_examples(spark, dataset_dir: str, dataset: str, stage: str, template: str | Template,
                     vocab: Vocabulary, max_source_length: int = 512, max_target_length: int = 512,
                     predict_with_generate: bool = False, system_prompt: str | None = None,
                     max_samples: int | None = None, val_size: float = 0.0, seed: int = 42,
                     mix_strategy: str = "concat", interleave_probs: list[float] | None = None,
                     schemas: dict | None = None) -> dict:
    """Instruction data end to end: registry -> read + align -> datasets mixed by ``mix_strategy`` in
    ingest order -> the stage's filter and encoder (sft, rm, or prompt-only for ppo / dpo /
    generation) -> optional exact seeded split."""
    from ..operators.mix import mix
    from ..operators.split import split_exact
    from ..sources.files import load_datasets

    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}: one of {', '.join(STAGES)} (pretraining has its own flow)")
    sets = load_datasets(spark, dataset_dir, dataset, system_prompt, max_samples, schemas)
    cols = ["prompt", "query", "response", "history", "system"]
    parts = [d.select("ordinal", *[c for c in cols if c in d.columns]) for d in sets]
    rows = mix(parts, "ordinal", mix_strategy, interleave_probs, seed)
    if stage == "sft" and not predict_with_generate:
        out = sft_examples(rows, "position", template, vocab, max_source_length, max_target_length)
    elif stage == "rm":
        out = pair_examples(rows, "position", template, vocab, max_source_length, max_target_length)
    else:
        out = prompt_examples(rows, "position", template, vocab, max_source_length, max_target_length)
    if val_size <= 1e-6:
        return {"train_dataset": out}
    split = split_exact(out, "position", val_size, seed=seed)
    return {"train_dataset": split.where(F.col("split") == "train").drop("split"),
            "eval_dataset": split.where(F.col("split") == "eval").drop("split")}
