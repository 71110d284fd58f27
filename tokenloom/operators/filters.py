"""The stage filters, as Column predicates (pushed down where possible)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy


def pretrain_filter(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """F1 (and F4): prompt not null and not ''; blank strings pass."""
    return df.where(truthy(prompt))


def sft_filter(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """prompt and response truthy."""
    return df.where(truthy(prompt) & truthy(response))


def pair_filter(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """prompt truthy and more than one response (a null response drops the row)."""
    return df.where(truthy(prompt) & F.col(response).isNotNull() & (F.size(response) > 1))


def prompt_only_filter(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """ppo, dpo, and sft with generation: prompt truthy only."""
    return pretrain_filter(df, prompt)


def stage_filter(df: DataFrame, stage: str, predict_with_generate: bool = False) -> DataFrame:
    if stage == "pt":
        return pretrain_filter(df)
    if stage == "sft" and not predict_with_generate:
        return sft_filter(df)
    if stage == "rm":
        return pair_filter(df)
    return prompt_only_filter(df)

