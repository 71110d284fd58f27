"""Aligned instruction rows from a message table ``(conv_id, turn, role, text)``.

Roles follow ``system? (user assistant)* user?``.  One group per conversation is
unavoidable (the output row holds the whole history), and it is bounded by the
length of one conversation, never by a dataset or a key shared across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY_TYPE = "array<struct<query:string,response:string>>"


def messages(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, msgs)`` with ``msgs`` sorted by turn."""
    return conv.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("msgs"))


def _texts(role: str) -> Column:
    return F.transform(F.filter("msgs", lambda m: m["role"] == role), lambda m: m["text"])


def _pairs(users: Column, asst: Column, n: Column) -> Column:
    """First ``n`` (user, assistant) pairs as history structs."""
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
            F.try_element_at(users, i).alias("query"), F.try_element_at(asst, i).alias("response"))),
    ).otherwise(F.array().cast(HISTORY_TYPE))


def _system() -> Column:
    return F.try_element_at(_texts("system"), F.lit(1))


def sft_rows(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """Last complete pair -> prompt/response, earlier pairs -> history; no pair -> null response."""
    m = messages(conv, key)
    users, asst = _texts("user"), _texts("assistant")
    na = F.size(asst)
    return m.select(
        key,
        _system().alias("system"),
        F.try_element_at(users, F.greatest(na, F.lit(1))).alias("prompt"),
        F.lit(None).cast("string").alias("query"),
        F.when(na > 0, F.try_element_at(asst, na)).alias("response"),
        _pairs(users, asst, na - 1).alias("history"),
    )


def prompt_rows(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """Last user message -> prompt, pairs before it -> history, its answer (or '') -> response."""
    m = messages(conv, key)
    users, asst = _texts("user"), _texts("assistant")
    nu = F.size(users)
    return m.select(
        key,
        _system().alias("system"),
        F.try_element_at(users, F.greatest(nu, F.lit(1))).alias("prompt"),
        F.lit(None).cast("string").alias("query"),
        F.coalesce(F.try_element_at(asst, F.greatest(nu, F.lit(1))), F.lit("")).alias("response"),
        _pairs(users, asst, nu - 1).alias("history"),
    )


def pair_rows(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """First user message -> prompt; all assistant answers -> ``response`` array (chosen, rejected, ...)."""
    m = messages(conv, key)
    users, asst = _texts("user"), _texts("assistant")
    return m.select(
        key,
        _system().alias("system"),
        F.try_element_at(users, F.lit(1)).alias("prompt"),
        F.lit(None).cast("string").alias("query"),
        asst.alias("response"),
        F.array().cast(HISTORY_TYPE).alias("history"),
    )
