"""Column alignment, constant system column, system prompts over
datasets, query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import truthy

# Default source column of each aligned role (None = absent).
DEFAULT_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output", "history": None}
ROLES = ("prompt", "query", "response", "history")


def align_columns(df: DataFrame, columns: dict | None = None) -> DataFrame:
    """Rename each role's source column when it is set and differs from the role name."""
    cols = dict(DEFAULT_COLUMNS)
    if columns is not None:
        cols = {r: columns.get(r) for r in ROLES}
    renames = {}
    for role in ROLES:
        src = cols.get(role)
        if src and src != role:
            if src not in df.columns:
                raise ValueError(f"Column {src} not in the dataset.")
            if role in df.columns:
                raise ValueError(f"Column {role} already in the dataset.")
            renames[src] = role
    df = df.withColumnsRenamed(renames) if renames else df
    return history_as_pairs(df)


def history_as_pairs(df: DataFrame, col: str = "history") -> DataFrame:
    """Raw JSON history reads as ``array<array<string>>``; make it ``array<struct<query, response>>``."""
    if col not in df.columns:
        return df
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
        pairs = F.transform(col, lambda p: F.struct(F.element_at(p, 1).cast("string").alias("query"),
                                                    F.element_at(p, 2).cast("string").alias("response")))
        return df.withColumn(col, pairs)
    return df


def add_system(df: DataFrame, system_prompt: str | None) -> DataFrame:
    """Constant ``system`` column, only when the prompt is truthy."""
    return df.withColumn("system", F.lit(system_prompt)) if system_prompt else df


def system_prompts(system_prompt: str | None, n_datasets: int) -> list[str | None]:
    """The system prompt of each dataset.

    ``'x|y'`` holds several prompts (not stripped); dataset ``i`` gets prompt ``i mod m``, and their
    number ``m`` must divide the number of datasets.  No prompt: None for every dataset.
    """
    if not system_prompt:
        return [None] * n_datasets
    choices = system_prompt.split("|")
    if n_datasets % len(choices) or n_datasets < len(choices):
        raise ValueError(f"{len(choices)} system prompts cannot be spread over {n_datasets} datasets")
    return [choices[i % len(choices)] for i in range(n_datasets)]


def query_text(prompt: Column | str, query: Column | str | None) -> Column:
    """``prompt + '\\n' + query`` when the query is truthy, else the prompt."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    if query is None:
        return p
    q = F.col(query) if isinstance(query, str) else query
    return F.when(truthy(q), F.concat(p, F.lit("\n"), q)).otherwise(p)
