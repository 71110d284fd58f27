"""Array Column helpers for token sequences (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label id that the loss ignores.
IGNORE_INDEX = -100


def ids_text(col: Column | str) -> Column:
    """``[1, 2, 3]`` -> ``'1 2 3'`` (how arrays are compared with the SQL oracle)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def chunk(ids: Column, block: int) -> Column:
    """Full blocks of ``block`` ids; the remainder is dropped, short input gives []."""
    n = F.floor(F.size(ids) / F.lit(block)).cast("int")
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, i * block + 1, F.lit(block))),
    ).otherwise(F.array().cast("array<array<int>>"))
