"""String Column helpers (all JVM-side built-ins, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the word separator of the whitespace vocabulary (space, tab, newline,
# carriage return, form feed). Same class in Java regex and RE2, so DuckDB agrees.
WORD_SPLIT = r"[ \t\n\r\f]+"


def words(text: Column | str) -> Column:
    """Non-empty whitespace-separated words of ``text`` (array<string>, [] for null)."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(col, F.lit("")), WORD_SPLIT)
    return F.filter(parts, lambda w: w != "")


def truthy(col: Column | str) -> Column:
    """Python truthiness of a string cell: not null and not ''. Blank strings pass."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (c != "")


def replace_first(s: Column, needle: str, repl: Column) -> Column:
    """``s.replace(needle, repl, 1)``: literal search, no regex, ``$`` and ``\\`` left alone."""
    pos = F.instr(s, needle)
    head = s.substr(F.lit(1), pos - 1)
    tail = s.substr(pos + F.lit(len(needle)), F.lit(2147483647))
    return F.when(pos > 0, F.concat(head, repl, tail)).otherwise(s)


def replace_all_literal(template: str, needle: str, repl: Column) -> Column:
    """``template.replace(needle, repl)`` for a plan-time template string."""
    pieces = template.split(needle)
    out: list[Column] = [F.lit(pieces[0])]
    for p in pieces[1:]:
        out.extend([repl, F.lit(p)])
    return F.concat(*out) if len(out) > 1 else out[0]
