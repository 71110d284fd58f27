"""Token counts by section: whole documents are encoded once, token spans are joined to section spans.

A document is encoded whole; the bytes of its tokens give each token's span.  Sections are spans of code
points (``start``, ``end``) in ascending order that do not overlap; without a sections column they are the lines of
the text, each with its line break.  The interval join is a binary search of token ends among section borders.

Rule for a token that crosses a border: it is allocated whole to the section that holds most of its bytes,
ties to the earlier section; bytes in no section count for the gap they lie in, and a token allocated to
a gap is reported under section -1.  So the counts of a document always add up to its tokens.

Defined results: a null text is empty; a document without sections, or an empty one, gives one row of
section -1 with its tokens (0 if empty); repeated rows and null ids give rows of their own; a null section is
ignored, spans are cut to the text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.byte_bpe import load_ranks

SECTION = "array<struct<start:bigint,end:bigint>>"


@functools.lru_cache(1)
def _encoding(data: bytes, pattern: str):
    import tiktoken
    ranks = load_ranks(data)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        length[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def byte_positions(text: str, raw: bytes) -> np.ndarray | None:
    """Byte position of every code point and of the end; None if they are the same."""
    if len(raw) == len(text):
        return None
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(raw))


def line_sections(text: str) -> np.ndarray:
    """(n, 2) spans of the lines, line breaks included."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return np.array([cuts[:-1], cuts[1:]], np.int64).T


def allocate(ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a border.

    ``ends``: byte ends of the tokens, which tile the text; ``spans``: byte spans of the sections.
    """
    starts = np.append(0, ends[:-1])
    # borders cut the text into stretches: gap, section 0, gap, section 1, ... , gap (some of no length)
    borders = spans.ravel()
    first = np.searchsorted(borders, starts, "right")
    last = np.searchsorted(borders, ends - 1, "right")
    best = first.copy()
    cross = np.flatnonzero(first != last)
    for t in cross.tolist():
        edges = np.concatenate(([starts[t]], borders[first[t]:last[t]], [ends[t]]))
        best[t] = first[t] + int(np.argmax(np.diff(edges)))
    section = np.where(best % 2 == 1, best // 2, -1)
    crossing = np.zeros(len(ends), bool)
    crossing[cross] = True
    # a border without bytes between two sections that touch is no gap: odd stretches alone tell sections apart
    return section, crossing


_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                  ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def attribute_tokens(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     sections_col: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens, n_crossing (tokens that cross its borders).

    Row -1 holds the tokens of gaps, if there are any.
    """
    with open(rank_file, "rb") as f:
        data = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(data)  # the vocabulary file: under 1 MB

    def run(batches):
        enc, length = _encoding(shipped.value, pattern)
        for b in batches:
            out = [[] for _ in _OUT]
            held = 0
            given = b.column(2).to_pylist() if sections_col else None
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = text or ""
                spans = line_sections(text) if given is None else np.array(
                    [(s["start"], s["end"]) for s in given[i] or [] if s is not None and None not in (s["start"], s["end"])],
                    np.int64).reshape(-1, 2)
                spans = np.clip(spans, 0, len(text))
                if (np.diff(spans.ravel()) < 0).any():
                    raise ValueError("sections must be in ascending order and must not overlap")
                raw = text.encode()
                at = byte_positions(text, raw)
                ends = np.cumsum(length[np.array(enc.encode_ordinary(text), np.int64)])
                section, crossing = allocate(ends, spans if at is None else at[spans]) if len(ends) else (np.zeros(0, np.int64),) * 2
                n = len(spans)
                tokens = np.bincount(section + 1, minlength=n + 1)
                cross = np.bincount(section[crossing.astype(bool)] + 1, minlength=n + 1)
                rows = range(0 if tokens[0] or not n else 1, n + 1)
                out[0] += [doc] * len(rows)
                out[1] += [r - 1 for r in rows]
                out[2] += [int(spans[r - 1, 0]) if r else 0 for r in rows]
                out[3] += [int(spans[r - 1, 1]) if r else len(text) for r in rows]
                out[4] += tokens[rows.start:].tolist()
                out[5] += cross[rows.start:].tolist()
                held += len(rows)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)
                    out, held = [[] for _ in _OUT], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT)], schema=_OUT)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).cast(SECTION).alias("sections"))
    return docs.select(*cols).mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
