"""Chat formatting with typed content parts.

A conversation's turn is an ordered list of parts (text, image, audio, document).  A visitor walks the
parts and emits text (escaped) and, for the other kinds, numbered placeholders; it records for each
placeholder the attachment's reference and the tokens it expands to.  A formatted turn is::

    <|turn|>role\\n  body  </turn>\\n

and a loss span marks the body of each turn of the trained role.  Texts can say anything: an escape
character and each control string are replaced by escape sequences (``\\\\`` for the escape character,
``\\l`` for the ``<`` that opens a control string, ``\\n`` for a line break in a role), so control strings
occur only where the template puts them, and :func:`read_turns` gets back the exact texts.

Distribution: rows are shuffled once by conversation and sorted inside partitions; a conversation is
streamed turn by turn, so one of any length needs the memory of one turn.  The output has one row per
turn, in order, with the turn's place in the formatted conversation.

Defined results: a null text is an empty text, a null role an empty role, null parts no parts; a null turn
sorts first; rows that repeat a turn stay, ordered by role, then text; a null conversation id is a
conversation of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, STOP = "<|turn|>", "</turn>\n"
ESCAPE = "\\"
#: strings that mean something in the formatted text; every one begins with "<"
CONTROL = ("<|turn|>", "</turn>", "<|image:", "<|audio:", "<|document:")
_OPEN = re.compile("|".join(re.escape(c) for c in CONTROL))
_BACK = {"\\": "\\", "l": "<", "n": "\n"}
_SEQUENCE = re.compile(r"\\(.)", re.S)

PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

# Tokens of an attachment.
PATCH = 14               # pixels on a side per image token
AUDIO_RATE = 25          # tokens per second of audio
PAGE_TOKENS = 256        # tokens per document page


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: ESCAPE + "l" + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _SEQUENCE.sub(lambda m: _BACK[m[1]], text)


class PartVisitor:
    """Flattens the parts of one conversation's turns; attachments are numbered through."""

    def __init__(self):
        self.count = 0

    def text(self, part):
        return escape(part.get("text") or ""), None

    def _attach(self, kind, part, tokens):
        place = f"<|{kind}:{self.count}|>"
        record = {"n": self.count, "kind": kind, "ref": part.get("ref"), "tokens": max(int(tokens), 1)}
        self.count += 1
        return place, record

    def image(self, part):
        w, h = part.get("width") or 0, part.get("height") or 0
        return self._attach("image", part, -(-w // PATCH) * -(-h // PATCH))

    def audio(self, part):
        return self._attach("audio", part, -(-(part.get("seconds") or 0) * AUDIO_RATE // 1))

    def document(self, part):
        return self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit(self, part):
        kind = part.get("kind") or "text"
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown part kind: {kind}")
        return getattr(self, kind)(part)


_ATTACH = pa.list_(pa.struct([("n", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
_OUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()),
                  ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", _ATTACH)])
_OUT_SQL = ("conv_id long, seq long, start long, formatted string, loss_start long, loss_end long, "
            "attachments array<struct<n:long,kind:string,ref:string,tokens:long>>")


def _format(trained: str):
    def run(batches):
        seen, current, seq, start, visitor = False, None, 0, 0, None
        for b in batches:
            cols = [[] for _ in range(7)]
            for conv, role, text, parts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "parts"))):
                if not seen or conv != current:
                    seen, current, seq, start, visitor = True, conv, 0, 0, PartVisitor()
                head = TURN + escape(role or "").replace("\n", ESCAPE + "n") + "\n"
                flat = [visitor.visit(p) for p in ([{"text": text}] if parts is None else parts) if p is not None]
                body = "".join(x for x, _ in flat)
                whole = head + body + STOP
                on = role == trained
                row = (conv, seq, start, whole, len(head) if on else None, len(head) + len(body) if on else None,
                       [r for _, r in flat if r])
                for c, v in zip(cols, row):
                    c.append(v)
                seq, start = seq + 1, start + len(whole)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)
    return run


def format_chat(turns: DataFrame, trained_role: str = "assistant", partitions: int | None = None) -> DataFrame:
    """Formatted turns of (conv_id, turn, role, text[, parts]): see the module's text.

    ``parts`` (``PART_TYPE``) replaces ``text`` where it is not null.  The output is partitioned by
    conversation and ordered by ``seq`` inside it; ``start`` is the turn's place in the conversation
    and the loss span is relative to the turn, both in code points.
    """
    spark = turns.sparkSession
    parts = F.col("parts").cast(PART_TYPE) if "parts" in turns.columns else F.lit(None).cast(PART_TYPE)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                        parts.alias("parts"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "role", "text", "parts").mapInArrow(_format(trained_role), _OUT_SQL)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; placeholders stay in the text."""
    if not (formatted.startswith(TURN) and formatted.endswith(STOP)):
        raise ValueError("not a formatted turn")
    head, body = formatted[len(TURN):-len(STOP)].split("\n", 1)
    return unescape(head), unescape(body)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()),
                   ("expanded_tokens", pa.int64())])


def _read(batches):
    current = None  # [conv_id, turns, digest, loss characters, loss digest, characters, attachments, tokens]

    def row(c):
        return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5], c[6], c[7]
    for b in batches:
        done = []
        for conv, seq, text, lo, hi, files in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "seq", "formatted", "loss_start", "loss_end", "attachments"))):
            if seq == 0:
                if current:
                    done.append(row(current))
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, body = parse_turn(text)
            current[1] += 1
            current[2].update(f"{role}\n{body}\n".encode())
            if lo is not None:
                loss = unescape(text[lo:hi])
                current[3] += len(loss)
                current[4].update(loss.encode())
            current[5] += len(text)
            current[6] += len(files)
            current[7] += sum(f["tokens"] for f in files)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * 8, _READ)],
                                         schema=_READ)
    if current:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(current), _READ)], schema=_READ)


def read_turns(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the formatted turns (streamed in their order)."""
    return formatted.select("conv_id", "seq", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long, n_attachments long, expanded_tokens long")


def round_trip(turns: DataFrame, path: str) -> DataFrame:
    """Formats, writes the formatted turns to ``path`` and reads the digests from there.

    Files may be read in any order and packed together, so rows are dealt and sorted again.
    """
    spark = turns.sparkSession
    format_chat(turns).write.parquet(path)
    out = spark.read.schema(_OUT_SQL).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_turns(out.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq"))
