"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored at the hits, checksums.

One automaton holds the key words of every kind (ASCII case folded); runs of hex digits
have no key word and get a sampling prefilter of their own.  A kind's expression is tried at its hits only, from left to right, and never inside
the kind's previous match, which gives the leftmost non-overlapping matches of a full scan.

Kinds in listed order: assign, access, hex (the base kinds, kept whenever the pattern fits), then
kinds whose value carries its own proof and is kept only if the proof holds:

- ``github``, ``npm``: 30 characters, then their CRC-32 in base 62, six digits;
- ``jwt``: a base64url header that decodes to a JSON object with ``alg``, then payload and signature;
- ``card``: 16 digits after a key word such as ``card`` whose Luhn sum is right.

Spans are in code points, end exclusive.  Defined results: a null text is an empty text without
spans; every input row gives one output row (repeated rows as well); a null id stays null; texts of
any length are scanned whole, in time linear in their length; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_MIN = 16
BASE_KINDS = ("assign", "access", "hex")

# Published token prefixes with an embedded checksum, and the digits of base 62.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
CARD = re.compile(r"(?:card|visa|mastercard)[ :=#]{1,3}((?:\d{4}[ -]?){3}\d{4})(?!\d)", re.I | re.A)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "card")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "card": ("card", "visa", "mastercard"),
}
HEX_DIGITS = "0123456789abcdef"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _jwt_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


#: kind -> (pattern, test of a match)
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_MIN),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_MIN),
    "github": (GITHUB, lambda m: base62_crc(m[1]) == m[2]),
    "npm": (NPM, lambda m: base62_crc(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _jwt_header(m[1])),
    "card": (CARD, lambda m: luhn(re.sub(r"\D", "", m[1]))),
}


#: Kinds that begin with an unbounded run: where one fails, so does every later hit of the kind inside that run,
#: as all of them depend on what follows the run.  Each run is then read a fixed number of times.
RUNS = {"jwt": re.compile(r"eyJ[A-Za-z0-9_-]*+")}


@functools.cache
def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _fold(text: str) -> str:
    """A-Z to a-z, every other code point unchanged (so that positions stay)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


PROBE = 4
_PROBES = re.compile(r"[0-9a-f]{%d,}" % (HEX_MIN // PROBE))


def _hex_runs(text: str):
    """Maximal runs of at least ``HEX_MIN`` hex digits.

    Hex has no key word; its prefilter reads every fourth character: a run of 16 covers four of
    those in a row, so the anchored expression is only tried where four in a row are hex digits.
    """
    done = 0
    for near in _PROBES.finditer(text[PROBE - 1::PROBE]):
        for at in range(near.start() * PROBE + PROBE - 1, near.end() * PROBE, PROBE):
            if at < done:
                continue
            start = at
            while start > done and text[start - 1] in HEX_DIGITS:
                start -= 1
            m = HEX.match(text, start)
            done = m.end()
            if m.end() - m.start() >= HEX_MIN:
                yield m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind as listed."""
    if not text:
        return []
    out, done = [], dict.fromkeys(KINDS, 0)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(_fold(text)):
        starts.setdefault(kind, []).append(end - n + 1)
    for kind, at in starts.items():
        pattern, test = RULES[kind]
        for s in sorted(at):  # a long key word may end after a short one that starts later
            if s < done[kind]:
                continue
            if m := pattern.match(text, s):
                done[kind] = m.end()
                if test(m):
                    out.append((kind, m.start(), m.end()))
            elif kind in RUNS and (run := RUNS[kind].match(text, s)):
                done[kind] = run.end()
    out += [("hex", s, e) for s, e in _hex_runs(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every maximal stretch of overlapping spans replaced by ``mark``."""
    if not text:
        return text
    out, pos, stop = [], 0, 0
    for _, s, e in find_spans(text):
        if s < stop:
            stop = max(stop, e)
            continue
        if stop:
            pos = stop
        out += [text[pos:s], mark]
        stop = e
    if not out:
        return text
    return "".join(out) + text[stop:]


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                       ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                       ("n_spans", pa.int64())])

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for text in b.column(1):
                spans = find_spans(text.as_py())
                base = [x for x in spans if x[0] in BASE_KINDS]
                for i, kind in enumerate(BASE_KINDS):
                    cols[i].append(sum(x[0] == kind for x in base))
                cols[3].append(hashlib.sha256(_join(base).encode()).hexdigest())
                cols[4].append(_join(spans))
                cols[5].append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, t) for c, t in zip(cols, arrow.types[1:])], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redact_column(text_col) -> "F.Column":
    """Column expression: the text with its secrets replaced (Arrow-batched)."""
    @F.pandas_udf("string")
    def apply(texts):
        return texts.map(redact, na_action="ignore")
    return apply(text_col)
