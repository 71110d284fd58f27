"""WARC derivatives: linked metadata and plain-text conversion records of responses.

:func:`responses` turns pages into ``response`` records (WARC headers, HTTP header block, payload, digests);
:func:`derive` turns every response into a ``metadata`` record (a JSON envelope with the source record's
headers, the HTTP headers and what the page's head and links say) and a ``conversion`` record (the page's
text).  Both carry ``WARC-Refers-To`` with the response's record id, its target URI and its date, and digests of
their own blocks; the envelope keeps the source's block and payload digests.  Record ids are derived
from the response (id, kind), so a repeated task writes the same records.

Both steps are narrow passes: no shuffle, memory of one Arrow batch.

Defined results: a null or empty page gives a response with an empty payload and derivatives with empty text;
a null url is an empty target; rows with a null page id keep it null (their record ids come from url and
payload); repeated rows give repeated records with equal ids; unclosed tags and stray ``<`` are text or are
skipped up to the next ``>``; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"     # pages carry no time: the date of a record is a parameter
CRLF = "\r\n"
# Elements that begin a new line of text.
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 head header hr html legend li main nav ol option p pre section select table tbody td tfoot th thead "
                   "title tr ul".split())
_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|[!?][^<>]*>"
                     r"|/?([a-z][a-z0-9]*)[^<>]*>)", re.I | re.S)
_LINK = re.compile(r"""<(a|link|area|img|iframe|source)\b[^<>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s<>"']+))""", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_CHARSET = re.compile(r"""<meta\b[^<>]*?\bcharset\s*=\s*["']?([\w-]+)""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """Text of a page: markup, scripts and comments removed, entities resolved, one line per block."""
    out = []
    pieces = _MARKUP.split(page)
    for i in range(0, len(pieces), 3):
        out.append(pieces[i])
        if i + 2 < len(pieces) and pieces[i + 2] and pieces[i + 2].lower() in BLOCKS:
            out.append("\n")
    lines = (" ".join(line.split()) for line in entities.unescape("".join(out)).split("\n"))
    return "\n".join(filter(None, lines))


def page_facts(page: str) -> dict:
    """Title, language, charset and links of a page."""
    def first(pattern):
        m = pattern.search(page)
        return entities.unescape(m[1]).strip() if m else None
    links = [{"path": f"{m[1].lower()}@/{'src' if m[1].lower() in ('img', 'iframe', 'source') else 'href'}",
              "url": entities.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(page)]
    return {"Title": first(_TITLE), "Lang": first(_LANG), "Charset": first(_CHARSET), "Links": links}


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record: version, headers, block."""
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in headers) + CRLF
    return head.encode() + block + (CRLF * 2).encode()


def parse_record(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of a whole record."""
    head, rest = raw.split((CRLF * 2).encode(), 1)
    version, *lines = head.decode().split(CRLF)
    if not version.startswith("WARC/1."):
        raise ValueError("not a record")
    headers = [tuple(x.split(": ", 1)) for x in lines]
    return headers, rest[:int(dict(headers)["Content-Length"])]


_HEADERS = pa.map_(pa.string(), pa.string())
_RESPONSE = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc", _HEADERS),
                       ("http", pa.string()), ("payload", pa.string())])
_RESPONSE_SQL = "page_id long, record_id string, target_uri string, warc map<string,string>, http string, payload string"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of (page_id, url, html)."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                url, payload = _one_line(url or ""), (page or "").encode()
                http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF * 2}"
                rid = record_id(str(page_id), url, hashlib.sha1(payload).hexdigest())
                block = http.encode() + payload
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url),
                           ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                           ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                for c, v in zip(out, (page_id, rid, url, headers, http, page or "")):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _RESPONSE)], schema=_RESPONSE)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) \
        .mapInArrow(run, _RESPONSE_SQL)


_DERIVED = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
                      ("target_uri", pa.string()), ("headers", _HEADERS), ("block", pa.string()), ("block_digest", pa.string()),
                      ("source_payload_digest", pa.string()), ("content_length", pa.int64()), ("record_sha256", pa.string())])
_DERIVED_SQL = ("page_id long, kind string, record_id string, refers_to string, target_uri string, headers map<string,string>, "
                "block string, block_digest string, source_payload_digest string, content_length long, record_sha256 string")


def derivatives(source: dict, http: str, payload: str):
    """The metadata and the conversion record of one response: (kind, headers, block)."""
    fields = [x.split(": ", 1) for x in http.strip().split(CRLF)]
    envelope = {"Envelope": {
        "WARC-Header-Metadata": source,
        "Payload-Metadata": {"HTTP-Response-Metadata": {
            "Status": fields[0][0], "Headers": {x[0]: x[1] for x in fields[1:] if len(x) == 2},
            "HTML-Metadata": page_facts(payload)}}}}
    for kind, mime, block in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False)),
                              ("conversion", "text/plain", plain_text(payload))):
        raw = block.encode()
        yield kind, [("WARC-Type", kind), ("WARC-Record-ID", record_id(source["WARC-Record-ID"], kind)),
                     ("WARC-Date", source["WARC-Date"]), ("WARC-Target-URI", source["WARC-Target-URI"]),
                     ("WARC-Refers-To", source["WARC-Record-ID"]), ("WARC-Refers-To-Target-URI", source["WARC-Target-URI"]),
                     ("WARC-Refers-To-Date", source["WARC-Date"]), ("WARC-Block-Digest", digest(raw)),
                     ("Content-Type", mime), ("Content-Length", str(len(raw)))], block


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response record: its metadata and its conversion record."""
    def run(batches):
        for b in batches:
            out = [[] for _ in _DERIVED]
            for page_id, rid, uri, warc, http, payload in zip(*(c.to_pylist() for c in b.columns)):
                source = dict(warc)
                for kind, headers, block in derivatives(source, http, payload):
                    h = dict(headers)
                    row = (page_id, kind, h["WARC-Record-ID"], rid, uri, headers, block, h["WARC-Block-Digest"],
                           source["WARC-Payload-Digest"], int(h["Content-Length"]),
                           hashlib.sha256(warc_bytes(headers, block.encode())).hexdigest())
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _DERIVED)], schema=_DERIVED)
    return records.select(*_RESPONSE.names).mapInArrow(run, _DERIVED_SQL)
