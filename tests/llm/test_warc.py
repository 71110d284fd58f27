import base64
import hashlib
import json

from tokenloom.llm import warc as W

PAGE = """<!DOCTYPE html><html lang="de"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{x}</style>
<script>var t="</p>";</script></head><body><!-- <p>no</p> --><p>One <b>two</b><br>three &lt;four&gt;</p><a href="/x?a=1&amp;b=2">link</a>
<img src='p.png'><ul><li>i</li><li>j</li></ul> 5 < 6 and <unclosed"""


def test_text_and_facts():
    assert W.plain_text(PAGE) == "A & B\nOne two\nthree <four>\nlink\ni\nj\n5 < 6 and <unclosed"
    facts = W.page_facts(PAGE)
    assert (facts["Title"], facts["Lang"], facts["Charset"]) == ("A & B", "de", "utf-8")
    assert facts["Links"] == [{"path": "a@/href", "url": "/x?a=1&b=2"}, {"path": "img@/src", "url": "p.png"}]


def test_hard_pages_end():
    for page in ("<" * 50_000, "<a " * 30_000, "<!--" * 20_000, "<script>" * 20_000, "<title>" * 20_000, "&" * 50_000, "a\n \n" * 50_000):
        W.plain_text(page)
        W.page_facts(page)


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, record_id string, kind string")


def test_records_are_linked(spark):
    df = rows(spark, [(1, "http://e.org/\r\nx", PAGE, "z", "z"), (2, None, None, "z", "z"), (None, "u", "", "z", "z"),
                      (1, "http://e.org/\r\nx", PAGE, "z", "z"), (4, "big", "<p>wörd " * 60_000, "z", "z")])
    source = W.responses(df).collect()
    got = W.derive(W.responses(df)).collect()
    assert len(source) == 5 and len(got) == 10
    by_id = {r.record_id: r for r in source}
    for r in got:
        s, h, block = by_id[r.refers_to], r.headers, r.block.encode()
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Target-URI"] == s.warc["WARC-Target-URI"] == r.target_uri
        assert h["WARC-Refers-To-Date"] == h["WARC-Date"] == s.warc["WARC-Date"] and h["WARC-Type"] == r.kind
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert r.content_length == len(block) == int(h["Content-Length"])
        assert r.source_payload_digest == s.warc["WARC-Payload-Digest"] == W.digest(s.payload.encode())
        assert s.warc["WARC-Block-Digest"] == W.digest((s.http + s.payload).encode())
        assert "\n" not in r.target_uri
        if r.kind == "metadata":
            e = json.loads(r.block)["Envelope"]
            assert e["WARC-Header-Metadata"] == s.warc and e["Payload-Metadata"]["HTTP-Response-Metadata"]["Status"] == "HTTP/1.1 200 OK"
        else:
            assert r.block == W.plain_text(s.payload)
    assert len({r.record_id for r in got}) == 8       # the repeated page repeats its records
    assert W.derive(W.responses(df.limit(0))).collect() == []


def test_record_bytes_round_trip():
    source = {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": W.DATE, "WARC-Target-URI": "http://é.org"}
    for kind, headers, block in W.derivatives(source, "HTTP/1.1 200 OK\r\n", PAGE):
        assert W.parse_record(W.warc_bytes(headers, block.encode())) == (headers, block.encode())
