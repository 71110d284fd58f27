import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import chat as C
from tokenloom.llm import queries as Q
from tokenloom.session import stage_dir

SF_SMALL = "/root/testdata/sf0.001"
TRAPS = ["\\", "<", "|", "<|turn|>", "</turn>", "</turn>\n", "<|image:", "<|image:0|>", "l", "n", "\n", "a", "é", "\\l", "### Assistant: "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TRAPS), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)
    turn = C.TURN + C.escape(text).replace("\n", "\\n") + "\n" + e + C.STOP
    assert C.parse_turn(turn) == (text, text)


def test_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, text string, parts {C.PART_TYPE}"

    def part(kind, **x):
        return (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [(1, 0, "user", None, [part("text", text="see <|image:0|> "), part("image", ref="a.png", width=29, height=14),
                                  part("audio", ref="b.wav", seconds=1.01), None]),
            (1, 1, "assistant", "ok", None), (1, 2, "user", None, [part("document", ref="c.pdf", pages=3), part("image")]),
            (2, 0, "user", None, [])]
    got = sorted(C.format_chat(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.conv_id, r.seq))
    assert got[0].formatted == "<|turn|>user\nsee \\l|image:0|> <|image:0|><|audio:1|></turn>\n"
    assert [(a.n, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 26)]
    assert [(a.n, a.kind, a.tokens) for a in got[2].attachments] == [(2, "document", 768), (3, "image", 1)]
    assert got[1].formatted[got[1].loss_start:got[1].loss_end] == "ok" and got[1].start == len(got[0].formatted)
    assert got[3].formatted == "<|turn|>user\n</turn>\n" and got[3].loss_start is None
    with pytest.raises(Exception, match="unknown part kind"):
        C.format_chat(spark.createDataFrame([(1, 0, "user", None, [part("video")])], schema)).collect()


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (1, 2, "assistant", "b", "x"), (1, 2, "assistant", "a", "x"), (1, 2, "assistant", "a", "x"),
            (None, 0, "us\ner", "long " * 50_000, "x"), (3, 1, "assistant", "</turn>", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in C.round_trip(df, stage_dir(spark, "chat")).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("\n\n" + "assistant\na\n" * 2 + "assistant\nb\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, sha("aab"))
    assert got[None].turns_sha256 == sha("us\ner\n" + "long " * 50_000 + "\n") and got[None].loss_sha256 == sha("")
    assert got[3].loss_sha256 == sha("</turn>")
    assert C.round_trip(df.limit(0), stage_dir(spark, "chat")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_SMALL}/conversations.parquet')")
    res = con.execute(Q.CHAT_SQL)
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    got = Q.op4_chat_format(spark, SF_SMALL)
    assert got.columns == cols and sorted(tuple(r) for r in got.collect()) == want
    probe = [r for r in want if r[0] == -7][0]
    assert probe[1] == 2 and probe[3] == len(Q.PROBE_TEXT) and probe[4] == hashlib.sha256(Q.PROBE_TEXT.encode()).hexdigest()
