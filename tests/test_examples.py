"""Template and encoder micro-fixtures (tokens written as letters, B = bos, E = eos)."""

import pytest
from pyspark.sql import functions as F

from conftest import lid
from tokenloom.functions.arrays import IGNORE_INDEX
from tokenloom.operators.templates import register_template, seg_text, get_template
from tokenloom.plans.instruct import pair_examples, prompt_examples, render, sft_examples

B, E = 1, 2
HIST = "array<struct<query:string,response:string>>"
register_template(name="bare", prefix=[], prompt=["{{query}}"], system="", sep=[])


def _rows(spark, rows):
    return spark.createDataFrame(rows, f"k long, prompt string, query string, response string, history {HIST}, system string")


def test_sft_plain(spark, letters_vocab):
    df = _rows(spark, [(0, "q", None, "r", None, None)])
    r = sft_examples(df, "k", "bare", letters_vocab).collect()[0]
    assert r["input_ids"] == [B, lid("q"), lid("r"), E]
    assert r["labels"] == [IGNORE_INDEX, IGNORE_INDEX, lid("r"), E]
    assert r["attention_mask"] == [1, 1, 1, 1]


def test_sft_cut_target_loses_eos(spark, letters_vocab):
    df = _rows(spark, [(0, "q", None, "r s", None, None)])
    r = sft_examples(df, "k", "bare", letters_vocab, 512, 2).collect()[0]
    assert r["input_ids"] == [B, lid("q"), lid("r"), lid("s")]


def test_sft_budget_stops_at_first_misfit(spark, letters_vocab):
    # limits 3 + 3; turns (2,2), (2,2), (1,1), ...: only turn 0; the (1,1) turn that would
    # still fit is not tried once turn 1 does not
    hist = [("a", "b"), ("c", "d"), ("", "")]
    df = _rows(spark, [(0, "e", None, "f", hist, None)])
    r = sft_examples(df, "k", "bare", letters_vocab, 3, 3).collect()[0]
    assert r["input_ids"] == [B, lid("a"), lid("b"), E]
    assert r["labels"] == [IGNORE_INDEX, IGNORE_INDEX, lid("b"), E]


def test_sft_budget_exact_fit(spark, letters_vocab):
    # turn 0 = (B q | E) = 3 ids, turn 1 = (B x | y E) = 4 ids: a budget of exactly 7 keeps both
    register_template(name="bare_nobos_later", prefix=[], prompt=["{{query}}"], system="", sep=[])
    df = _rows(spark, [(0, "x", None, "y", [("q", "")], None)])
    r = sft_examples(df, "k", "bare_nobos_later", letters_vocab, 3, 3).collect()[0]
    # turn 0: (B q | E) = 2 + 1, turn 1: (B x | y E) = 2 + 2 -> 3 + 4 = 7 > 6: stop after turn 0
    assert r["input_ids"] == [B, lid("q"), E]
    r2 = sft_examples(df, "k", "bare_nobos_later", letters_vocab, 3, 4).collect()[0]
    assert r2["input_ids"] == [B, lid("q"), E, B, lid("x"), lid("y"), E]


def test_one_turn_with_history(spark, letters_vocab):
    df = _rows(spark, [(0, "c", None, "d", [("a", "b")], None)])
    r = prompt_examples(df, "k", "bare", letters_vocab).collect()[0]
    assert r["input_ids"] == [B, lid("a"), lid("b"), E, B, lid("c")]
    assert r["labels"] == [lid("d"), E]


def test_reward_pair_filter_and_order(spark, letters_vocab):
    rows = [(0, "p", None, [], None, None), (1, "p", None, ["x"], None, None),
            (2, "p", None, ["x", "y", "z"], None, None), (3, "p", None, None, None, None)]
    df = spark.createDataFrame(rows, f"k long, prompt string, query string, response array<string>, history {HIST}, system string")
    out = pair_examples(df, "k", "bare", letters_vocab).collect()
    assert [r["k"] for r in out] == [2]
    assert out[0]["prompt_ids"] == [B, lid("p")]
    assert out[0]["chosen_ids"] == [lid("x"), E]
    assert out[0]["rejected_ids"] == [lid("y"), E]


def test_query_join(spark):
    from tokenloom.operators.align import query_text
    df = spark.createDataFrame([("p", "q"), ("p", ""), ("p", None)], "prompt string, query string")
    assert [r[0] for r in df.select(query_text("prompt", "query")).collect()] == ["p\nq", "p", "p"]


def _render_text(spark, vocab, name, query, system=None, history=None):
    df = _rows(spark, [(0, query, None, "R", history, system)])
    r, _ = render(df, name, vocab)
    rows = r.select(F.posexplode("pairs").alias("t", "p")).orderBy("t").collect()
    return [(x["p"]["src"], x["p"]["tgt"]) for x in rows], r


def test_template_traps(spark, letters_vocab):
    for name, expect in [("default", "say 0 {{idx}}"), ("alpaca", "say 0 {{idx}}"),
                         ("llama2", "say {{idx}} {{idx}}"), ("chatglm2", "say {{idx}} {{idx}}")]:
        df = _rows(spark, [(0, "say {{idx}} {{idx}}", None, "R {{query}}", None, None)])
        r, _ = render(df, name, letters_vocab)
        src = r.select(seg_text(F.element_at("pairs", 1)["src"])).first()[0]
        tgt = r.select(seg_text(F.element_at("pairs", 1)["tgt"])).first()[0]
        assert expect in src, (name, src)
        assert tgt == "R {{query}}</s>"
    for name in ("default", "alpaca", "llama2", "chatglm2"):
        df = _rows(spark, [(0, "cost $1 \\ {{query}}", None, "R", None, None)])
        r, _ = render(df, name, letters_vocab)
        src = r.select(seg_text(F.element_at("pairs", 1)["src"])).first()[0]
        assert "cost $1 \\ {{query}}" in src, (name, src)


def test_template_layouts(spark, letters_vocab):
    hist = [("Q0", "A0")]
    df = _rows(spark, [(0, "Q1", None, "A1", hist, "")])
    for name, t0, t1 in [
        ("default", "<s>" + get_template("default").system + "\nHuman: Q0\nAssistant: ", "\n<s>Human: Q1\nAssistant: "),
        ("alpaca", "<s>" + get_template("alpaca").system + "\n\n### Instruction:\nQ0\n\n### Response:\n",
         "\n\n<s>### Instruction:\nQ1\n\n### Response:\n"),
        ("chatglm2", "<s>[gMASK]sop\n\n[Round 0]\n\n问：Q0\n\n答：", "\n\n<s>[Round 1]\n\n问：Q1\n\n答："),
        ("llama2", "<s>[INST] <<SYS>>\n" + get_template("llama2").system + "\n<</SYS>>\n\nQ0 [/INST] ",
         "<s>[INST] Q1 [/INST] "),
    ]:
        r, _ = render(df, name, letters_vocab)
        got = r.select(F.transform("pairs", lambda p: seg_text(p["src"])).alias("s")).first()["s"]
        assert got == [t0, t1], (name, got)


def test_system_default_and_prompts():
    from tokenloom.operators.align import system_prompts
    assert system_prompts("x|y", 4) == ["x", "y", "x", "y"]
    with pytest.raises(ValueError):
        system_prompts("x|y", 3)
    assert system_prompts(None, 2) == [None, None]


def test_system_empty_uses_template(spark, letters_vocab):
    df = _rows(spark, [(0, "q", None, "r", None, "")])
    r, _ = render(df, "default", letters_vocab)
    src = r.select(seg_text(F.element_at("pairs", 1)["src"])).first()[0]
    assert src.startswith("<s>" + get_template("default").system)


def test_collate_left_pad(spark):
    from tokenloom.operators.examples import collate
    df = spark.createDataFrame([(0, [5, 6, 7]), (1, [8])], "ordinal long, input_ids array<int>")
    out = {r["ordinal"]: r for r in collate(df, "ordinal", pad_id=0, batch_size=8).collect()}
    assert out[1]["input_ids"] == [0, 0, 8]
    assert out[1]["attention_mask"] == [0, 0, 1]
    assert out[1]["labels"] == [IGNORE_INDEX, IGNORE_INDEX, 8]
    assert out[0]["labels"] == [5, 6, 7]


def test_template_special_token_rules(spark, letters_vocab):
    from tokenloom.operators.templates import END_OF_TEXT, with_template_specials
    from tokenloom.operators.vocab import Vocabulary
    t = register_template(name="stops", prefix=[], prompt=["{{query}}"], system="", sep=[],
                          stop_words=["<|im_end|>", "z"])
    v = with_template_specials(t, letters_vocab)
    assert v.eos_id == letters_vocab.size  # appended
    assert v.ids_of(["<|im_end|>"])["<|im_end|>"] == v.eos_id
    assert v.size == letters_vocab.size + 1  # "z" and "</s>" already exist
    assert v.pad_id == 0  # unk
    same = with_template_specials(get_template("default"), letters_vocab)
    assert same.eos_id == 2 and same.size == letters_vocab.size
    bare = Vocabulary(letters_vocab.table, letters_vocab.size, None, None, None)
    ended = with_template_specials(get_template("default"), bare)
    assert ended.ids_of([END_OF_TEXT]) == {END_OF_TEXT: ended.eos_id} and ended.pad_id == ended.eos_id


def test_template_parts_are_checked_when_declared():
    for bad in (3, None, {"token": 1}, {"text": "x"}, {"token": "a", "x": "b"}):
        with pytest.raises(ValueError, match="a part is text"):
            register_template(name="bad", prefix=[], prompt=["{{query}}", bad], system="", sep=[])


def test_decode_labels_pad(spark, letters_vocab):
    from tokenloom.operators.encode import decode_ids
    df = spark.createDataFrame([(0, [IGNORE_INDEX, lid("a"), 2])], "k long, labels array<int>")
    assert decode_ids(df, ["k"], "labels", letters_vocab).first()["text"] == "<unk> a </s>"


def test_decode_keeps_empty_rows(spark, letters_vocab):
    from tokenloom.operators.encode import decode_ids
    df = spark.createDataFrame([(0, []), (1, [lid("a")]), (2, None)], "k long, ids array<int>")
    assert {r["k"]: r["text"] for r in decode_ids(df, ["k"], "ids", letters_vocab).collect()} == {0: "", 1: "a", 2: ""}


def test_unknown_stage_is_refused(spark, letters_vocab):
    from tokenloom.plans.instruct import prepare_examples
    for stage in ("pt", "sfft", ""):
        with pytest.raises(ValueError, match="unknown stage"):
            prepare_examples(spark, "/nowhere", "s", stage, "default", letters_vocab)


def test_long_conversations_stay_linear(spark, letters_vocab):
    """Every turn is looked at once: 400 turns must not take 16 times as long as 100."""
    import time
    from tokenloom.plans.instruct import prompt_examples, sft_examples

    def seconds(turns, make):
        hist = [("a b", "c")] * (turns - 1)
        df = _rows(spark, [(0, "q", None, "r", hist, None)])
        t0 = time.time()
        row = make(df, "k", "bare", letters_vocab, 100000, 100000).collect()[0]
        return time.time() - t0, len(row["input_ids"])
    for make, ids in ((sft_examples, lambda n: 5 * (n - 1) + 4), (prompt_examples, lambda n: 5 * (n - 1) + 2)):
        seconds(10, make)
        (a, n), (b, m) = seconds(100, make), seconds(400, make)
        assert (n, m) == (ids(100), ids(400)) and b < 8 * a + 2


def test_prepare_examples_from_registry(spark, letters_vocab, tmp_path):
    import json
    from tokenloom.plans.instruct import prepare_examples
    (tmp_path / "s.jsonl").write_text(
        json.dumps({"instruction": "q", "input": "", "output": "r", "history": [["a", "b"]]}) + "\n"
        + json.dumps({"instruction": "", "input": "", "output": "x", "history": []}) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"instruction": "p", "input": "", "output": ["x", "y"]}) + "\n")
    (tmp_path / "dataset_info.json").write_text(json.dumps({
        "s": {"file_name": "s.jsonl", "columns": {"prompt": "instruction", "query": "input",
                                                  "response": "output", "history": "history"}},
        "p": {"file_name": "p.jsonl"}}))
    sft = prepare_examples(spark, str(tmp_path), "s", "sft", "bare", letters_vocab)["train_dataset"].collect()
    assert len(sft) == 1
    assert sft[0]["input_ids"] == [B, lid("a"), lid("b"), E, B, lid("q"), lid("r"), E]
    rm = prepare_examples(spark, str(tmp_path), "p", "rm", "bare", letters_vocab)["train_dataset"].collect()
    assert rm[0]["chosen_ids"] == [lid("x"), E] and rm[0]["rejected_ids"] == [lid("y"), E]
