"""Properties from the test strategy: label/id alignment, dense merged ids, and packing
against a plain Python model of the batched concatenate-and-chunk rule."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL, lid
from tokenloom.functions.arrays import IGNORE_INDEX
from tokenloom.operators.pack import pack_text
from tokenloom.operators.vocab import build_vocab, merge_vocab
from tokenloom.plans.instruct import sft_examples
from tokenloom.sources.conversations import sft_rows


def test_sft_labels_align_with_ids(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    vocab = build_vocab(conv, "text")
    ex = sft_examples(sft_rows(conv), "conv_id", "default", vocab, 40, 60).collect()
    assert ex
    for r in ex:
        ids, labels, mask = r["input_ids"], r["labels"], r["attention_mask"]
        assert len(ids) == len(labels) == len(mask) <= 100
        assert all(lab == IGNORE_INDEX or lab == i for i, lab in zip(ids, labels))
        assert set(mask) == {1}


def test_merged_ids_dense(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    merged = merge_vocab(build_vocab(docs.where("lang = 'en'")), build_vocab(docs.where("lang <> 'en'")))
    ids = sorted(r["id"] for r in merged.table.collect())
    assert ids == list(range(merged.size))
    toks = [r["token"] for r in merged.table.collect()]
    assert len(toks) == len(set(toks))


def python_pack(rows: list[list[int]], block: int, batch_rows: int) -> list[list[int]]:
    out = []
    for s in range(0, len(rows), batch_rows):
        cat = [t for r in rows[s:s + batch_rows] for t in r]
        total = (len(cat) // block) * block
        out.extend(cat[i:i + block] for i in range(0, total, block))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=9), min_size=1, max_size=14),
       block=st.integers(1, 6), batch_rows=st.integers(1, 5))
def test_pack_matches_python_model(spark, letters_vocab, rows, block, batch_rows):
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "ordinal long, text string")
    got = [list(r["input_ids"]) for r in
           pack_text(df, "ordinal", "text", letters_vocab, block, batch_rows).orderBy("batch", "block").collect()]
    want = python_pack([[lid(c) for c in r] for r in rows], block, batch_rows)
    assert got == want
