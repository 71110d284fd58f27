"""Packing micro-fixtures (blocks per batch, remainders dropped) and properties."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, lid
from tokenloom.operators.pack import pack_encoded, pack_text


def _rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ordinal long, text string")


def _blocks(df):
    return [[r for r in row["input_ids"]] for row in df.orderBy("batch", "block").collect()]


def ids(s):
    return [lid(c) for c in s]


def test_pack_remainder(spark, letters_vocab):
    out = pack_text(_rows(spark, ["a b c", "d e", "f g h i"]), "ordinal", "text", letters_vocab, 4, 1000)
    assert _blocks(out) == [ids("abcd"), ids("efgh")]


def test_pack_batch_borders(spark, letters_vocab):
    out = pack_text(_rows(spark, ["a b c", "d e", "f g", "h"]), "ordinal", "text", letters_vocab, 4, 2)
    assert _blocks(out) == [ids("abcd")]


def test_pack_too_short(spark, letters_vocab):
    out = pack_text(_rows(spark, ["a b c"]), "ordinal", "text", letters_vocab, 4, 1000)
    assert out.count() == 0


def test_pack_ids_matches_pack_text(spark, letters_vocab):
    rows = spark.createDataFrame([(0, ids("abc")), (1, ids("de")), (2, ids("fghi"))], "ordinal long, ids array<int>")
    assert _blocks(pack_encoded(rows, "ordinal", "ids", 4, 1000)) == [ids("abcd"), ids("efgh")]


def test_pack_conservation_and_repartition(spark):
    """packed + dropped = input tokens; result unchanged under repartition."""
    from tokenloom.plans.pretrain import pretrain_blocks
    from tokenloom.functions.text import words
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    a = pretrain_blocks(docs, block=64, batch_rows=50)
    b = pretrain_blocks(docs.repartition(7), block=64, batch_rows=50)
    ra = sorted((r["batch"], r["block"], tuple(r["input_ids"])) for r in a.collect())
    rb = sorted((r["batch"], r["block"], tuple(r["input_ids"])) for r in b.collect())
    assert ra == rb
    per_batch = (docs.withColumn("n", F.size(words("text")))
                 .withColumn("batch", (F.col("doc_id") / 50).cast("long"))
                 .groupBy("batch").agg(F.sum("n").alias("n")).collect())
    expected = sum((r["n"] // 64) * 64 for r in per_batch)
    assert sum(len(x[2]) for x in ra) == expected
    assert all(len(x[2]) == 64 for x in ra)


def test_assign_batches_fallback_equal(spark):
    from tokenloom.operators.ordinal import assign_batches
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k").where("k % 7 <> 0")
    a = {r["k"]: r["_b"] for r in assign_batches(df, "k", 100, name="_b").collect()}
    b = {r["k"]: r["_b"] for r in assign_batches(df, "k", 100, name="_b", max_boundaries=0).collect()}
    assert a == b
    ks = sorted(a)
    assert all(a[k] == i // 100 for i, k in enumerate(ks))


def test_no_broadcast_path_same_results(spark, monkeypatch):
    """At scale the vocabulary is not broadcast: the sort-merge join path must agree."""
    import tokenloom.functions.joins as J
    from tokenloom.operators.encode import encode_texts
    from tokenloom.operators.vocab import build_vocab
    from tokenloom.plans.pretrain import pretrain_blocks
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    vocab = build_vocab(docs, "text")

    def run():
        enc = {r["doc_id"]: list(r["input_ids"]) for r in encode_texts(docs, ["doc_id"], "text", vocab).collect()}
        blocks = sorted((r["batch"], r["block"], tuple(r["input_ids"]))
                        for r in pretrain_blocks(docs, vocab=vocab, block=64, batch_rows=50).collect())
        return enc, blocks

    with_bc = run()
    monkeypatch.setattr(J, "broadcast_limit", lambda spark: 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = encode_texts(docs, ["doc_id"], "text", vocab)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        without = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert with_bc == without


def test_pretrain_cache_reused(spark, tmp_path):
    from tokenloom.plans.pretrain import pretrain_blocks
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "blocks")
    from tokenloom.sources.files import list_files
    a = pretrain_blocks(docs, block=64, batch_rows=50, cache_path=path)
    files = list_files(spark, path)
    b = pretrain_blocks(docs, block=64, batch_rows=50, cache_path=path)      # same inputs and settings: reused
    assert list_files(spark, path) == files and a.count() == b.count() > 0
    c = pretrain_blocks(docs, block=128, batch_rows=50, cache_path=path)     # other settings: made anew
    assert {r["n"] for r in c.select(F.size("input_ids").alias("n")).collect()} == {128}
    assert pretrain_blocks(docs.limit(0), block=64, batch_rows=50, cache_path=path).count() == 0


def test_prepare_pretraining_from_registry(spark, tmp_path, letters_vocab):
    import json
    from tokenloom.plans.pretrain import prepare_pretraining
    d = tmp_path
    (d / "a.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in ["a b c", "", "d e"]))
    (d / "b.txt").write_text("f g h\ni\n")
    (d / "dataset_info.json").write_text(json.dumps({
        "a": {"file_name": "a.jsonl", "columns": {"prompt": "text"}},
        "b": {"file_name": "b.txt", "columns": {"prompt": "text"}}}))
    out = prepare_pretraining(spark, str(d), "a,b", vocab=letters_vocab, block=4)
    got = [list(r["input_ids"]) for r in out["train_dataset"].orderBy("batch", "block").collect()]
    assert got == [[lid(c) for c in "abcd"], [lid(c) for c in "efgh"]]
    both = prepare_pretraining(spark, str(d), "a,b", vocab=letters_vocab, block=2, val_size=1)
    assert both["eval_dataset"].count() == 1 and both["train_dataset"].count() == 3
