"""Readers, registry, and streaming rules."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tokenloom.sources.files import load_datasets, read_dataset, read_files
from tokenloom.sources.sinks import read_key, shard_files, write_byte_shards
from tokenloom.streaming.encode import StreamRules


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_formats_and_order(spark):
    d = tempfile.mkdtemp(prefix="tl-src-")
    os.makedirs(f"{d}/js")
    _write(f"{d}/js/a.json", json.dumps([{"instruction": "p1", "output": "r1"}, {"instruction": "p2", "output": "r2"}]))
    _write(f"{d}/js/b.jsonl", '{"instruction": "p3", "output": "r3"}\n')
    _write(f"{d}/c.csv", 'instruction,output\n"a ""quoted""\nline",r\nb,s\n')
    _write(f"{d}/t.txt", "l1\nl2\n\nl4\n")
    _write(f"{d}/dataset_info.json", json.dumps({
        "js": {"file_name": "js", "columns": {"prompt": "instruction", "response": "output"}},
        "c": {"file_name": "c.csv", "columns": {"prompt": "instruction", "response": "output"}},
        "t": {"file_name": "t.txt", "columns": {"prompt": "text"}}}))
    js, c, t = load_datasets(spark, d, "js, c ,t", system_prompt="S")
    assert [(r["prompt"], r["response"], r["ordinal"]) for r in js.orderBy("ordinal").collect()] == \
        [("p1", "r1", 0), ("p2", "r2", 1), ("p3", "r3", 2)]
    assert [r["prompt"] for r in c.orderBy("ordinal").collect()] == ['a "quoted"\nline', "b"]
    assert [r["prompt"] for r in t.orderBy("ordinal").collect()] == ["l1", "l2", "", "l4"]
    assert {r["system"] for r in t.collect()} == {"S"}


def test_default_columns_must_exist(spark):
    d = tempfile.mkdtemp(prefix="tl-src-")
    _write(f"{d}/a.jsonl", '{"instruction": "p"}\n')
    _write(f"{d}/dataset_info.json", json.dumps({"a": {"file_name": "a.jsonl"}}))
    with pytest.raises(ValueError, match="input"):
        load_datasets(spark, d, "a")


def test_mixed_types_and_unknown(spark):
    d = tempfile.mkdtemp(prefix="tl-src-")
    os.makedirs(f"{d}/mix")
    _write(f"{d}/mix/a.csv", "x\n1\n")
    _write(f"{d}/mix/b.txt", "y\n")
    with pytest.raises(ValueError, match="different types"):
        read_files(spark, [f"{d}/mix/a.csv", f"{d}/mix/b.txt"])
    _write(f"{d}/dataset_info.json", json.dumps({"a": {"file_name": "mix"}}))
    with pytest.raises(ValueError, match="not in the registry"):
        load_datasets(spark, d, "nope")
    with pytest.raises(ValueError, match="no dataset file"):
        read_files(spark, [])


def test_stream_rules():
    StreamRules(max_steps=10, val_size=5).check()
    limited = StreamRules(max_steps=1, max_samples=3)
    with pytest.warns(UserWarning, match="switched off"):
        limited.check()
    assert limited.max_samples is None
    for bad in (StreamRules(), StreamRules(max_steps=1, val_size=0.5), StreamRules(max_steps=1, stage="ppo")):
        with pytest.raises(ValueError):
            bad.check()


def test_sinks(spark):
    from tokenloom.sources.files import list_files
    from tokenloom.sources.sinks import stage_table, write_shards
    d = tempfile.mkdtemp(prefix="tl-sink-")
    df = spark.range(100).withColumnRenamed("id", "k")
    write_shards(df.coalesce(1), f"{d}/shards", 30)
    assert len([f for f in list_files(spark, f"{d}/shards") if f.endswith(".parquet")]) == 4
    def fail():
        raise AssertionError("a hit must not build the table")
    a = stage_table(lambda: df, spark, f"{d}/stage", "k")
    b = stage_table(fail, spark, f"{d}/stage", "k")
    assert a.count() == b.count() == df.count()
    assert stage_table(lambda: spark.range(5), spark, f"{d}/stage", "other").count() == 5
    assert stage_table(lambda: spark.range(5), spark, f"{d}/stage", "k", overwrite=True).count() == 5
    os.remove(f"{d}/stage/k/_SUCCESS")                      # an unfinished write is no hit
    assert stage_table(lambda: spark.range(3), spark, f"{d}/stage", "k").count() == 3


def test_byte_shards_hold_the_bound_and_find_a_key_in_one_file(spark, tmp_path):
    import random
    rng = random.Random(4)
    sizes = {k: rng.choice([0, 1, 7, 30, 90, 250]) for k in range(400)}
    rows = [(k, "x" * n) for k, n in sizes.items()] + [(400, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, text string").repartition(3)
    path = f"{tmp_path}/shards"
    index = write_byte_shards(df, path, "k", F.octet_length("text"), 100, shards_per_task=20).collect()
    assert sum(r["n_rows"] for r in index) == 401 and len(index) > 100
    assert all(r["n_bytes"] <= 100 or r["n_rows"] == 1 for r in index)
    assert sum(r["n_bytes"] for r in index) == sum(sizes.values())
    spans = sorted((r["first_key"], r["last_key"]) for r in index)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    # two shards of one task that follow each other would not fit into one
    by_task = {}
    for r in sorted(index, key=lambda r: r["first_key"]):
        by_task.setdefault(r["file"].split("shard=s")[1][:6], []).append(r)
    firsts = {k: n or 0 for k, n in [*sizes.items(), (400, 0)]}
    for shards in by_task.values():
        assert all(a["n_bytes"] + firsts[b["first_key"]] > 100 for a, b in zip(shards, shards[1:]))
    for k in (0, 17, 399, 400):
        assert len(shard_files(spark, path, k)) == 1
        assert [tuple(r) for r in read_key(spark, path, "k", k).collect()] == [r for r in rows if r[0] == k]
    assert read_key(spark, path, "k", 5000).collect() == [] and read_key(spark, path, "k", 5000).columns == ["k", "text"]


def test_byte_shards_of_odd_tables(spark, tmp_path):
    schema = "k long, text string"
    size = F.octet_length("text")
    assert write_byte_shards(spark.createDataFrame([], schema), f"{tmp_path}/none", "k", size, 10).collect() == []
    rows = [(None, "aaaa"), (None, "bbbb")] + [(7, "x" * 6)] * 50 + [(8, "y")]
    write_byte_shards(spark.createDataFrame(rows, schema), f"{tmp_path}/hot", "k", size, 12)
    assert read_key(spark, f"{tmp_path}/hot", "k", 7).count() == 50       # a key over many files
    assert spark.read.parquet(f"{tmp_path}/hot").drop("shard").count() == 53
    with pytest.raises(ValueError, match="shard"):
        write_byte_shards(spark.createDataFrame([(1, "a")], "k long, shard string"), f"{tmp_path}/clash", "k", F.lit(1), 10)
    with pytest.raises(ValueError, match="positive"):
        write_byte_shards(spark.createDataFrame(rows, schema), f"{tmp_path}/zero", "k", size, 0)


def test_registry_takes_schemas(spark, tmp_path):
    (tmp_path / "dataset_info.json").write_text('{"a": {"file_name": "a.csv", "columns": {"prompt": "n"}}, "b": {"file_name": "b.csv", "columns": {"prompt": "n"}}}')
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("n\n007\n8\n")
    a, b = load_datasets(spark, str(tmp_path), "a, b", schemas={"a": "n string"})
    assert [r["prompt"] for r in a.orderBy("ordinal").collect()] == ["007", "8"]
    assert a.schema["prompt"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="not read"):
        load_datasets(spark, str(tmp_path), "a", schemas={"b": "n string"})


def test_json_forms_in_one_folder(spark, tmp_path):
    """An array over several lines, JSON lines and one pretty-printed object, next to each other and nested."""
    (tmp_path / "a.json").write_text('[\n {"v": 1},\n {"v": 2}\n]\n')
    (tmp_path / "b.jsonl").write_text('{"v": 3}\n{"v": 4}\n')
    (tmp_path / "c.json").write_text('\n{"v": 5}\n{"v": 6}\n')
    (tmp_path / "nest").mkdir()
    (tmp_path / "nest" / "d.json").write_text('{\n  "v": 7,\n  "w": "x"\n}\n')
    (tmp_path / "nest" / "_hidden.json").write_text("nothing")
    rows = read_dataset(spark, str(tmp_path.parent), tmp_path.name).orderBy("ordinal").collect()
    assert [r["v"] for r in rows] == [1, 2, 3, 4, 5, 6, 7] and [r["ordinal"] for r in rows] == list(range(7))
    assert rows[6]["w"] == "x" and rows[0]["w"] is None
    (tmp_path / "e.jsonl").write_text('{"v": 8}\n{"v": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_dataset(spark, str(tmp_path.parent), tmp_path.name).collect()


def test_ingest_ordinal_many_splits(spark):
    """Dense, in file/line order, across many files and several splits per file."""
    from tokenloom.sources.files import read_files
    d = tempfile.mkdtemp(prefix="tl-ing-")
    for f in range(5):
        _write(f"{d}/f{f}.txt", "".join(f"{f}-{i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        files = sorted(f"{d}/f{f}.txt" for f in range(5))
        rows = read_files(spark, files).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = sorted((r["ordinal"], r["text"]) for r in rows)
    want = [(i, t) for i, t in enumerate(f"{f}-{j}" for f in range(5) for j in range(3000))]
    assert got == want


def test_json_history_pairs(spark):
    d = tempfile.mkdtemp(prefix="tl-hist-")
    _write(f"{d}/h.jsonl", json.dumps({"instruction": "q", "input": "", "output": "r",
                                       "history": [["q0", "r0"], ["q1", "r1"]]}) + "\n")
    _write(f"{d}/dataset_info.json", json.dumps({"h": {"file_name": "h.jsonl", "columns": {
        "prompt": "instruction", "query": "input", "response": "output", "history": "history"}}}))
    (df,) = load_datasets(spark, d, "h")
    h = df.first()["history"]
    assert [(x["query"], x["response"]) for x in h] == [("q0", "r0"), ("q1", "r1")]


def test_map_batches_user_function(spark):
    from tokenloom.operators.batched import map_batches
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "ordinal long, text string")

    def pairs(b):  # 3 rows in -> 1 row out: joined text of the batch
        return b.assign(j=" ".join(b["text"]))[["j"]].head(1)
    out = map_batches(df, "ordinal", pairs, "j string", batch_rows=3).orderBy("batch").collect()
    assert [r["j"] for r in out] == ["t0 t1 t2", "t3 t4 t5", "t6"]


def test_unknown_file_type_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="tl-src-")
    _write(f"{d}/a.xyz", "x\n")
    with pytest.raises(ValueError, match="Unknown file type"):
        read_files(spark, [f"{d}/a.xyz"])
