import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from tokenloom.llm import queries as Q

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("bar", "den", "fol", "gim", "hus", "jat")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def ids(df):
    assert df.columns == list(P.COLUMNS)
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stage_list_and_registration():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dup", "decontamination", "secret_scan", "byte_bpe"]
    assert {re.match(r"op(\d+)_", n)[1] for n in Q.QUERIES} == {str(i) for i in range(1, 14)}
    assert set(Q.QUERIES) | {"pipeline"} <= set(E.queries())


def test_near_dup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    base = rng.choices(WORDS, k=60)
    near = list(base)
    near[5] = "other"
    rows = [(9, " ".join(base)), (4, " ".join(near)), (7, " ".join(base).upper()), (4, " ".join(near)),
            (1, " ".join(rng.choices(WORDS, k=60))), (2, None), (3, ""), (None, " ".join(base)), (None, None)]
    assert ids(P.near_dup(spark, frame(spark, rows), "")) == sorted([4, 1, 2, 3, None, None], key=str)


def test_decontamination_and_secrets(spark, tmp_path):
    item = "Kabar loden mifol nugim pehus rajat siden tofol vugim zehus kajat lobar."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "so " + item), (2, "clean words only"), (3, None), (None, item), (5, "a token = 04dbebab91ab85687d33eeaa here")]
    left = P.decontamination(spark, frame(spark, rows), str(tmp_path))
    assert ids(left) == sorted([2, 3, None, 5], key=str)
    got = {r.doc_id: r for r in P.secret_scan(spark, left, "").collect()}
    assert got[5].text == "a [SECRET] here" and got[5].n_chars == 15
    assert (got[2].text, got[2].n_chars, got[3].text, got[3].n_chars) == ("clean words only", 16, None, None)


def test_toxicity_stage_drops_what_the_model_rejects(spark, tmp_path, monkeypatch):
    from tokenloom.llm import toxicity as T
    from test_toxicity import corpus
    monkeypatch.setattr(T, "TREES", 5)
    docs, labels = corpus(240, 5)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs + [(None, None), (900, "")]
    df = frame(spark, rows)
    left = P.toxicity(spark, df, str(tmp_path)).collect()
    rejected = {d for d, _ in docs} - {r.doc_id for r in left}
    toxic = {d for d, y in labels if y}
    assert len(rejected & toxic) >= 0.8 * len(toxic) and len(rejected - toxic) <= 0.1 * len(docs)
    by = {r.doc_id: r for r in left}
    assert all(by[d].text == t for d, t in docs if d in by)


def test_all_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op1_secret_scan", "op7_warc_derivatives", "op9_token_spans"])
def test_registered_queries_read_whole_tables(spark, name):
    SF_SMALL = "/root/testdata/sf0.001"
    table, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    want = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(key).distinct().count()
    assert E.queries()[name](spark, SF_SMALL).select(F.countDistinct(key)).first()[0] == want


def test_stages_bound_the_batches_that_python_gets(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(key, given)
            P.secret_scan(spark, spark.createDataFrame([], SCHEMA), "")
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_stages_begin_with_a_collection_on_the_executors(spark):
    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = full()
    P.secret_scan(spark, spark.createDataFrame([], SCHEMA), "")
    assert full() - before >= 1 + spark.sparkContext.defaultParallelism   # the driver's, then a task per core


def test_stage_modules_leave_spark_ml_out_of_python_workers():
    code = "import sys, tokenloom.llm.toxicity, tokenloom.llm.byte_bpe; sys.exit('pyspark.ml' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(P.__file__)).returncode == 0
