"""Vocabulary flows: extend (learn, append, decompose, mean rows) and prune."""

from collections import defaultdict

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tokenloom.operators.bpe import _encoder
from tokenloom.operators.vocab import build_vocab
from tokenloom.plans.vocabulary import extend_vocab, learn_bpe_vocabulary, prune_vocab


def test_extend_vocab_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"))
    old = learn_bpe_vocabulary(docs.where("lang = 'en'"), "doc_id", 400)
    new = learn_bpe_vocabulary(docs.where("lang <> 'en'"), "doc_id", 400)
    n_old = old.vocab.size
    assert 300 < n_old <= 400
    merged, rows = extend_vocab(old, new.vocab, emb)
    got = defaultdict(dict)
    for r in rows.collect():
        got[r["id"]][r["dim"]] = r["value"]
    vecs = {r["id"]: list(r["vec"]) for r in emb.collect()}
    pieces = {r["id"]: r["token"] for r in merged.table.collect()}
    assert sorted(got) == list(range(merged.size))
    for i in range(n_old):
        assert [got[i][d] for d in range(len(vecs[i]))] == [float(x) for x in vecs[i]]
    enc = _encoder(old.merges, [(r["id"], r["token"]) for r in old.vocab.table.collect()])
    mark = [i for i, t in pieces.items() if t == "▁"][0]
    for i in range(n_old, merged.size):
        ids = enc(pieces[i])
        if ids and ids[0] == mark:
            ids = ids[1:]
        if not ids:  # no old id: the mean of the old model's rows
            ids = list(range(n_old))
        want = [sum(float(vecs[j][d]) for j in ids) / len(ids) for d in range(len(vecs[0]))]
        assert all(abs(got[i][d] - want[d]) < 1e-9 for d in range(len(want)))


def test_prune_vocab(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    old = build_vocab(docs)
    new = build_vocab(docs.where("lang = 'fr'"))
    emb = spark.createDataFrame([(i, [float(i)]) for i in range(old.size)], "id int, vec array<float>")
    out = prune_vocab(new, old, emb)
    rows = {r["id"]: r["vec"][0] for r in out.embeddings.collect()}
    tok_old = {r["token"]: r["id"] for r in old.table.collect()}
    for r in new.table.collect():
        assert rows[r["id"]] == float(tok_old[r["token"]])
    assert out.ratio.first()["new_size"] == new.size
