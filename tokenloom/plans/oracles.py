"""DuckDB oracle SQL, one string per registered query (same output column names)."""

from __future__ import annotations

from .sqlparts import DOCS_F1, vocab_cte, words

ORACLES: dict[str, str] = {}

ORACLES["pt_pack"] = f"""
WITH {vocab_cte('v', DOCS_F1)},
docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, {words('text')} AS w FROM ({DOCS_F1}) d),
toks AS (SELECT ord, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM docs),
num AS (SELECT ord // 100 AS batch,
               row_number() OVER (PARTITION BY ord // 100 ORDER BY ord, pos) - 1 AS p,
               coalesce(v.id, 0) AS id
        FROM toks LEFT JOIN v ON v.token = toks.tok)
SELECT CAST(batch AS BIGINT) AS batch, CAST(p // 512 AS BIGINT) AS block,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS input_ids,
       CAST(count(*) AS BIGINT) AS n_tokens
FROM num GROUP BY batch, p // 512 HAVING count(*) = 512
"""

_ORD_DOCS = f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, text FROM ({DOCS_F1}) d"

ORACLES["pt_filter"] = f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM ({DOCS_F1}) d"

ORACLES["pt_pack_offsets"] = f"""
WITH o AS (SELECT ord, doc_id, CAST(len({words('text')}) AS BIGINT) AS n_tokens FROM ({_ORD_DOCS}) x)
SELECT doc_id, CAST(ord // 100 AS BIGINT) AS batch, n_tokens,
       CAST(coalesce(sum(n_tokens) OVER (PARTITION BY ord // 100 ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset,
       CAST(sum(n_tokens) OVER (PARTITION BY ord // 100) AS BIGINT) AS batch_tokens
FROM o
"""

ORACLES["corpus_lines"] = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no
           FROM documents)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE line <> '' AND strlen(line) <= 2000
"""

ORACLES["word_counts"] = f"""
SELECT tok AS token, CAST(count(*) AS BIGINT) AS count
FROM (SELECT unnest({words('text')}) AS tok FROM documents) t GROUP BY tok
"""

ORACLES["char_coverage"] = f"""
WITH c AS (SELECT ch, count(*) AS cnt FROM
             (SELECT unnest(string_split(array_to_string({words('text')}, ''), '')) AS ch FROM documents) t
           WHERE ch <> '' GROUP BY ch),
r AS (SELECT ch, cnt,
             coalesce(sum(cnt) OVER (ORDER BY cnt DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS cum_before,
             sum(cnt) OVER () AS total FROM c)
SELECT ch, CAST(cnt AS BIGINT) AS cnt, CAST(cum_before AS BIGINT) AS cum_before,
       CAST(CASE WHEN cum_before < 0.9995 * total THEN 1 ELSE 0 END AS BIGINT) AS kept
FROM r
"""

ORACLES["encode_ws"] = f"""
WITH {vocab_cte('v', DOCS_F1)},
d AS (SELECT doc_id, {words('text')} AS w FROM ({DOCS_F1}) x),
t AS (SELECT doc_id, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM d),
e AS (SELECT doc_id, string_agg(CAST(coalesce(v.id, 0) AS VARCHAR), ' ' ORDER BY pos) AS input_ids,
             CAST(count(*) AS BIGINT) AS n_tokens
      FROM t LEFT JOIN v ON v.token = t.tok GROUP BY doc_id)
SELECT doc_id, coalesce(e.input_ids, '') AS input_ids, coalesce(e.n_tokens, 0) AS n_tokens
FROM d LEFT JOIN e USING (doc_id)
"""

ORACLES["decode"] = f"""
WITH {vocab_cte('v', DOCS_F1)},
docs AS (SELECT ord, {words('text')} AS w FROM ({_ORD_DOCS}) x),
toks AS (SELECT ord, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM docs),
num AS (SELECT ord // 100 AS batch, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord, pos) - 1 AS p,
               coalesce(v.id, 0) AS id
        FROM toks LEFT JOIN v ON v.token = toks.tok),
blk AS (SELECT batch, p // 512 AS block, p, id FROM num
        QUALIFY count(*) OVER (PARTITION BY batch, p // 512) = 512)
SELECT CAST(batch AS BIGINT) AS batch, CAST(block AS BIGINT) AS block,
       string_agg(coalesce(v2.token, ''), ' ' ORDER BY p) AS text
FROM blk LEFT JOIN v v2 ON v2.id = blk.id GROUP BY batch, block
"""

ORACLES["token_stats"] = f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len({words('text')})) AS BIGINT) AS n_tokens FROM ({DOCS_F1}) d
"""

_LANG_VOCABS = (vocab_cte('b', "SELECT text FROM documents WHERE lang = 'en'") + ", "
                + vocab_cte('n', "SELECT text FROM documents WHERE lang IS DISTINCT FROM 'en'"))
_MERGED = f"""{_LANG_VOCABS},
added AS (SELECT id, token FROM n WHERE token NOT IN (SELECT token FROM b)),
m AS (SELECT id, token, CASE WHEN id < 3 THEN 0.0 ELSE -CAST(id AS DOUBLE) END AS score FROM b
      UNION ALL
      SELECT CAST((SELECT count(*) FROM b) + row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS id, token, 0.0
      FROM added)"""

ORACLES["vocab_merge"] = f"WITH {_MERGED} SELECT CAST(id AS BIGINT) AS id, token, CAST(score AS DOUBLE) AS score FROM m"

ORACLES["vocab_missing"] = f"""
WITH {_LANG_VOCABS}
SELECT CAST(id AS BIGINT) AS id, token FROM n WHERE token NOT IN (SELECT token FROM b)
"""

ORACLES["vocab_remap"] = f"""
WITH {_MERGED}
SELECT CAST(n.id AS BIGINT) AS new_id, CAST(m.id AS BIGINT) AS old_id, n.token FROM n JOIN m ON m.token = n.token
"""

ORACLES["vocab_ratio"] = f"""
WITH {_MERGED}
SELECT CAST((SELECT count(*) FROM m) AS BIGINT) AS old_size, CAST((SELECT count(*) FROM n) AS BIGINT) AS new_size,
       round(100.0 * (SELECT count(*) FROM n) / (SELECT count(*) FROM m), 2) AS ratio_pct
"""

_EMB_LONG = """SELECT CAST(vec_id AS BIGINT) AS id, label, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS dim,
       CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"""

ORACLES["embed_prune"] = f"""
WITH {_MERGED},
r AS (SELECT n.id AS new_id, m.id AS old_id FROM n JOIN m ON m.token = n.token),
e AS (SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims,
             round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 4) AS digest FROM embeddings)
SELECT CAST(r.new_id AS BIGINT) AS id, e.dims, e.digest
FROM r JOIN e ON e.vec_id = r.old_id % (SELECT count(*) FROM embeddings)
"""

ORACLES["embed_mean"] = f"""
WITH e AS ({_EMB_LONG})
SELECT CAST(label AS BIGINT) AS id, dim, round(avg(value), 6) AS value FROM e GROUP BY label, dim
"""

ORACLES["embed_resize"] = f"""
WITH e AS ({_EMB_LONG})
SELECT id, dim, round(value, 6) AS value FROM e
UNION ALL
SELECT CAST((SELECT max(vec_id) FROM embeddings) + 1 AS BIGINT) AS id, dim, round(avg(value), 6) AS value
FROM e GROUP BY dim
"""

ORACLES["embed_extend"] = f"""
WITH e AS ({_EMB_LONG}),
l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS r FROM (SELECT DISTINCT label FROM embeddings) x)
SELECT id, dim, round(value, 6) AS value FROM e
UNION ALL
SELECT CAST((SELECT max(vec_id) FROM embeddings) + 1 + l.r AS BIGINT) AS id, e.dim, round(avg(e.value), 6) AS value
FROM e JOIN l USING (label) GROUP BY l.r, e.dim
"""

ORACLES["max_samples"] = """
SELECT source, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10
"""

ORACLES["split_exact"] = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk
           FROM documents)
SELECT doc_id, CASE WHEN rk < CAST(ceil(0.1 * (SELECT count(*) FROM documents)) AS BIGINT)
                    THEN 'eval' ELSE 'train' END AS split
FROM r
"""

ORACLES["split_head"] = f"""
WITH {vocab_cte('v', DOCS_F1)},
docs AS (SELECT ord, {words('text')} AS w FROM ({_ORD_DOCS}) x),
toks AS (SELECT ord, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM docs),
num AS (SELECT ord // 100 AS batch, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord, pos) - 1 AS p FROM toks),
blk AS (SELECT batch, p // 512 AS block FROM num GROUP BY batch, p // 512 HAVING count(*) = 512)
SELECT CAST(batch AS BIGINT) AS batch, CAST(block AS BIGINT) AS block,
       CASE WHEN row_number() OVER (ORDER BY batch, block) - 1 < 100 THEN 'eval' ELSE 'train' END AS split
FROM blk
"""

ORACLES["shuffle"] = """
SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS BIGINT) AS rank
FROM documents
"""

# ---------------------------------------------------------------- instruction data
from .oracle_templates import ORACLE_TEMPLATES as TEMPLATES  # noqa: E402
from .sqlparts import (CONV_LISTS, CONV_VOCAB, PAIR_ROWS, PROMPT_ROWS, SFT_ROWS, ids_text,  # noqa: E402
                       literal_id_sql, seg_ids_cte, segments_sql, turns_cte)

_F2 = "prompt IS NOT NULL AND prompt <> '' AND response IS NOT NULL AND response <> ''"
_F1 = "prompt IS NOT NULL AND prompt <> ''"


def _segs(rows, tpl_name, where):
    tpl = TEMPLATES[tpl_name]
    return (f"{vocab_cte('v', CONV_VOCAB)}, {CONV_LISTS}, {turns_cte(rows, tpl, where)}, "
            f"segs AS ({segments_sql(tpl, literal_id_sql('v'))})")


ORACLES["align"] = """
WITH """ + CONV_LISTS + """
SELECT conv_id, users[greatest(len(asst), 1)] AS prompt, system AS query,
       CASE WHEN len(asst) > 0 THEN asst[len(asst)] END AS response, 'Be brief.' AS system
FROM conv_lists
"""

ORACLES["build_query"] = """
WITH """ + CONV_LISTS + """, r AS (SELECT conv_id, users[greatest(len(asst), 1)] AS prompt, system FROM conv_lists)
SELECT conv_id, CASE WHEN system IS NOT NULL AND system <> '' THEN prompt || chr(10) || system ELSE prompt END AS query_text
FROM r
"""

for _n in ("default", "alpaca", "chatglm2", "llama2", "llama2_zh"):
    ORACLES[f"render_{_n}"] = f"""
WITH {_segs(SFT_ROWS, _n, _F2)}
SELECT conv_id, CAST(t AS BIGINT) AS turn,
       coalesce(string_agg(coalesce(txt, name), '' ORDER BY seg) FILTER (WHERE side = 0), '') AS source,
       coalesce(string_agg(coalesce(txt, name), '' ORDER BY seg) FILTER (WHERE side = 1), '') AS target
FROM segs GROUP BY conv_id, t
"""

_SFT_AGG = """tr AS (SELECT conv_id, t, list_slice(src, 1, 96) AS s, list_slice(tgt, 1, 160) AS g FROM ts),
cum AS (SELECT *, sum(len(s) + len(g)) OVER (PARTITION BY conv_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM tr),
agg AS (SELECT conv_id, flatten(list(list_concat(s, g) ORDER BY t)) AS ids,
               flatten(list(list_concat(list_transform(s, lambda x: -100), g) ORDER BY t)) AS labels
        FROM cum WHERE c <= 256 GROUP BY conv_id)"""

_SFT_IDS = f"{_segs(SFT_ROWS, 'default', _F2)}, {seg_ids_cte('v')}, {_SFT_AGG}"

ORACLES["sft_encode"] = f"""
WITH {_SFT_IDS}
SELECT conv_id, {ids_text('ids')} AS input_ids, {ids_text('labels')} AS labels,
       {ids_text('list_transform(ids, lambda x: 1)')} AS attention_mask, CAST(len(ids) AS BIGINT) AS n_tokens
FROM agg
"""

ORACLES["unsup_encode"] = f"""
WITH {_segs(PROMPT_ROWS, 'alpaca', _F1)}, {seg_ids_cte('v')},
lt AS (SELECT *, max(t) OVER (PARTITION BY conv_id) AS last FROM ts),
agg AS (SELECT conv_id, flatten(list(CASE WHEN t < last THEN list_concat(src, tgt) ELSE src END ORDER BY t)) AS p,
               max_by(tgt, t) AS a
        FROM lt GROUP BY conv_id)
SELECT conv_id, {ids_text('list_slice(p, 1, 256)')} AS input_ids, {ids_text('list_slice(a, 1, 128)')} AS labels
FROM agg
"""

ORACLES["rm_encode"] = f"""
WITH {_segs(PAIR_ROWS, 'llama2', 'TRUE')}, {seg_ids_cte('v')}
SELECT conv_id, {ids_text('list_slice(src, 1, 512)')} AS prompt_ids, {ids_text('list_slice(tgt, 1, 64)')} AS chosen_ids,
       {ids_text('list_slice(alt_ids, 1, 64)')} AS rejected_ids
FROM ts
"""

ORACLES["collate"] = f"""
WITH {_SFT_IDS},
o AS (SELECT conv_id, ids, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM agg),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS wd FROM o),
p AS (SELECT conv_id, batch, list_concat(list_transform(generate_series(1, wd - len(ids)), lambda x: 0), ids) AS pid,
             list_concat(list_transform(generate_series(1, wd - len(ids)), lambda x: 0),
                         list_transform(ids, lambda x: 1)) AS mask
      FROM w)
SELECT conv_id, CAST(batch AS BIGINT) AS batch, {ids_text('pid')} AS input_ids, {ids_text('mask')} AS attention_mask,
       {ids_text('list_transform(pid, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels
FROM p
"""

# ---------------------------------------------------------------- mixing
_MIX = """ds AS (SELECT doc_id, lang AS dataset,
                   CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS ds
            FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')),
o AS (SELECT doc_id, dataset, ds, row_number() OVER (PARTITION BY ds ORDER BY doc_id) - 1 AS o,
             count(*) OVER (PARTITION BY ds) AS n FROM ds)"""

ORACLES["mix_concat"] = f"""
WITH {_MIX}
SELECT CAST(row_number() OVER (ORDER BY ds, doc_id) - 1 AS BIGINT) AS position, dataset, doc_id,
       CASE WHEN ds % 2 = 0 THEN 'Answer briefly.' ELSE 'Réponds brièvement.' END AS system
FROM o
"""

ORACLES["mix_under"] = f"""
WITH {_MIX}
SELECT CAST(o * 4 + ds AS BIGINT) AS position, dataset, doc_id FROM o WHERE o < (SELECT min(n) FROM o)
"""

ORACLES["mix_over"] = f"""
WITH {_MIX}, r AS (SELECT dataset, doc_id, ds, unnest(generate_series(o, (SELECT max(n) FROM o) - 1, n)) AS i FROM o)
SELECT CAST(i * 4 + ds AS BIGINT) AS position, dataset, doc_id FROM r
"""

# Draws are generated far enough (30 rounds of the largest n / share) and cut at the stop rule: the mix ends with the
# draw that takes the last row of a dataset (first exhausted), or when every dataset has been used up (all exhausted).
_DRAWS = f"""{_MIX},
n AS (SELECT ds, max(n) AS n FROM o GROUP BY ds),
pos AS (SELECT p, CAST(('0x' || substr(md5('42:' || CAST(p AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
        FROM range(0, 30 * (SELECT count(*) FROM o) + 1000) t(p)),
d AS (SELECT p, CASE WHEN u < 0.4 THEN 0 WHEN u < 0.7 THEN 1 WHEN u < 0.9 THEN 2 ELSE 3 END AS ds FROM pos),
r AS (SELECT p, ds, row_number() OVER (PARTITION BY ds ORDER BY p) - 1 AS o FROM d),
e AS (SELECT r.ds, r.p AS last FROM r JOIN n USING (ds) WHERE r.o = n.n - 1)"""

ORACLES["mix_probs"] = f"""
WITH {_DRAWS}
SELECT CAST(r.p AS BIGINT) AS position, o.dataset, o.doc_id
FROM r JOIN o ON o.ds = r.ds AND o.o = r.o WHERE r.p <= (SELECT min(last) FROM e)
"""

ORACLES["mix_probs_over"] = f"""
WITH {_DRAWS}
SELECT CAST(r.p AS BIGINT) AS position, o.dataset, o.doc_id
FROM r JOIN n ON n.ds = r.ds JOIN o ON o.ds = r.ds AND o.o = r.o % n.n WHERE r.p <= (SELECT max(last) FROM e)
"""

# ---------------------------------------------------------------- byte-pair vocabulary
ORACLES["bpe_pairs"] = f"""
WITH wc AS (SELECT tok, count(*) AS c FROM (SELECT unnest({words('text')}) AS tok FROM documents) t GROUP BY tok),
sy AS (SELECT c, string_split('▁' || tok, '') AS s FROM wc),
pr AS (SELECT c, s[i] AS a, s[i + 1] AS b FROM (SELECT c, s, unnest(generate_series(1, len(s) - 1)) AS i FROM sy) x)
SELECT a, b, CAST(sum(c) AS BIGINT) AS cnt FROM pr
WHERE NOT (regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]'))
GROUP BY a, b
"""

# ---------------------------------------------------------------- files and streams
ORACLES["src_formats"] = """
WITH d AS (SELECT count(*) AS n, sum(length(text)) AS c FROM documents),
l AS (SELECT count(*) AS n, sum(length(line)) AS c
      FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) x)
SELECT 'docs_csv' AS dataset, 'A' AS system, CAST(n AS BIGINT) AS n_rows, CAST(c AS BIGINT) AS n_chars FROM d
UNION ALL SELECT 'docs_json', 'B', CAST(n AS BIGINT), CAST(c AS BIGINT) FROM d
UNION ALL SELECT 'docs_text', 'A', CAST(n AS BIGINT), CAST(c AS BIGINT) FROM l
UNION ALL SELECT 'docs_parquet', 'B', CAST(n AS BIGINT), CAST(c AS BIGINT) FROM d
"""

ORACLES["stream_encode"] = ORACLES["encode_ws"]

ORACLES["stream_pack"] = ORACLES["pt_pack"]

ORACLES["embed_shards"] = ORACLES["embed_prune"]

ORACLES["text_shards"] = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, TRUE AS fits, TRUE AS covered FROM documents
"""

ORACLES["first_example"] = f"""
WITH {_SFT_IDS},
f AS (SELECT conv_id, ids, labels FROM agg ORDER BY conv_id LIMIT 1),
i AS (SELECT conv_id, unnest(ids) AS id, unnest(generate_series(1, len(ids))) AS p FROM f),
l AS (SELECT conv_id, unnest(labels) AS id, unnest(generate_series(1, len(labels))) AS p FROM f),
di AS (SELECT i.conv_id, string_agg(coalesce(v.token, ''), ' ' ORDER BY p) AS inputs
       FROM i LEFT JOIN v ON v.id = i.id GROUP BY i.conv_id),
dl AS (SELECT l.conv_id, string_agg(coalesce(v.token, ''), ' ' ORDER BY p) AS labels
       FROM l LEFT JOIN v ON v.id = CASE WHEN l.id = -100 THEN 0 ELSE l.id END GROUP BY l.conv_id)
SELECT di.conv_id, inputs, labels FROM di JOIN dl USING (conv_id)
"""

ORACLES["stream_split"] = f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 'eval' ELSE 'train' END AS split
FROM ({DOCS_F1}) d
"""

ORACLES["stream_shuffle"] = f"""
WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS buffer FROM ({DOCS_F1}) d)
SELECT doc_id, CAST(buffer AS BIGINT) AS buffer,
       CAST(buffer * 64 + row_number() OVER (PARTITION BY buffer ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1
            AS BIGINT) AS rank
FROM p
"""

ORACLES["stream_buffer_shuffle"] = f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM ({DOCS_F1}) d),
s AS (SELECT *, md5('42:' || CAST(o AS VARCHAR)) AS h FROM p),
x AS (SELECT *, lead(o) OVER (PARTITION BY CASE WHEN o < 64 THEN o ELSE CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 64 END
                              ORDER BY o) AS pushed FROM s)
SELECT doc_id, CAST(CASE WHEN pushed IS NOT NULL THEN pushed - 64
       ELSE greatest(n - 64, 0) + row_number() OVER (PARTITION BY pushed IS NULL ORDER BY h, o) - 1 END AS BIGINT) AS rank
FROM x
"""

ORACLES["stream_filter"] = ORACLES["pt_filter"]

ORACLES["vocab_sink"] = ORACLES["vocab_merge"]

# ---------------------------------------------------------------- BPE in SQL
from .queries import BPE_MERGES, VOCAB_PIECES  # noqa: E402
from .sqlparts import SEG_WORDS, bpe_all_cte, bpe_encode_cte, bpe_pieces_cte, seg_subword_ids_cte  # noqa: E402

_ALL_DOCS = "SELECT text FROM documents"
_EN = "SELECT text FROM documents WHERE lang = 'en'"

ORACLES["bpe_merges"] = f"""
WITH RECURSIVE {bpe_all_cte('b', _ALL_DOCS, str(BPE_MERGES))}
SELECT rank, a, b, CAST(count AS BIGINT) AS count FROM bm
"""

ORACLES["encode_bpe"] = f"""
WITH RECURSIVE {bpe_pieces_cte('b', _ALL_DOCS, VOCAB_PIECES)},
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM d),
e AS (SELECT t.doc_id, flatten(list(benc.ids ORDER BY t.pos)) AS ids FROM t JOIN benc ON benc.token = t.tok
      GROUP BY t.doc_id)
SELECT d.doc_id, coalesce({ids_text('e.ids')}, '') AS input_ids, CAST(coalesce(len(e.ids), 0) AS BIGINT) AS n_tokens
FROM d LEFT JOIN e USING (doc_id)
"""

ORACLES["pt_pack_bpe"] = f"""
WITH RECURSIVE {bpe_pieces_cte('b', _ALL_DOCS, VOCAB_PIECES)},
docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, {words('text')} AS w FROM ({DOCS_F1}) d),
toks AS (SELECT ord, unnest(w) AS tok, unnest(generate_series(0, len(w) - 1)) AS pos FROM docs),
sub AS (SELECT ord, pos, unnest(benc.ids) AS id, unnest(generate_series(1, len(benc.ids))) AS q
        FROM toks JOIN benc ON benc.token = toks.tok),
num AS (SELECT ord // 100 AS batch, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord, pos, q) - 1 AS p, id FROM sub)
SELECT CAST(batch AS BIGINT) AS batch, CAST(p // 512 AS BIGINT) AS block,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS input_ids, CAST(count(*) AS BIGINT) AS n_tokens
FROM num GROUP BY batch, p // 512 HAVING count(*) = 512
"""

ORACLES["decode_bpe"] = f"""
SELECT doc_id, array_to_string({words('text')}, ' ') AS text FROM documents
"""

ORACLES["sft_encode_bpe"] = f"""
WITH RECURSIVE {bpe_all_cte('b', _ALL_DOCS, str(BPE_MERGES))},
{CONV_LISTS}, {turns_cte(SFT_ROWS, TEMPLATES['default'], _F2)},
segs AS ({segments_sql(TEMPLATES['default'], literal_id_sql('bv'))}),
{SEG_WORDS}, segw AS (SELECT DISTINCT tok AS token FROM wd),
{bpe_encode_cte('b', 'segw')}, {seg_subword_ids_cte('benc')}, {_SFT_AGG}
SELECT conv_id, {ids_text('ids')} AS input_ids, {ids_text('labels')} AS labels,
       {ids_text('list_transform(ids, lambda x: 1)')} AS attention_mask
FROM agg
"""

ORACLES["vocab_decompose"] = f"""
WITH RECURSIVE {_LANG_VOCABS},
added AS (SELECT id, token FROM n WHERE token NOT IN (SELECT token FROM b)),
{bpe_all_cte('o', _EN, str(BPE_MERGES), 'added')}
SELECT CAST(added.id AS BIGINT) AS new_id, added.token,
       {ids_text("CASE WHEN oenc.ids[1] = (SELECT id FROM ov WHERE token = '▁') THEN oenc.ids[2:] ELSE oenc.ids END")}
         AS old_ids
FROM added JOIN oenc ON oenc.token = added.token
"""

from .sqlparts import bpe_cover_cte, bpe_train_cte, bpe_vocab_cte, bpe_words_cte  # noqa: E402


def _lines(where: str) -> str:
    return (f"SELECT line AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents "
            f"WHERE {where}) x WHERE line <> '' AND strlen(line) <= 2000")


def _learned(p: str, where: str, vocab_size: int) -> str:
    return ",\n".join([
        bpe_words_cte(p, _lines(where)), bpe_cover_cte(p),
        f"{p}nm AS (SELECT greatest(0, {vocab_size} - (259 + (SELECT count(*) FROM {p}alpha))) AS n)",
        bpe_train_cte(p, f"SELECT n FROM {p}nm"), bpe_vocab_cte(p)])


ORACLES["extend_vocab"] = f"""
WITH RECURSIVE {_learned('o', "lang = 'en'", 400)},
{_learned('w', "lang IS DISTINCT FROM 'en'", 400)},
addsrc AS (SELECT id AS src_id, token FROM wv WHERE token NOT IN (SELECT token FROM ov)),
added AS (SELECT CAST((SELECT count(*) FROM ov) + row_number() OVER (ORDER BY src_id) - 1 AS BIGINT) AS id, token
          FROM addsrc),
{bpe_encode_cte('o', 'added')},
dec AS (SELECT added.id AS new_id,
               CASE WHEN oenc.ids[1] = (SELECT id FROM ov WHERE token = '▁') THEN oenc.ids[2:] ELSE oenc.ids END AS ids
        FROM added JOIN oenc ON oenc.token = added.token),
e AS (SELECT * FROM ({_EMB_LONG}) x WHERE id < (SELECT count(*) FROM ov)),
mem AS (SELECT new_id, unnest(ids) AS old_id FROM dec),
means AS (SELECT mem.new_id AS id, e.dim, avg(e.value) AS value FROM mem JOIN e ON e.id = mem.old_id
          GROUP BY mem.new_id, e.dim),
orphans AS (SELECT id FROM added WHERE id NOT IN (SELECT id FROM means)),
gm AS (SELECT dim, avg(value) AS value FROM e GROUP BY dim)
SELECT id, dim, round(value, 6) AS value FROM e
UNION ALL SELECT CAST(id AS BIGINT), dim, round(value, 6) FROM means
UNION ALL SELECT CAST(orphans.id AS BIGINT), gm.dim, round(gm.value, 6) FROM orphans JOIN gm ON TRUE
"""

ORACLES["pt_pack_cached"] = ORACLES["pt_pack"]

ORACLES["decode_bpe_full"] = ORACLES["decode_bpe"]

ORACLES["map_batches"] = """
SELECT CAST(o // 100 AS BIGINT) AS batch, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents WHERE text IS NOT NULL AND text <> '')
GROUP BY 1
"""
