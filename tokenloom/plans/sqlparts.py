"""Building blocks for the DuckDB oracle SQL of the registered queries.

The oracle is written independently of the Spark plans: plain SQL over the same
Parquet tables, arrays returned as space-joined text.
"""

from __future__ import annotations

# Same separator class and special pieces as the Spark side.
SEP_CLASS = r"[ \t\n\r\f]+"
SPECIALS_SQL = "SELECT 0 AS id, '<unk>' AS token UNION ALL SELECT 1, '<s>' UNION ALL SELECT 2, '</s>'"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{SEP_CLASS}'), lambda x: x <> '')"


def vocab_cte(name: str, text_source: str) -> str:
    """CTEs ``{name}_wc`` and ``{name}(id, token)``: specials, then words by count desc, token."""
    return (
        f"{name}_wc AS (SELECT tok AS token, count(*) AS cnt FROM "
        f"(SELECT unnest({words('text')}) AS tok FROM ({text_source}) src_) GROUP BY tok), "
        f"{name} AS ({SPECIALS_SQL} UNION ALL "
        f"SELECT CAST(row_number() OVER (ORDER BY cnt DESC, token) + 2 AS INTEGER) AS id, token "
        f"FROM {name}_wc WHERE token NOT IN ('<unk>', '<s>', '</s>'))"
    )


def ids_text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ' ')"


DOCS_F1 = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''"


# ---------------------------------------------------------------- instruction data

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replace_first(s: str, needle: str, repl: str) -> str:
    p = f"strpos({s}, {lit(needle)})"
    return (f"(CASE WHEN {p} > 0 THEN substr({s}, 1, {p} - 1) || {repl} || substr({s}, {p} + {len(needle)}) "
            f"ELSE {s} END)")


CONV_LISTS = """conv_msgs AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn) AS msgs
                  FROM conversations GROUP BY conv_id),
conv_lists AS (SELECT conv_id,
   list_transform(list_filter(msgs, lambda m: m.role = 'user'), lambda m: m.text) AS users,
   list_transform(list_filter(msgs, lambda m: m.role = 'assistant'), lambda m: m.text) AS asst,
   list_transform(list_filter(msgs, lambda m: m.role = 'system'), lambda m: m.text)[1] AS system
   FROM conv_msgs)"""

SFT_ROWS = """SELECT conv_id, system, users[greatest(len(asst), 1)] AS prompt, CAST(NULL AS VARCHAR) AS query,
       CASE WHEN len(asst) > 0 THEN asst[len(asst)] END AS response,
       list_transform(generate_series(1, len(asst) - 1), lambda i: struct_pack(query := users[i], response := asst[i])) AS history,
       CAST(NULL AS VARCHAR) AS alt
FROM conv_lists"""

PROMPT_ROWS = """SELECT conv_id, system, users[greatest(len(users), 1)] AS prompt, CAST(NULL AS VARCHAR) AS query,
       coalesce(asst[greatest(len(users), 1)], '') AS response,
       list_transform(generate_series(1, len(users) - 1), lambda i: struct_pack(query := users[i], response := asst[i])) AS history,
       CAST(NULL AS VARCHAR) AS alt
FROM conv_lists"""

PAIR_ROWS = """SELECT conv_id, system, users[1] AS prompt, CAST(NULL AS VARCHAR) AS query,
       asst[1] AS response,
       list_transform(generate_series(1, 0), lambda i: struct_pack(query := users[i], response := asst[i])) AS history,
       asst[2] AS alt
FROM conv_lists WHERE users[1] IS NOT NULL AND users[1] <> '' AND len(asst) > 1"""

def turns_cte(rows_sql: str, tpl, where: str = "TRUE") -> str:
    """``tx(conv_id, t, q, r, sys, alt, last_t)``: one row per turn after P4/P5."""
    q = "CASE WHEN query IS NOT NULL AND query <> '' THEN prompt || chr(10) || query ELSE prompt END"
    sys = f"CASE WHEN system IS NOT NULL AND system <> '' THEN system ELSE {lit(tpl.system)} END"
    cur = f"[struct_pack(query := {q}, response := response)]"
    turns = f"list_concat(coalesce(history, []), {cur})" if tpl.use_history else cur
    return (f"rw AS (SELECT * FROM ({rows_sql}) x WHERE {where}), "
            f"tl AS (SELECT conv_id, {sys} AS sys, alt, {turns} AS turns FROM rw), "
            f"tx AS (SELECT conv_id, sys, alt, len(turns) - 1 AS last_t, unnest(turns) AS tr, "
            f"unnest(generate_series(0, len(turns) - 1)) AS t FROM tl)")


def segments_sql(tpl, lit_id) -> str:
    """UNION ALL of ``(conv_id, t, side, seg, txt, lid, name)`` rows; ``lit_id(name)`` -> SQL for the id."""
    parts = []

    def text_row(cond, side, seg, expr):
        parts.append(f"SELECT conv_id, t, {side} AS side, {seg} AS seg, {expr} AS txt, CAST(NULL AS INTEGER) AS lid, "
                     f"CAST(NULL AS VARCHAR) AS name FROM tx WHERE {cond}")

    def id_row(cond, side, seg, name):
        parts.append(f"SELECT conv_id, t, {side} AS side, {seg} AS seg, CAST(NULL AS VARCHAR) AS txt, "
                     f"CAST({lit_id(name)} AS INTEGER) AS lid, {lit(name)} AS name FROM tx WHERE {cond}")

    def elems(cond, side, start, context, fill):
        for j, e in enumerate(context):
            if isinstance(e, dict):
                id_row(cond, side, start + j, e["token"])
            else:
                text_row(cond, side, start + j, fill(lit(e)))

    q = "tr.query"
    if tpl.llama2_layout:
        pre = tpl.prefix[0]
        q0 = f"(replace({lit(pre)}, '{{{{system}}}}', sys) || {q})"
        id_row("TRUE", 0, 0, "<s>")
        for j, e in enumerate(tpl.prompt):
            text_row("t = 0", 0, 100 + j, replace_first(lit(e), "{{query}}", q0))
            text_row("t > 0", 0, 100 + j, replace_first(lit(e), "{{query}}", q))
    else:
        def prefix_fill(s):
            return replace_first(s, "{{system}}", "sys")
        has = []
        for e in tpl.prefix:
            if isinstance(e, dict):
                has.append("TRUE")
            else:
                from .sqlparts import words as _w
                has.append(f"len({_w(prefix_fill(lit(e)))}) > 0")
        has_prefix = "(" + (" OR ".join(has) if has else "FALSE") + ")"
        id_row("t = 0", 0, 0, "<s>")
        elems(f"t = 0 AND {has_prefix}", 0, 1, tpl.prefix, prefix_fill)
        elems(f"t = 0 AND {has_prefix}", 0, 50, tpl.sep, lambda s: s)
        elems("t > 0", 0, 0, tpl.sep, lambda s: s)
        id_row("t > 0", 0, 50, "<s>")

        def prompt_fill(s):
            return replace_first(replace_first(s, "{{query}}", q), "{{idx}}", "CAST(t AS VARCHAR)")
        elems("TRUE", 0, 100, tpl.prompt, prompt_fill)
    text_row("TRUE", 1, 0, "tr.response")
    id_row("TRUE", 1, 1, "</s>")
    text_row("t = last_t AND alt IS NOT NULL", 2, 0, "alt")
    id_row("t = last_t AND alt IS NOT NULL", 2, 1, "</s>")
    return "\nUNION ALL\n".join(parts)


SEG_WORDS = (f"wd AS (SELECT conv_id, t, side, seg, unnest({words('txt')}) AS tok, "
             f"unnest(generate_series(0, len({words('txt')}) - 1)) AS wpos FROM segs WHERE txt IS NOT NULL)")


def seg_subword_ids_cte(enc: str) -> str:
    """``ts`` as in :func:`seg_ids_cte`, every word replaced by its pieces' ids in ``enc(token, ids)``."""
    return ("iw AS (SELECT conv_id, t, side, seg, 0 AS wpos, [lid] AS i FROM segs WHERE lid IS NOT NULL "
            f"UNION ALL SELECT conv_id, t, side, seg, wpos, {enc}.ids FROM wd JOIN {enc} ON {enc}.token = wd.tok), "
            "ts AS (SELECT conv_id, t, "
            "coalesce(flatten(list(i ORDER BY seg, wpos) FILTER (WHERE side = 0)), []) AS src, "
            "coalesce(flatten(list(i ORDER BY seg, wpos) FILTER (WHERE side = 1)), []) AS tgt "
            "FROM iw GROUP BY conv_id, t)")


def seg_ids_cte(vocab: str = "v") -> str:
    """``ids(conv_id, t, side, seg, wpos, id)`` from ``segs``."""
    return (f"{SEG_WORDS}, "
            f"ids AS (SELECT conv_id, t, side, seg, 0 AS wpos, lid AS id FROM segs WHERE lid IS NOT NULL "
            f"UNION ALL SELECT conv_id, t, side, seg, wpos, coalesce({vocab}.id, 0) AS id "
            f"FROM wd LEFT JOIN {vocab} ON {vocab}.token = wd.tok), "
            f"ts AS (SELECT conv_id, t, "
            f"coalesce(list(id ORDER BY seg, wpos) FILTER (WHERE side = 0), []) AS src, "
            f"coalesce(list(id ORDER BY seg, wpos) FILTER (WHERE side = 1), []) AS tgt, "
            f"coalesce(list(id ORDER BY seg, wpos) FILTER (WHERE side = 2), []) AS alt_ids "
            f"FROM ids GROUP BY conv_id, t)")


def literal_id_sql(vocab: str = "v"):
    def f(name):
        if name == "<s>":
            return "1"
        if name == "</s>":
            return "2"
        return f"coalesce((SELECT min(id) FROM {vocab} WHERE token = {lit(name)}), 0)"
    return f


CONV_VOCAB = "SELECT text FROM conversations"


def bpe_words_cte(p: str, text_source: str) -> str:
    """``{p}wc(token, cnt)``: word counts of ``text_source`` (column ``text``)."""
    return (f"{p}wc AS (SELECT tok AS token, count(*) AS cnt "
            f"FROM (SELECT unnest({words('text')}) AS tok FROM ({text_source}) src_) t GROUP BY tok)")


def bpe_cover_cte(p: str, coverage: float = 0.9995) -> str:
    """``{p}cr(ch, cnt, before, total)`` and ``{p}alpha(ch, pos)``: covered characters by count."""
    return f"""{p}cc AS (SELECT ch, sum(cnt) AS cnt FROM
               (SELECT unnest(string_split(token, '')) AS ch, cnt FROM {p}wc) x WHERE ch <> '' GROUP BY ch),
{p}cr AS (SELECT ch, cnt,
               coalesce(sum(cnt) OVER (ORDER BY cnt DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(cnt) OVER () AS total FROM {p}cc),
{p}alpha AS (SELECT '▁' AS ch, -1 AS pos
             UNION ALL SELECT ch, row_number() OVER (ORDER BY cnt DESC, ch) FROM {p}cr WHERE before < {coverage} * total)"""


def bpe_train_cte(p: str, n_merges: str) -> str:
    """``{p}st`` (recursive) and ``{p}m(rank, a, b, count)``: plain BPE in SQL.  Symbols are
    wrapped as chr(1) sym chr(2), so a literal ``replace`` merges non-overlapping pairs left
    to right; each iteration takes the pair with the highest count (ties: left, right
    symbol); digits never pair.  ``n_merges`` is SQL (a number or a scalar subquery)."""
    return f"""{p}st(it, token, cnt, s, ma, mb, mc) AS (
  SELECT 0, token, cnt,
         array_to_string(list_transform(string_split('▁' || token, ''), lambda c: chr(1) || c || chr(2)), ''),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
  FROM {p}wc
  UNION ALL
  SELECT it + 1, token, cnt,
         replace(s, chr(1) || ba || chr(2) || chr(1) || bb || chr(2), chr(1) || ba || bb || chr(2)),
         ba, bb, bc
  FROM (
    SELECT DISTINCT it, token, cnt, s,
           first(a) OVER w AS ba, first(b) OVER w AS bb, first(pc) OVER w AS bc
    FROM (
      SELECT it, token, cnt, s, a, b, sum(cnt) OVER (PARTITION BY a, b) AS pc
      FROM (
        SELECT it, token, cnt, s, l[i] AS a, l[i + 1] AS b
        FROM (SELECT it, token, cnt, s, l, unnest(generate_series(1, len(l) - 1)) AS i
              FROM (SELECT it, token, cnt, s,
                           list_transform(list_filter(string_split(s, chr(2)), lambda x: x <> ''),
                                          lambda x: substr(x, 2)) AS l
                    FROM {p}st WHERE it < ({n_merges})) q1) q2
      ) q3
      WHERE NOT (regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]'))
    ) q4
    WINDOW w AS (ORDER BY pc DESC, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  ) q5
),
{p}m AS (SELECT DISTINCT CAST(it - 1 AS INTEGER) AS rank, ma AS a, mb AS b, mc AS count FROM {p}st WHERE it > 0)"""


def bpe_vocab_cte(p: str) -> str:
    """``{p}v(id, token)``: specials, 256 byte pieces, merged pieces in rank order (first
    occurrence), then the alphabet."""
    return f"""{p}pieces AS (SELECT a || b AS token, 0 AS grp, rank AS pos FROM {p}m
            UNION ALL SELECT ch, 1, pos FROM {p}alpha),
{p}first AS (SELECT token, min(grp * 1000000000 + pos) AS k FROM {p}pieces
           WHERE token NOT IN ('<unk>', '<s>', '</s>') AND NOT regexp_matches(token, '^<0x[0-9A-F][0-9A-F]>$')
           GROUP BY token),
{p}v AS (SELECT 0 AS id, '<unk>' AS token UNION ALL SELECT 1, '<s>' UNION ALL SELECT 2, '</s>'
       UNION ALL SELECT 3 + b, '<0x' || upper(lpad(to_hex(b), 2, '0')) || '>' FROM range(256) t(b)
       UNION ALL SELECT CAST(258 + row_number() OVER (ORDER BY k) AS INTEGER), token FROM {p}first)"""


def bpe_encode_cte(p: str, source: str) -> str:
    """``{p}enc(token, ids)``: every ``token`` of ``source`` encoded by applying the merges in
    rank order (for a trained merge list this equals lowest-rank-first BPE), unknown
    characters as bytes."""
    return f"""{p}app(k, token, s) AS (
  SELECT 0, token, array_to_string(list_transform(string_split('▁' || token, ''), lambda c: chr(1) || c || chr(2)), '')
  FROM {source}
  UNION ALL
  SELECT k + 1, token,
         replace(s, chr(1) || mm.a || chr(2) || chr(1) || mm.b || chr(2), chr(1) || mm.a || mm.b || chr(2))
  FROM {p}app JOIN {p}m mm ON mm.rank = {p}app.k
),
{p}fin AS (SELECT token, s FROM {p}app WHERE k = (SELECT count(*) FROM {p}m)),
{bpe_piece_ids_cte(p)}"""


def bpe_piece_ids_cte(p: str) -> str:
    """``{p}enc(token, ids)``: ids of the symbols of ``{p}fin(token, s)``."""
    return f"""{p}pc AS (SELECT token, p, substr(x, 2) AS piece FROM
          (SELECT token, unnest(list_filter(string_split(s, chr(2)), lambda x: x <> '')) AS x,
                  unnest(generate_series(1, len(list_filter(string_split(s, chr(2)), lambda x: x <> '')))) AS p
           FROM {p}fin) y),
{p}ids AS (SELECT pc.token, pc.p, 0 AS q, v.id FROM {p}pc pc JOIN {p}v v ON v.token = pc.piece
         UNION ALL
         SELECT token, p, q, 3 + CAST(('0x' || substr(h, 2 * q + 1, 2)) AS INTEGER)
         FROM (SELECT pc.token, pc.p, hex(encode(pc.piece)) AS h FROM {p}pc pc
               WHERE pc.piece NOT IN (SELECT token FROM {p}v)) z, range(0, 8) r(q)
         WHERE 2 * q < length(h)),
{p}enc AS (SELECT token, list(id ORDER BY p, q) AS ids FROM {p}ids GROUP BY token)"""


def bpe_all_cte(p: str, text_source: str, n_merges: str, encode_source: str | None = None,
                coverage: float = 0.9995) -> str:
    parts = [bpe_words_cte(p, text_source), bpe_cover_cte(p, coverage), bpe_train_cte(p, n_merges),
             bpe_vocab_cte(p)]
    if encode_source is not None:
        parts.append(bpe_encode_cte(p, encode_source))
    return ",\n".join(parts)


def bpe_train_keyed_cte(p: str, n_merges: str) -> str:
    """``{p}st`` (recursive, keyed), ``{p}m(rank, a, b, count)`` and ``{p}fin(token, s)``: the merges of :func:`bpe_train_cte` and
    the words past all of them, for long merge lists.

    The state holds every word (kind 0) and every merge (kind 1) once; an iteration rewrites the words it changes.  It
    takes the first pairs in (count desc, left, right) order, up to the first one whose count or turn an earlier one may
    change: the later pair (b, c) of three neighbours a, b, c, or (a, b) if that is the later one; a pair that the new pair (ab, c)
    would come before, which takes that every (b, c) stands behind an a (else (ab, c) occurs less often than (b, c), which comes
    after the pairs taken); the pair after one of two equal symbols.
    """
    return f"""{p}st(k, kind, token, cnt, s, a, b) USING KEY (k) AS (
  SELECT row_number() OVER (), 0, token, CAST(cnt AS BIGINT),
         array_to_string(list_transform(string_split('▁' || token, ''), lambda c: chr(1) || c || chr(2)), ''),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  FROM {p}wc
  UNION
  (WITH sy AS (SELECT k, token, cnt, s, list_transform(string_split(s[:-2], chr(2)), lambda x: x[2:]) AS l
              FROM recurring.{p}st WHERE kind = 0),
  pr AS MATERIALIZED (SELECT k, i, cnt, a, b
         FROM (SELECT k, cnt, unnest(l[:-2]) AS a, unnest(l[2:]) AS b, unnest(range(1, len(l))) AS i FROM sy WHERE len(l) > 1) x
         WHERE NOT (regexp_matches(a, '[0-9]') OR regexp_matches(b, '[0-9]'))),
  pc AS MATERIALIZED (SELECT a, b, c, row_number() OVER (ORDER BY c DESC, a, b) AS rk, rank() OVER (ORDER BY c DESC) AS grp
         FROM (SELECT a, b, CAST(sum(cnt) AS BIGINT) AS c FROM pr GROUP BY a, b) x),
  tp AS MATERIALIZED (SELECT a, b, c, rk FROM pc WHERE grp <= 1000),
  tr AS MATERIALIZED (SELECT k, i, cnt, pr.a, pr.b, c, rk FROM pr JOIN tp ON tp.a = pr.a AND tp.b = pr.b),
  tri AS MATERIALIZED (SELECT x.rk AS r1, y.rk AS r2, any_value(x.a || x.b) AS a, any_value(y.b) AS b, any_value(y.c) AS c, sum(x.cnt) AS t
         FROM tr x JOIN tr y ON y.k = x.k AND y.i = x.i + 1 GROUP BY x.rk, y.rk),
  vr AS (SELECT v, greatest(v + 1, count(rk) OVER (ORDER BY c DESC, a, b, rk NULLS LAST ROWS UNBOUNDED PRECEDING) + 1) AS r
         FROM (SELECT a, b, c, rk, NULL AS v FROM tp UNION ALL SELECT a, b, c, NULL, r1 FROM tri WHERE t = c AND r1 <> r2) x),
  cut AS (SELECT min(r) AS rk FROM (SELECT greatest(r1, r2) AS r FROM tri WHERE r1 <> r2
            UNION ALL SELECT r FROM vr WHERE v IS NOT NULL UNION ALL SELECT rk + 1 FROM tp WHERE a = b
            UNION ALL SELECT 1001) x),
  done AS (SELECT count(*) AS n FROM recurring.{p}st WHERE kind = 1),
  bt AS MATERIALIZED (SELECT pc.a, pc.b, pc.c, pc.rk + done.n AS rank FROM pc, cut, done
         WHERE pc.rk < cut.rk AND pc.rk + done.n <= ({n_merges})),
  ch AS (SELECT k, list(DISTINCT chr(1) || pr.a || chr(2) || chr(1) || pr.b || chr(2)) AS ps
         FROM pr JOIN bt ON bt.a = pr.a AND bt.b = pr.b GROUP BY k)
  SELECT sy.k, 0, sy.token, sy.cnt,
         list_reduce(list_prepend(sy.s, ch.ps), lambda x, y: replace(x, y, replace(y, chr(2) || chr(1), ''))),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  FROM sy JOIN ch ON ch.k = sy.k
  UNION ALL
  SELECT -rank, 1, NULL, c, NULL, a, b FROM bt)
),
{p}m AS (SELECT CAST(-k - 1 AS INTEGER) AS rank, a, b, cnt AS count FROM {p}st WHERE kind = 1),
{p}fin AS (SELECT token, s FROM {p}st WHERE kind = 0)"""


def bpe_pieces_cte(p: str, text_source: str, pieces: int, coverage: float = 0.9995) -> str:
    """A vocabulary of ``pieces`` pieces learned from ``text_source``, and ``{p}enc(token, ids)`` of all its words."""
    n = f"{p}nm AS (SELECT greatest(0, {pieces} - (259 + (SELECT count(*) FROM {p}alpha))) AS n)"
    return ",\n".join([bpe_words_cte(p, text_source), bpe_cover_cte(p, coverage), n, bpe_train_keyed_cte(p, f"SELECT n FROM {p}nm"),
                       bpe_vocab_cte(p), bpe_piece_ids_cte(p)])
