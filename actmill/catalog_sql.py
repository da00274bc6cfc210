"""The same rows in DuckDB SQL."""

from __future__ import annotations

from actmill.functions.refs import LAWS
from actmill.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tok(c: str) -> str:
    return rf"list_filter(regexp_extract_all(strip_accents(lower({c})), '[\p{{L}}\p{{N}}_]+(?:\^[\p{{L}}\p{{N}}_]+)?'), lambda w: NOT list_contains({_STOP}, w))"


_NL = "chr(10)"
#: Greedy groups of the non-blank lines of each document, and the chunks they make.
CHUNKS = f"""
units AS (SELECT doc_id, source, lang, u, i FROM (SELECT doc_id, source, lang, list_filter(string_split(text, {_NL}), lambda x: trim(x) <> '') AS a FROM documents), unnest(a) WITH ORDINALITY AS t(u, i)),
walk AS (SELECT doc_id, i, 0 AS g, length(u) + 1 AS size FROM units WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, CASE WHEN walk.size + length(n.u) > 3200 THEN g + 1 ELSE g END, CASE WHEN walk.size + length(n.u) > 3200 THEN 0 ELSE walk.size END + length(n.u) + 1
  FROM walk JOIN units n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1),
grouped AS (SELECT doc_id, source, lang, g, string_agg(u, {_NL} ORDER BY i) AS body FROM walk JOIN units USING (doc_id, i) GROUP BY ALL),
chunks AS MATERIALIZED (SELECT source || ':art' || doc_id || ':' || (g + 1) AS chunk_id, doc_id, source AS law_slug, upper(source) AS law_ref, doc_id::VARCHAR AS article, (g + 1)::INT AS part,
  (count(*) OVER (PARTITION BY doc_id))::INT AS n_parts, upper(source) || ' (' || upper(source) || ') > ' || lang || {_NL} || 'Art. ' || doc_id AS header, body, 'doc:' || doc_id AS url,
  upper(source) || ' (' || upper(source) || ') > ' || lang || {_NL} || 'Art. ' || doc_id || {_NL} || body AS text FROM grouped)
"""
BM25_PARTS = f"""
toks AS MATERIALIZED (SELECT chunk_id, {_tok("text")} AS tokens FROM chunks),
stats AS (SELECT count(*) AS n_chunks, avg(len(tokens)) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stats),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)
"""
BM25 = f"""{CHUNKS}, {BM25_PARTS},
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_tok("text")}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT qid, chunk_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN post USING (term), stats GROUP BY 1, 2)
"""


def _bm25(where: str = "true") -> str:
    return f"""{BM25},
bm AS (SELECT qid, chunk_id, score, rank FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, part)::INT AS rank
  FROM scored JOIN chunks USING (chunk_id) WHERE score > 0 AND {where}) WHERE rank <= 30)"""


IN_LAWS = "law_slug IN ('src1', 'src2', 'src3')"
VECTOR = """
dv AS (SELECT chunk_id, law_slug, doc_id, part, embedding::DOUBLE[] AS v FROM embeddings JOIN chunks ON vec_id = doc_id),
qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM embeddings JOIN benchmark ON vec_id = item_id),
ve AS (SELECT qid, chunk_id, score, rank FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, part)::INT AS rank
  FROM (SELECT qid, chunk_id, doc_id, part, round(list_dot_product(qv.v, dv.v), 6) AS score FROM qv, dv)) WHERE rank <= 30)"""


#: Each question's own acts, as the queries give them.
EACH = "(qid % 3 <> 0 OR {} IN ('src1', 'src5'))"
VECTOR_EACH = VECTOR.replace("FROM qv, dv)", f"FROM qv, dv WHERE {EACH.format("law_slug")})")


def _fused(weight: float = 1.0, where: str = "true", vector: str = VECTOR) -> str:
    return f"""{_bm25(where)}, {vector},
lists AS (SELECT qid, chunk_id, rank, 'bm25' AS method, 0 AS pos, {weight}::DOUBLE AS weight FROM bm UNION ALL SELECT qid, chunk_id, rank, 'vector', 1, 1.0::DOUBLE FROM ve),
fu AS (SELECT qid, chunk_id, round(sum(weight / (60 + rank)), 9) AS score, min((pos, rank)) AS seen, list(DISTINCT method ORDER BY method) AS methods FROM lists GROUP BY 1, 2),
fused AS (SELECT qid, chunk_id, score, methods, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, chunk_id)::INT AS fused_rank FROM fu)"""


GROUPED = """
arts AS (SELECT qid, law_slug, article, arg_min(score, fused_rank) AS score, min(fused_rank) AS best_rank, list(part ORDER BY part) AS parts, list_sort(list_distinct(flatten(list(methods)))) AS sources
  FROM fused JOIN chunks USING (chunk_id) GROUP BY 1, 2, 3)"""
PINS = """
refs AS (SELECT qid, ref_pos, source AS law_slug, doc_id::VARCHAR AS article FROM (SELECT item_id AS qid, unnest([0, 1])::INT AS ref_pos, unnest([item_id, item_id + 1]) AS doc_id FROM benchmark WHERE item_id % 4 = 0) JOIN documents USING (doc_id)),
pins AS (SELECT qid, ref_pos, law_slug, article, list(part ORDER BY part) AS parts FROM refs JOIN chunks USING (law_slug, article) GROUP BY 1, 2, 3, 4)"""
GOLD = """
gold AS (SELECT item_id AS qid, list(DISTINCT source || ':' || doc_id ORDER BY source || ':' || doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
ask AS (SELECT item_id AS qid, text AS question, coalesce(gold, []::VARCHAR[]) AS gold, CASE WHEN gold IS NULL THEN 'unanswerable' ELSE 'natural' END AS type FROM benchmark LEFT JOIN gold ON qid = item_id)"""
RANKED = f"""{_bm25()}, {GOLD},
keyed AS (SELECT qid, law_slug || ':' || article AS key, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM bm JOIN chunks USING (chunk_id) GROUP BY qid, law_slug, article),
best AS (SELECT qid, min(rank)::INT AS rank FROM keyed JOIN ask USING (qid) WHERE rank <= 10 AND list_contains(gold, key) GROUP BY 1),
ranked AS (SELECT ask.*, rank FROM ask LEFT JOIN best USING (qid))"""
_METRICS = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr"
SWEEP = f"""{_bm25()}, {VECTOR}, {GOLD},
vs(variant, method, pos, weight) AS (SELECT v, m, p, w::DOUBLE FROM (VALUES ('bm25', 1.0, 0.0), ('vector', 0.0, 1.0), ('hybrid', 1.0, 1.0), ('hybrid_weighted', 0.3, 1.0), ('vector_rerank', 0.0, 1.0), ('hybrid_rerank', 1.0, 1.0), ('hybrid_rerank_refs', 1.0, 1.0)) AS x(v, b, e),
  LATERAL (VALUES ('bm25', 0, b), ('vector', 1, e)) AS y(m, p, w) WHERE w > 0),
lists AS (SELECT qid, chunk_id, rank, 'bm25' AS method FROM bm UNION ALL SELECT qid, chunk_id, rank, 'vector' FROM ve),
fu AS (SELECT variant, qid, chunk_id, round(sum(weight / (60 + rank)), 9) AS score, min((pos, rank)) AS seen FROM lists JOIN vs USING (method) GROUP BY 1, 2, 3),
fused0 AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, seen, chunk_id) AS fused_rank FROM fu),
pair AS (SELECT variant, qid, chunk_id, fused_rank, list_distinct({_tok('b.text')}) AS q, {_tok('c.text')} AS t FROM fused0 JOIN benchmark b ON item_id = qid JOIN chunks c USING (chunk_id) WHERE fused_rank <= 20 AND variant LIKE '%rerank%'),
again AS (SELECT variant, qid, chunk_id, fused_rank, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t)) / len(q)::DOUBLE, 6) ELSE 0 END AS score FROM pair),
fused AS (SELECT variant, qid, chunk_id, fused_rank FROM fused0 WHERE variant NOT LIKE '%rerank%' UNION ALL SELECT variant, qid, chunk_id, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, fused_rank) FROM again), {PINS},
arts AS (SELECT variant, qid, law_slug, article, 1 AS other, min(fused_rank) AS spot FROM fused JOIN chunks USING (chunk_id) GROUP BY ALL),
pinned AS (SELECT 'hybrid_rerank_refs' AS variant, qid, law_slug, article, 0 AS other, ref_pos AS spot FROM pins),
hits AS (SELECT * FROM (SELECT variant, qid, law_slug || ':' || article AS key, row_number() OVER (PARTITION BY variant, qid ORDER BY other, spot, law_slug, article)::INT AS rank
  FROM (SELECT * FROM pinned UNION ALL SELECT * FROM arts ANTI JOIN pinned USING (variant, qid, law_slug, article))) WHERE rank <= 10),
each AS (SELECT DISTINCT variant, ask.* FROM ask, vs WHERE len(gold) > 0),
best AS (SELECT variant, qid, min(rank)::INT AS rank FROM hits JOIN ask USING (qid) WHERE list_contains(gold, key) GROUP BY 1, 2),
ranked AS (SELECT each.*, rank FROM each LEFT JOIN best USING (variant, qid))"""
ANSWERS = """
ans AS (SELECT conv_id || '-' || turn AS id, turn, length(text) AS len, turn % 5 AS n_sources,
  text || CASE WHEN turn % 3 = 0 THEN '' ELSE ' [' || (turn % 6) || '] [2] [9] [2]' END || ' vezi art. ' || (len % 50) || CASE WHEN turn % 4 = 0 THEN '^1' ELSE '' END || ' si articolul ' || turn AS text
  FROM (SELECT conv_id, turn, text, length(text) AS len FROM conversations WHERE role = 'assistant')),
hit AS (SELECT id, unnest([1, 2, 3, 4])::INT AS n, unnest([(len % 50)::VARCHAR, (len % 50) || '^1', turn::VARCHAR, (len % 7)::VARCHAR]) AS article FROM ans),
marks AS (SELECT id, n_sources, m.m AS m, min(m.i) AS i FROM ans, unnest(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS BIGINT))) WITH ORDINALITY AS m(m, i) GROUP BY 1, 2, 3),
cite AS (SELECT ans.id, coalesce(c, []::BIGINT[]) AS cited, coalesce(w, []::BIGINT[]) AS invalid FROM ans
  LEFT JOIN (SELECT id, list(m ORDER BY i) FILTER (m BETWEEN 1 AND n_sources) AS c, list(m ORDER BY i) FILTER (m IS NULL OR m NOT BETWEEN 1 AND n_sources) AS w FROM marks GROUP BY 1) k USING (id)),
inf AS (SELECT id, list(DISTINCT n::BIGINT ORDER BY n::BIGINT) AS inferred FROM ans JOIN hit USING (id)
  WHERE regexp_matches(text, '\\bart(?:icolul|\\.)?\\s*' || replace(article, '^', '\\^') || '([^\\d^]|$)') GROUP BY 1)"""
LOGS = """
lab AS (SELECT doc_id, quality, toxic, source, n_chars, source || ':' || doc_id AS key FROM labels JOIN documents USING (doc_id)),
log AS (SELECT (doc_id % 97)::VARCHAR AS id, 'm' || (doc_id % 3) AS model, n_chars + t AS latency_ms, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 1000 END AS output_tokens,
  CASE WHEN doc_id % 2 = 0 THEN [key] ELSE []::VARCHAR[] END AS cited, CASE WHEN doc_id % 7 = 0 THEN [9] ELSE []::INT[] END AS invalid_citations,
  CASE WHEN (t = 0 AND doc_id % 5 = 0) OR doc_id % 13 = 0 THEN 'quota' END AS error, doc_id * 3 + t AS seq
  FROM lab, (VALUES (0), (1), (2)) AS x(t) WHERE t = 0 OR (doc_id % 5 = 0 AND t = 1) OR (doc_id % 11 = 0 AND t = 2)),
last_answers AS (SELECT id, model, max(seq) AS seq, arg_max(latency_ms, seq) AS latency_ms, arg_max(coalesce(output_tokens, 0), seq) AS output_tokens, arg_max(cited, seq) AS cited, arg_max(invalid_citations, seq) AS invalid_citations FROM log WHERE error IS NULL GROUP BY 1, 2),
judged AS (SELECT (doc_id % 97)::VARCHAR AS id, 'm' || (doc_id % 3) AS model, doc_id % 2 AS round, arg_max(quality, doc_id) AS q, arg_max(toxic, doc_id) AS t, max(doc_id) AS doc FROM labels WHERE doc_id % 17 <> 0 GROUP BY 1, 2, 3),
newest AS (SELECT id, model, q * 2 - doc % 2 * q AS correctness, t = 0 AS faithful, t = 1 AS refused FROM judged WHERE round = (SELECT max(round) FROM judged j WHERE j.id = judged.id)),
lq AS (SELECT r::VARCHAR AS id, CASE WHEN r % 6 = 0 THEN 'unanswerable' WHEN r % 6 = 1 THEN 'trap' ELSE 'natural' END AS type, CASE WHEN r % 6 = 0 THEN []::VARCHAR[] ELSE coalesce(g, []::VARCHAR[]) END AS gold
  FROM (SELECT doc_id % 97 AS r, list(DISTINCT key ORDER BY key) FILTER (quality = 1) AS g FROM lab WHERE doc_id % 97 <> 3 GROUP BY 1))"""
MARKED = f"""
marked AS (SELECT doc_id, list_transform(list_filter(string_split(text, {_NL}), lambda x: trim(x) <> ''), lambda x, i: CASE (doc_id + i - 1) % 7 WHEN 0 THEN '(la data de 01-02-2020 ' || x WHEN 1 THEN 'b) abrogată.' WHEN 2 THEN '(2^1) Abrogat' ELSE CASE WHEN doc_id % 10 = 3 THEN 'ABROGATE.' ELSE x END END) AS units FROM documents)"""
_ABR = r"'(?i)^(\(\d+(\^\d+)?\)\s*|[a-z](\^\d+)?\)\s*|\d+\.\s*)?abrogat[ăeĂE]?\.?$'"
_LAW_CASES = ", ".join(
    "CASE WHEN " + " OR ".join(rf"regexp_matches(plain, '\b{a}\b')" for a in law[4]) + f" THEN '{law[0]}' END" for law in LAWS
)
_ALIASES = "[" + ", ".join(f"'{law[4][-1].upper()}'" for law in LAWS) + "]"
SCRIPTED = rf"""
asked AS (SELECT doc_id AS qid, strip_accents(lower('Art. ' || (doc_id % 400) || CASE WHEN doc_id % 5 = 0 THEN ' ind. ' || (doc_id % 4) ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN ', articolul ' || (doc_id % 31) || '^2' ELSE '' END
  || CASE WHEN doc_id % 8 = 0 THEN '' ELSE ' din ' || ({_ALIASES})[doc_id % 6 + 1] END || CASE WHEN doc_id % 7 = 0 THEN ' și Codul Penal' ELSE '' END || ' ' || text)) AS plain FROM documents),
law AS (SELECT qid, plain, list_filter([{_LAW_CASES}], lambda x: x IS NOT NULL) AS laws FROM asked)"""
_ART = r"'\bart(?:icolul|icolului|icol|\.)?\s*(\d+)(?:\s*(?:\^|ind(?:ice)?\.?)\s*(\d+))?'"

ORACLE_SQL = {
    "strip_diacritics": "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents",
    "tokenize": f"SELECT doc_id, {_tok('text')} AS tokens FROM documents",
    "normalize_cedilla": "SELECT doc_id, translate(regexp_replace(regexp_replace(text, 's([aeiou])', 'ş\\1', 'g'), 'T([aeiou])', 'Ţ\\1', 'g'), 'şţŞŢ', 'șțȘȚ') AS text FROM documents",
    "collapse_ws": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ' ', ' ' || chr(9) || ' '), {_NL}), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0B\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), {_NL}) AS text FROM documents",
    "latest_version": "SELECT c_custkey AS law, coalesce(doc_id, -c_custkey) AS doc_id, version_date::VARCHAR AS version_date FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS doc_id, o_orderdate::DATE AS version_date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) AS k FROM orders) o ON o_custkey = c_custkey AND k = 1",
    "consolidations": "SELECT page_id, pos, CASE pos WHEN 0 THEN page_id + 5 WHEN 1 THEN page_id * 10 ELSE page_id * 10 + 1 END AS doc_id, (DATE '2020-01-01' + (page_id % 500 + CASE pos WHEN 1 THEN 5 ELSE 9 END)::INT)::VARCHAR AS version_date FROM pages, (VALUES (0), (1), (2)) AS t(pos)",
    "count_elements": "SELECT page_id, n AS n_articles, n = 0 AS rejected FROM (SELECT page_id, ((length(html) - length(replace(html, 'class=\"ad\"', ''))) / 10)::INT AS n FROM pages)",
    "amendment_filter": f"WITH {MARKED} SELECT doc_id, list_filter(units, lambda u: NOT regexp_matches(u, '^\\(la (data de )?\\d{{2}}-\\d{{2}}-\\d{{4}}')) AS units FROM marked",
    "abrogated_filter": f"WITH {MARKED} SELECT doc_id, len(units) = len(list_filter(units, lambda u: regexp_matches(u, {_ABR}))) AS abrogated, CASE WHEN len(units) = len(list_filter(units, lambda u: regexp_matches(u, {_ABR}))) THEN units ELSE list_filter(units, lambda u: NOT regexp_matches(u, {_ABR})) END AS units FROM marked",
    "marginal_title": f"""WITH u AS (SELECT doc_id, list_transform(list_filter(string_split(text, {_NL}), lambda x: trim(x) <> ''), lambda x: CASE WHEN doc_id % 3 = 0 THEN regexp_replace(x, '[.]$', '') ELSE x END) AS units FROM documents),
m AS (SELECT doc_id, units, len(units) > 1 AND length(units[1]) < 120 AND NOT regexp_matches(units[1], '[.:;,]$') AS moved FROM u)
SELECT doc_id, CASE WHEN moved THEN units[1] ELSE '' END AS title, CASE WHEN moved THEN units[2:] ELSE units END AS units FROM m""",
    "article_number": f"""SELECT doc_id, list_transform(string_split(text, {_NL}), lambda x, i: CASE WHEN (doc_id + i - 1) % 3 = 0 THEN 'Anexa ' || x || CASE WHEN i % 2 = 1 THEN '^1 ' ELSE '' END
  WHEN trim(x || CASE WHEN i % 2 = 1 THEN '^1 ' ELSE '' END) = '' THEN 'Articolul  ' || x ELSE trim(ltrim(x, ' ' || chr(9)) || CASE WHEN i % 2 = 1 THEN '^1 ' ELSE '' END) END) AS numbers FROM documents""",
    "article_stats": "SELECT source AS law_slug, count(*) AS n_articles, count(*) FILTER (doc_id % 10 <> 3) AS n_in_force FROM documents GROUP BY 1",
    "article_references": "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z]\\p{L}+'))) AS \"references\" FROM documents",
    "group_units": f"""WITH RECURSIVE units AS (SELECT doc_id, u, i FROM (SELECT doc_id, string_split(text, {_NL}) AS a FROM documents), unnest(a) WITH ORDINALITY AS t(u, i)),
walk AS (SELECT doc_id, i, 0 AS g, length(u) + 1 AS size FROM units WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN walk.size + length(n.u) > 600 THEN g + 1 ELSE g END, CASE WHEN walk.size + length(n.u) > 600 THEN 0 ELSE walk.size END + length(n.u) + 1 FROM walk JOIN units n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1),
c AS (SELECT doc_id, g, count(*)::INT AS k FROM walk GROUP BY 1, 2) SELECT doc_id, list(k ORDER BY g) AS sizes FROM c GROUP BY 1""",
    "split_long_unit": f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, {_NL}) AS a FROM documents),
items AS (SELECT doc_id, u, i, 1500 - length(a[1]) - 1 AS room FROM d, unnest(a[2:]) WITH ORDINALITY AS t(u, i) WHERE length(text) > 1500),
walk AS (SELECT doc_id, i, 0 AS g, length(u) + 1 AS size FROM items WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN walk.size + length(n.u) > room THEN g + 1 ELSE g END, CASE WHEN walk.size + length(n.u) > room THEN 0 ELSE walk.size END + length(n.u) + 1 FROM walk JOIN items n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1),
p AS (SELECT doc_id, g, string_agg(u, {_NL} ORDER BY i) AS body FROM walk JOIN items USING (doc_id, i) GROUP BY 1, 2),
r AS (SELECT doc_id, list(body ORDER BY g) AS bodies FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN bodies IS NULL THEN [text] ELSE list_transform(bodies, lambda b: a[1] || {_NL} || b) END AS pieces FROM d LEFT JOIN r USING (doc_id)""",
    "chunk_articles": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, law_slug, law_ref, article, part, n_parts, header, body, url, law_ref || ', art. ' || article AS citation FROM chunks",
    "chunk_stats": f"WITH RECURSIVE {CHUNKS} SELECT law_slug, count(*) AS n_chunks, NULL::INT AS median, NULL::INT AS longest FROM chunks GROUP BY 1 UNION ALL SELECT NULL, count(*), list_sort(list(length(text)))[(count(*) // 2 + 1)::INT]::INT, max(length(text))::INT FROM chunks",
    "content_hash": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, left(sha256(text), 16) AS hash FROM chunks",
    "sync_diff": """WITH w AS (SELECT doc_id AS id, left(sha256(text), 16) AS h FROM documents),
e AS (SELECT doc_id AS id, left(sha256(CASE WHEN doc_id % 11 = 0 THEN text || ' old' ELSE text END), 16) AS h FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, left(sha256(text), 16) FROM documents WHERE doc_id % 13 = 0)
SELECT coalesce(w.id, e.id) AS id, CASE WHEN e.id IS NULL THEN 'new' WHEN w.id IS NULL THEN 'stale' WHEN w.h <> e.h THEN 'changed' ELSE 'same' END AS state FROM w FULL JOIN e ON w.id = e.id""",
    "sync_apply": "SELECT doc_id AS id, left(sha256(text), 16) AS hash, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'embedded' ELSE 'kept' END AS origin FROM documents",
    "l2_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x * ((i - 1) % 3 + 1)) AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS unit FROM v",
    "bm25_idf": f"WITH RECURSIVE {CHUNKS}, {BM25_PARTS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_idf_levels": f"WITH RECURSIVE {CHUNKS}, {BM25_PARTS} SELECT df, count(*) AS n_terms, round(max(idf), 6) AS idf, count(DISTINCT round(idf, 6)) AS n_idf FROM idf GROUP BY df",
    "bm25_search": f"WITH RECURSIVE {_bm25()} SELECT qid, chunk_id, score, rank FROM bm",
    "vector_law_filter": f"WITH RECURSIVE {CHUNKS}, {VECTOR.replace('FROM qv, dv)', f'FROM qv, dv WHERE {IN_LAWS})')} SELECT qid, chunk_id, score, rank FROM ve",
    "bm25_law_filter": f"WITH RECURSIVE {_bm25(IN_LAWS)} SELECT qid, chunk_id, score, rank FROM bm",
    "vector_topk": "SELECT qid, id, score, rank FROM (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id)::INT AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
    "rrf": f"WITH RECURSIVE {_fused()} SELECT * FROM fused",
    "rrf_weighted": f"WITH RECURSIVE {_fused(0.3)} SELECT * FROM fused",
    "rerank_lexical": f"""WITH RECURSIVE {_fused()},
pair AS (SELECT qid, chunk_id, fused_rank, list_distinct({_tok('b.text')}) AS q, {_tok('c.text')} AS t FROM fused JOIN benchmark b ON item_id = qid JOIN chunks c USING (chunk_id) WHERE fused_rank <= 20),
s AS (SELECT qid, chunk_id, fused_rank, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t)) / len(q)::DOUBLE, 6) ELSE 0 END AS score FROM pair)
SELECT qid, chunk_id, score, fused_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank)::INT AS final_rank FROM s""",
    "group_articles": f"WITH RECURSIVE {_fused()}, {GROUPED} SELECT * FROM arts",
    "pinned": f"WITH RECURSIVE {CHUNKS}, {PINS} SELECT * FROM pins",
    "hybrid_top5": f"""WITH RECURSIVE {_fused()}, {GROUPED}, {PINS},
every AS (SELECT qid, law_slug, article, -1.0::DOUBLE AS score, true AS explicit, ['ref'] AS sources, parts, ref_pos AS spot FROM pins UNION ALL SELECT qid, law_slug, article, score, false, sources, parts, best_rank FROM arts ANTI JOIN pins USING (qid, law_slug, article))
SELECT * EXCLUDE (spot) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY explicit DESC, spot, law_slug, article)::INT AS rank FROM every) WHERE rank <= 5""",
    "hybrid_laws": f"""WITH RECURSIVE {_fused(where=EACH.format('law_slug'), vector=VECTOR_EACH)}, {GROUPED}, {PINS},
every AS (SELECT qid, law_slug, article, -1.0::DOUBLE AS score, true AS explicit, ['ref'] AS sources, parts, ref_pos AS spot FROM pins UNION ALL SELECT qid, law_slug, article, score, false, sources, parts, best_rank FROM arts ANTI JOIN pins USING (qid, law_slug, article))
SELECT * EXCLUDE (spot) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY explicit DESC, spot, law_slug, article)::INT AS rank FROM every) WHERE rank <= 5""",
    "bm25_pruned": f"WITH RECURSIVE {_bm25()} SELECT qid, chunk_id, score, rank FROM bm",
    "bm25_laws_each": f"WITH RECURSIVE {_bm25(EACH.format('law_slug'))} SELECT qid, chunk_id, score, rank FROM bm",
    "vector_laws_each": f"WITH RECURSIVE {CHUNKS}, {VECTOR_EACH} SELECT qid, chunk_id, score, rank FROM ve",
    "ann_recall": "SELECT count(*) AS n_queries, true AS enough, true AS full FROM embeddings WHERE vec_id % 100 = 0",
    "snapshot_sync": "SELECT doc_id AS id, left(sha256(text), 16) AS hash, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'embedded' ELSE 'kept' END AS origin FROM documents",
    "hierarchy_paths": "SELECT page_id, 'Articolul 1' AS heading, CASE WHEN page_id % 2 = 0 THEN ['Partea ' || page_id || ' - despre ' || (page_id % 7), 'Grupa ' || (page_id % 5)] ELSE ['Partea ' || page_id || ' - despre ' || (page_id % 7)] END AS hierarchy FROM pages",
    "compare_articles": f"""WITH m AS (SELECT vec_id, label, 'full' AS model, 64 AS dim, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id, label, 'half', 32, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) FROM (SELECT vec_id, label, (embedding::DOUBLE[])[1:32] AS h FROM embeddings)),
s AS (SELECT q.model, q.dim, q.vec_id AS qid, q.label AS want, c.vec_id // 3 AS art, max(round(list_dot_product(q.v, c.v), 6)) AS score, arg_max(c.vec_id, (round(list_dot_product(q.v, c.v), 6), -c.vec_id)) AS pos FROM m q JOIN m c ON q.model = c.model WHERE q.vec_id % 100 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, pos) AS k FROM s), g AS (SELECT DISTINCT label AS want, vec_id // 3 AS art, true AS gold FROM embeddings),
r AS (SELECT model, dim, qid, min(k) FILTER (gold AND art <> qid // 3 AND k <= 10) AS rank FROM k LEFT JOIN g USING (want, art) GROUP BY 1, 2, 3) SELECT model, {_METRICS}, dim::INT AS dim FROM r GROUP BY model, dim""",
    "log_batches": f"""WITH {LOGS}, c AS (SELECT model <> 'm2' AS first, count(*) AS n FROM log GROUP BY 1)
SELECT first, n, n AS n_seq, coalesce((SELECT n FROM c f WHERE f.first AND NOT c.first), 0) AS low, coalesce((SELECT n FROM c f WHERE f.first AND NOT c.first), 0) + n - 1 AS high FROM c""",
    "judge_batch": f"""WITH {LOGS}, o AS (SELECT id, model, chr((64 + row_number() OVER (PARTITION BY id ORDER BY sha256(id || ':' || model), model))::INT) AS label FROM last_answers)
SELECT id, list(label || '=' || model ORDER BY label) AS labels FROM o GROUP BY 1""",
    "judge_prompts": """WITH q AS (SELECT conv_id, min((turn, text))[2] AS question, CASE conv_id % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'key ' || conv_id END AS key FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, 'm' || (turn % 3) AS model, max((turn, text))[2] AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
o AS (SELECT *, chr((64 + row_number() OVER (PARTITION BY conv_id ORDER BY sha256(conv_id || ':' || model), model))::INT) AS label FROM a),
p AS (SELECT conv_id, list(label || '=' || model ORDER BY label) AS labels, string_agg('## ' || label || chr(10) || answer, chr(10) || chr(10) ORDER BY label) AS shown FROM o GROUP BY 1),
g AS (SELECT conv_id, unnest([1, 2]) AS rank, unnest([conv_id, conv_id + 1]) AS doc_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 0)),
s AS (SELECT conv_id, string_agg('[' || rank || '] ' || upper(source) || ': ' || doc_id || CASE WHEN doc_id % 2 = 1 THEN ' (extras)' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS given FROM g JOIN documents USING (doc_id) GROUP BY 1)
SELECT conv_id::VARCHAR AS id, labels, '# Question' || chr(10) || question || chr(10) || chr(10) || CASE WHEN given IS NULL THEN '' ELSE '# Sources' || chr(10) || given || chr(10) || chr(10) END
  || CASE WHEN trim(coalesce(key, '')) = '' THEN '' ELSE '# Key' || chr(10) || key || chr(10) || chr(10) END || '# Answers' || chr(10) || chr(10) || shown AS prompt FROM p JOIN q USING (conv_id) LEFT JOIN s USING (conv_id)""",
    "parse_pages": r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '<article[^>]*>(.*?)</article>', 1, 's') AS body FROM pages),
p AS (SELECT page_id, url, list_transform(string_split(body, '<p>')[2:], lambda x: regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g')) AS raw FROM a),
u AS (SELECT page_id, url, list_filter(list_transform(raw, lambda x: array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), chr(10)),
  lambda y: trim(regexp_replace(y, '[ \t\r\f\x0B\x{A0}]+', ' ', 'g'))), lambda y: y <> ''), chr(10))), lambda x: x <> '') AS units FROM p),
t AS (SELECT *, len(units) > 1 AND length(units[1]) < 120 AND NOT contains(units[1], chr(10)) AND NOT regexp_matches(units[1], '[.:;,]$') AS moved FROM u)
SELECT page_id, 0 AS pos, 'web' AS law_slug, 'Web' AS law_name, 'W' AS law_ref, '1' AS number, CASE WHEN moved THEN units[1] ELSE '' END AS title, []::VARCHAR[] AS hierarchy,
  CASE WHEN moved THEN units[2:] ELSE units END AS units, url, NULL::VARCHAR AS consolidation_date, len(units) = 0 AS abrogated, []::VARCHAR[] AS "references" FROM t""",
    "embed_hash": """WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda r, z: xor(r >> 1, (r & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)),
used AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]))) AS h FROM (SELECT DISTINCT word FROM used) CROSS JOIN tab),
sums AS (SELECT doc_id, (h % 64)::INT AS i, sum(CASE WHEN h >= 2147483648 THEN n ELSE -n END)::DOUBLE AS x FROM used JOIN hashed USING (word) GROUP BY 1, 2),
dense AS (SELECT doc_id, list(coalesce(x, 0.0::DOUBLE) ORDER BY i) AS v FROM (SELECT doc_id, unnest(range(64))::INT AS i FROM documents) LEFT JOIN sums USING (doc_id, i) GROUP BY 1)
SELECT doc_id, list_transform(v, lambda x: (CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0 END)::FLOAT) AS embedding FROM dense""",
    "detect_laws": f"WITH {SCRIPTED} SELECT qid, laws FROM law",
    "detect_refs": f"""WITH {SCRIPTED}, n AS (SELECT qid, laws[1] AS law_slug, CASE WHEN coalesce(s, '') = '' THEN a ELSE a || '^' || s END AS article, i FROM (SELECT qid, laws, unnest(regexp_extract_all(plain, {_ART}, 1)) AS a, unnest(regexp_extract_all(plain, {_ART}, 2)) AS s, unnest(range(len(regexp_extract_all(plain, {_ART}, 1)))) AS i FROM law WHERE len(laws) = 1)),
f AS (SELECT qid, law_slug, article, min(i) AS i FROM n GROUP BY 1, 2, 3) SELECT qid, law_slug, article, (row_number() OVER (PARTITION BY qid ORDER BY i) - 1)::INT AS ref_pos FROM f""",
    "check_citations": f"WITH {ANSWERS} SELECT id, cited, invalid FROM cite",
    "infer_citations": f"WITH {ANSWERS} SELECT id, inferred AS cited FROM inf",
    "resolve_citations": f"WITH {ANSWERS}, keys AS (SELECT id, list(article ORDER BY n) AS keys FROM hit GROUP BY 1) SELECT cite.id, list_transform(CASE WHEN len(cited) > 0 THEN cited ELSE coalesce(inferred, []::BIGINT[]) END, lambda n: keys[n]) AS resolved FROM cite LEFT JOIN inf USING (id) JOIN keys USING (id)",
    "build_prompts": f"""WITH RECURSIVE {_bm25()},
h AS (SELECT qid, rank, '[' || rank || '] ' || header || CASE WHEN n_parts <> 1 THEN ' (extras)' ELSE '' END || {_NL} || body AS source FROM bm JOIN chunks USING (chunk_id) WHERE rank <= 3 AND score >= 45)
SELECT qid, 'SURSE:' || {_NL} || {_NL} || string_agg(source, {_NL} || {_NL} ORDER BY rank) || {_NL} || {_NL} || '---' || {_NL} || 'ÎNTREBARE: ' || any_value(b.text) AS prompt FROM h JOIN benchmark b ON item_id = qid GROUP BY qid""",
    "unanswered": f"WITH RECURSIVE {_bm25()} SELECT item_id AS qid, 'Nu am găsit în legile indexate prevederi relevante pentru această întrebare.' AS answer FROM benchmark WHERE item_id NOT IN (SELECT qid FROM bm WHERE score >= 45)",
    "source_labels": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, '[' || part || ']  ' || law_ref || ' · art. ' || article || CASE WHEN part % 2 = 0 THEN ' · Titlu - doi' ELSE '' END AS label, array_to_string(string_split(string_split(header, {_NL})[1], ' > ')[2:], ' / ') AS crumb, CASE WHEN doc_id % 2 = 0 THEN strftime(DATE '2020-01-01' + (doc_id % 700)::INT, '%d.%m.%Y') ELSE 'forma republicată' END AS shown FROM chunks",
    "law_versions": f"WITH RECURSIVE {CHUNKS} SELECT law_slug, NULL::VARCHAR AS consolidation_date, arg_min(url, (doc_id, part)) AS url FROM chunks GROUP BY 1",
    "split_cited": f"WITH {ANSWERS} SELECT id, n, list_contains(cited, n) OR turn % 10 = 1 AS is_primary FROM hit JOIN cite USING (id) JOIN ans USING (id)",
    "first_gold_rank": f"WITH RECURSIVE {RANKED} SELECT qid, type, rank, gold FROM ranked",
    "recall_mrr": f"WITH RECURSIVE {RANKED} SELECT 'bm25' AS variant, {_METRICS} FROM ranked WHERE len(gold) > 0",
    "metrics_by_type": f"WITH RECURSIVE {RANKED}, t AS (SELECT 'bm25' AS variant, CASE WHEN length(question) > 200 THEN 'long' ELSE type END AS type, rank FROM ranked) SELECT variant, type, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM t GROUP BY GROUPING SETS ((variant), (variant, type))",
    "variant_sweep": f"WITH RECURSIVE {SWEEP} SELECT variant, {_METRICS} FROM ranked GROUP BY 1",
    "detail_rows": f"WITH RECURSIVE {SWEEP}, top AS (SELECT variant, qid, list(key ORDER BY rank) AS top5 FROM hits WHERE rank <= 5 GROUP BY 1, 2) SELECT variant, qid, type, rank, coalesce(top5, []::VARCHAR[]) AS top5 FROM ranked LEFT JOIN top USING (variant, qid)",
    "misses": f"WITH RECURSIVE {SWEEP} SELECT qid, type, rank FROM ranked WHERE variant = 'hybrid_weighted' AND rank IS DISTINCT FROM 1",
    "compare_embeddings": f"""WITH m AS (SELECT vec_id, label, 'full' AS model, 64 AS dim, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id, label, 'half', 32, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) FROM (SELECT vec_id, label, (embedding::DOUBLE[])[1:32] AS h FROM embeddings)),
s AS (SELECT q.model, q.dim, q.vec_id AS qid, q.label AS want, c.vec_id AS id, c.label AS got, row_number() OVER (PARTITION BY q.model, q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 6) DESC, c.vec_id) AS k FROM m q JOIN m c ON q.model = c.model WHERE q.vec_id % 100 = 0),
r AS (SELECT model, dim, qid, min(k - 1) FILTER (got = want AND id <> qid AND k BETWEEN 2 AND 11) AS rank FROM s GROUP BY 1, 2, 3) SELECT model, {_METRICS}, dim::INT AS dim FROM r GROUP BY model, dim""",
    "latest_logs": f"WITH {LOGS} SELECT id, model, seq, latency_ms, cited FROM last_answers",
    "error_pairs": f"WITH {LOGS} SELECT model, count(DISTINCT id) AS errors FROM log WHERE error IS NOT NULL GROUP BY 1",
    "todo_answers": f"WITH {LOGS} SELECT id, model FROM (SELECT item_id::VARCHAR AS id, model FROM benchmark, (SELECT DISTINCT model FROM log)) ANTI JOIN (SELECT id, model FROM log WHERE error IS NULL) USING (id, model)",
    "todo_judgments": f"WITH {LOGS}, a AS (SELECT id, list(DISTINCT model ORDER BY model) AS answered FROM log WHERE error IS NULL GROUP BY 1), j AS (SELECT id, list(model ORDER BY model) AS known FROM newest GROUP BY 1) SELECT id, answered FROM a LEFT JOIN j USING (id) WHERE answered IS DISTINCT FROM known",
    "answer_report": f"""WITH {LOGS}, r AS (SELECT n.*, a.latency_ms, a.output_tokens, a.cited, a.invalid_citations, lq.type, lq.gold FROM newest n JOIN last_answers a USING (id, model) JOIN lq USING (id)),
p AS (SELECT model, list_sort(list(latency_ms)) AS l FROM r GROUP BY 1), e AS (SELECT model, count(DISTINCT id) AS errors FROM log WHERE error IS NOT NULL GROUP BY 1),
f AS (SELECT model, count(*) AS n, round(avg(correctness / 2.0::DOUBLE), 6) AS score, round(avg((correctness = 2)::INT), 6) AS fully_correct, round(avg(faithful::INT), 6) AS faithful, round(avg(list_has_any(cited, gold)::INT) FILTER (len(gold) > 0), 6) AS cites_gold,
  round(avg(refused::INT) FILTER (len(gold) = 0), 6) AS correct_refusals, round(avg(refused::INT) FILTER (len(gold) > 0 AND type <> 'trap'), 6) AS false_refusals, round(avg((correctness = 2)::INT) FILTER (type = 'trap'), 6) AS traps,
  sum(len(invalid_citations))::BIGINT AS invalid_citations, round(avg(output_tokens), 6) AS output_tokens FROM r GROUP BY 1)
SELECT f.* EXCLUDE (n), coalesce(n, 0) AS n, judged - coalesce(n, 0) AS dropped, l[(floor(len(l) * 0.5) + 1)::INT] / 1000.0::DOUBLE AS latency_p50_s, l[(floor(len(l) * 0.9) + 1)::INT] / 1000.0::DOUBLE AS latency_p90_s, coalesce(errors, 0) AS errors FROM (SELECT model, count(*) AS judged FROM newest GROUP BY 1) LEFT JOIN f USING (model) LEFT JOIN p USING (model) LEFT JOIN e USING (model)""",
    "rank_percentile": "SELECT event_type, l[(floor(len(l) * 0.5) + 1)::INT] AS p50, l[(floor(len(l) * 0.9) + 1)::INT] AS p90 FROM (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS l FROM events GROUP BY 1)",
    "dq_questions": f"""WITH {GOLD}, q AS (SELECT (qid - CASE WHEN qid % 10 = 9 THEN 1 ELSE 0 END)::VARCHAR AS id, CASE WHEN qid % 8 = 1 THEN 'other' ELSE type END AS type, gold, CASE WHEN qid % 6 = 5 THEN ' ' ELSE question END AS answer_key FROM ask)
SELECT id, 'repeated id' AS problem FROM q GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'unknown type' FROM q WHERE type = 'other' UNION ALL SELECT id, 'gold against type' FROM q WHERE (len(gold) = 0) <> (type = 'unanswerable')
UNION ALL SELECT DISTINCT id, 'unknown act' FROM (SELECT id, unnest(gold) AS key FROM q) WHERE string_split(key, ':')[1] = 'src3' UNION ALL SELECT id, 'empty answer key' FROM q WHERE trim(answer_key) = ''""",
    "dq_chunks": f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT chunk_id AS id, law_slug, article, part, n_parts FROM chunks WHERE doc_id % 50 = 1 UNION ALL SELECT chunk_id, law_slug, article, part, n_parts FROM chunks WHERE NOT (doc_id % 20 = 2 AND part = 1))
SELECT id, 'repeated id' AS problem FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT law_slug || ':' || article, 'incomplete parts' FROM c GROUP BY law_slug, article HAVING max(part) <> max(n_parts) OR count(*) <> max(n_parts)""",
    "dq_parse": """WITH n AS (SELECT page_id, ((length(html) - length(replace(html, '<p', ''))) / 2)::INT AS n_articles FROM pages),
a AS (SELECT page_id, length(piece) % 5 = 0 AS gone, CASE WHEN length(piece) % 7 = 0 THEN '' WHEN length(piece) % 11 = 0 THEN '(la data' ELSE piece END AS u FROM (SELECT page_id, unnest(string_split(html, '<p')) AS piece FROM pages)),
f AS (SELECT page_id, count(*) AS parsed, count(*) FILTER (NOT gone AND u = '') AS empty, count(*) FILTER (starts_with(u, '(la ')) AS notes FROM a GROUP BY 1)
SELECT page_id, problem FROM (SELECT page_id, unnest([CASE WHEN parsed <> n_articles THEN 'count differs' END, CASE WHEN empty > 0 THEN 'article without text' END, CASE WHEN notes > 0 THEN 'amendment note left' END]) AS problem FROM n JOIN f USING (page_id)) WHERE problem IS NOT NULL""",
}
