"""DuckDB SQL that states the rows of the manifest and of the shards."""

from __future__ import annotations

from actmill.llm.sharding import FIRST, SECOND, SEED, SHARDS, round_keys

OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(':' || source, '-') AS g, doc_id IS NOT NULL AS known,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS cut, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM documents),
-- CRC-32 of the digits, bit by bit
c AS (SELECT *, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) AS crc FROM f),
leaves AS (SELECT id, doc_id, g, known, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || CASE WHEN crc % 2 = 0 THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS found FROM c),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY known, doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS held FROM leaves),
t AS (
  SELECT 0 AS depth, g, place, held, leaf AS digest FROM placed
  UNION ALL SELECT depth + 1, g, place // 3, (held + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE held > 1 GROUP BY depth, g, place // 3, held),
subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS held FROM t WHERE held = 1),
u AS (
  SELECT 0 AS depth, place, held, subroot AS digest FROM subs
  UNION ALL SELECT depth + 1, place // 3, (held + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE held > 1 GROUP BY depth, place // 3, held),
sides AS (
  SELECT 0 AS tree, g, depth, place, place // 3 AS parent, digest FROM t WHERE held > 1
  UNION ALL SELECT 1, '', depth, place, place // 3, digest FROM u WHERE held > 1),
beside AS (
  SELECT a.tree, a.g, a.depth, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM sides a JOIN sides b USING (tree, g, depth, parent) GROUP BY ALL),
w AS (
  SELECT id, 0 AS tree, g, 0 AS depth, place, '' AS proof, found AS fold FROM placed
  UNION ALL SELECT w.id, w.tree, w.g, w.depth + 1, w.place // 3, proof || l || r, sha256(l || fold || r) FROM w JOIN beside USING (tree, g, depth, place)),
-- at its group's root each row goes on as the group's place among the groups
mid AS (SELECT w.id, subs.place, proof, fold FROM (SELECT id, arg_max(g, depth) AS g, arg_max(proof, depth) AS proof, arg_max(fold, depth) AS fold FROM w GROUP BY id) w JOIN subs USING (g)),
v AS (
  SELECT id, 1 AS tree, '' AS g, 0 AS depth, place, proof, fold FROM mid
  UNION ALL SELECT v.id, v.tree, v.g, v.depth + 1, v.place // 3, proof || l || r, sha256(l || fold || r) FROM v JOIN beside USING (tree, g, depth, place)),
ends AS (SELECT id, arg_max(proof, depth) AS proof, arg_max(fold, depth) AS fold FROM v GROUP BY id)
SELECT p.doc_id, p.leaf, s.subroot, u.digest AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = u.digest AS verified
FROM placed p JOIN subs s USING (g) JOIN ends e USING (id) CROSS JOIN (SELECT digest FROM u WHERE held = 1) u
"""


def op12_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    low = 4294967295
    network = "s"
    for key in round_keys(seed):
        # a one-element list stands for a value that the next expression names
        x = f"[(s.r + {key}) & {low}]"
        x = f"list_transform({x}, lambda x: (x * {FIRST}::UBIGINT) & {low})"
        x = f"list_transform({x}, lambda x: (xor(x, x >> 15) * {SECOND}::UBIGINT) & {low})"
        x = f"list_transform({x}, lambda x: xor(x, x >> 13) & ((1::UBIGINT << h) - 1))[1]"
        network = f"list_transform([{network}], lambda s: struct_pack(l := s.r, r := xor(s.l, {x})))[1]"
    return f"""
WITH RECURSIVE entries AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda r, z: xor(r >> 1, (r & 1) * 3988292384)) AS e FROM range(256) r(i)),
crc AS (SELECT list(e ORDER BY i) AS t FROM entries),
d AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(text) NULLS FIRST) - 1 AS row_number, count(*) OVER () AS n FROM documents),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM d),
c AS (SELECT b.* EXCLUDE (text, bytes), xor({low}, list_reduce(list_concat([{low}::UBIGINT], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]))) AS text_crc32 FROM b CROSS JOIN crc),
-- half of the fewest bits, an even number, that hold n numbers
bits AS (SELECT min(i) AS h FROM range(1, 33) r(i) WHERE (1::HUGEINT << (2 * i)::INT) >= (SELECT count(*) FROM documents)),
walk AS (
  SELECT row_number, n, h::UBIGINT AS h, 0 AS step, row_number::UBIGINT AS x FROM d CROSS JOIN bits
  UNION ALL SELECT row_number, n, h, step + 1, (p.l << h) | p.r FROM (SELECT *, list_transform([struct_pack(l := x >> h, r := x & ((1::UBIGINT << h) - 1))], lambda s: {network})[1] AS p FROM walk WHERE step = 0 OR x >= n)),
walked AS (SELECT row_number, arg_max(x, step)::BIGINT AS position FROM walk GROUP BY 1)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position % {shards})::INT AS shard, position // {shards} AS slot, NULL::INT AS grown_shard, row_number, position FROM c JOIN walked USING (row_number)
"""
