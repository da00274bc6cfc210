"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from actmill.llm.alignment import token_alignment
from actmill.llm.bpe import with_tokens
from actmill.llm.decontam import contained_items
from actmill.llm.langid import predicted_languages
from actmill.llm.linededup import lines_deduplicated
from actmill.llm.merkle import tampering_report
from actmill.llm.multiset import edited_neighbours
from actmill.llm.omh import near_duplicate_classes
from actmill.llm.quality import quality_scores
from actmill.llm.sharding import document_shards
from actmill.llm.sql import OP11_SQL, op12_sql
from actmill.llm.sufdedup import repeated_strings_removed
from actmill.llm.surrogate import pseudonymised
from actmill.llm.toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("row_key", "keeps")


def op7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings_removed(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op4_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH l AS MATERIALIZED (SELECT doc_id, a, list_transform(a, lambda x: len(regexp_extract_all(x, '[^ \t\r\f\v]+'))) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
w AS (
  SELECT doc_id, i, 3 AS n, a[i] || chr(10) || a[i + 1] || chr(10) || a[i + 2] AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM l)
  UNION ALL SELECT doc_id, i, 2, a[i] || chr(10) || a[i + 1] FROM (SELECT doc_id, a, c, unnest(range(1, len(a))) AS i FROM l) WHERE c[i] < 50 AND c[i + 1] < 50 AND c[i] + c[i + 1] >= 50
  UNION ALL SELECT doc_id, i, 1, a[i] FROM (SELECT doc_id, a, c, unnest(range(1, len(a) + 1)) AS i FROM l) WHERE c[i] >= 50),
later AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later),
rows AS (SELECT doc_id, i, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM rows ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY 1)
SELECT l.doc_id, coalesce(kept.text, '') AS text, len(a) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of the session's configuration; a session without one gets a key that no one knows.
    key = spark.conf.get("actmill.surrogate.key", None) or secrets.token_hex(32)
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM dw)),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM iw)),
need AS (SELECT item_id, ceil(0.8 * count(*) - 1e-9) AS least FROM ish GROUP BY 1),
hit AS (SELECT doc_id, item_id FROM dsh JOIN ish USING (s) JOIN need USING (item_id) GROUP BY doc_id, item_id, least HAVING count(*) >= least),
per AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(item_ids, []::BIGINT[]) AS item_ids, item_ids IS NOT NULL AS contaminated
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampering_report(table(spark, sf_dir, "documents"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op13_token_alignment": op13_token_alignment,
    "op12_feistel_shards": op12_feistel_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op9_transducer_bpe": op9_transducer_bpe,
    "op3_surrogates": op3_surrogates,
    "op8_line_winnowing": op8_line_winnowing,
    "op4_boosted_trees": op4_boosted_trees,
    "op5_subword_softmax": op5_subword_softmax,
    "op6_kneser_ney": op6_kneser_ney,
    "op10_interval_expansion": op10_interval_expansion,
    "op7_containment": op7_containment,
    "op1_order_minhash": op1_order_minhash,
    "op2_multiset_hash": op2_multiset_hash,
}
ORACLE_SQL: dict[str, str] = {
    "op7_containment": OP7_SQL,
    "op8_line_winnowing": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_feistel_shards": op12_sql(),
}
