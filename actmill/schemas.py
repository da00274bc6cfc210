"""Explicit schemas of all records, as DDL; files are never read with inference."""

from __future__ import annotations

PAGE_META = "slug STRING, name STRING, short_ref STRING, doc_id BIGINT, url STRING, consolidation_date DATE, downloaded_at TIMESTAMP, n_articles INT"
ARTICLE = (
    "law_slug STRING, law_name STRING, law_ref STRING, number STRING, title STRING, hierarchy ARRAY<STRING>, units ARRAY<STRING>, "
    "url STRING, consolidation_date STRING, abrogated BOOLEAN, references ARRAY<STRING>"
)
CHUNK = "id STRING, law_slug STRING, law_ref STRING, article STRING, part INT, n_parts INT, header STRING, body STRING, url STRING, consolidation_date STRING"
VECTOR = "id STRING, embedding ARRAY<FLOAT>, text STRING, law_slug STRING, law_ref STRING, article STRING, part INT, hash STRING"
QUESTION = "id STRING, type STRING, question STRING, gold ARRAY<STRING>, answer_key STRING"
ANSWER_LOG = (
    "id STRING, model STRING, text STRING, latency_ms BIGINT, input_tokens BIGINT, output_tokens BIGINT, cited ARRAY<STRING>, invalid_citations ARRAY<INT>, error STRING, seq BIGINT"
)
SCORE = "STRUCT<label: STRING, correctness: INT, faithful: BOOLEAN, refused: BOOLEAN, comment: STRING>"
JUDGMENT_LOG = f"id STRING, labels MAP<STRING, STRING>, scores MAP<STRING, {SCORE}>, seq BIGINT"
QUESTION_TYPES = ("natural", "informal", "explicit_ref", "trap", "unanswerable")
