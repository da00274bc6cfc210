"""A training-data pipeline over documents: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes what its predecessor kept, as written to Parquet, and all but the last return the columns of documents.
Null and empty texts: the first stage rejects texts without a letter, so later ones have none but what line deletion
empties; a document emptied by it is dropped there. Repeated rows are near duplicates of each other. Columns besides
doc_id, text and n_chars pass through; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed
from actmill.llm.bpe import with_tokens
from actmill.llm.decontam import with_items
from actmill.llm.langid import fit, fold, with_language
from actmill.llm.linededup import lines_deduplicated
from actmill.llm.omh import near_duplicate_classes
from actmill.llm.ordering import apart
from actmill.llm.registry import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the models learn from the rows whose fold of 4 is not 2."""
    model = fit(docs.filter(fold(4) != 2).select("text", "lang"))
    return with_language(docs, model).filter("not rejected").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so do documents of which nothing is left."""
    short = lines_deduplicated(docs).filter("n_deleted = 0 or text <> ''")
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return short.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of smallest doc_id; of rows equal in doc_id and text, one."""
    key = apart(docs, "row_key")
    kept = near_duplicate_classes(docs.select("doc_id", "text")).filter("keeps").select(F.col("row_key").alias(key))
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return with_items(docs, table(spark, sf_dir, "benchmark")).filter(F.size("item_ids") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document, and its decoded text."""
    return with_tokens(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", languages),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("tokens", tokens),
]
#: No SQL states the language models or the alignment; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
