"""Ranked articles and prompts for a table of questions.

python -m actmill.jobs.answer_batch --chunks corpus/chunks --questions questions.jsonl --out ranked [--vectors corpus/vectors] [--postings corpus/postings] [--laws a,b]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill import schemas
from actmill.functions import citations, refs, text
from actmill.operators import chunking, evaluation, fusion, lexical, models, postings, sync, vectors
from actmill.operators.snapshot import Snapshot
from actmill.sources import tables


def ranked(questions: DataFrame, chunks: DataFrame, laws: list[str] | None = None, k: int = 5, vectors_of: DataFrame | None = None, encoder: models.Encoder | None = None, found: postings.Postings | None = None) -> DataFrame:
    """Hits of questions(qid, question) over chunks(chunk_id, chunk_pos, text and the columns of CHUNK), by stems.

    vectors_of(id, embedding) are the vectors that encoder made of the chunks; without them ranks come from words alone.
    found are the chunks' postings by stems, if they are stored: then no text is read for BM25, and the rows are the same.
    """
    named = questions.select("qid", text.strip_diacritics(F.lower("question")).alias("plain"))
    if found is None:
        bm25 = lexical.bm25_search(questions, lexical.token_index(chunks, stems=True), laws=laws, stems=True)
    else:
        bm25 = postings.pruned_search(questions, found, laws=laws, stems=True)
    near = None
    if vectors_of is not None and encoder is not None:
        limit = [c for c in ("laws",) if c in questions.columns]
        asked = questions.select("qid", *limit, sync.embed_column(encoder, F.col("question")).alias("vector"))
        corpus = vectors_of.select("id", F.col("embedding").alias("vector")).join(chunks.select(F.col("chunk_id").alias("id"), F.col("chunk_id").alias("pos"), "law_slug"), "id")
        near = vectors.vector_search(asked, corpus, laws=laws).withColumnRenamed("id", "chunk_id")
    config = fusion.SearchConfig(use_vector=near is not None)
    return fusion.hybrid_search(questions, chunks, bm25, near, refs.detect_article_refs(named, "plain"), config, models.overlap_scorer, k, laws)


def prompts(questions: DataFrame, chunks: DataFrame, hits: DataFrame) -> DataFrame:
    parts = hits.select("qid", "rank", "law_slug", "article", F.explode("parts").alias("part")).join(chunks.select("law_slug", "article", "part", "n_parts", "header", "body"), ["law_slug", "article", "part"])
    sources = parts.groupBy("qid", "rank").agg(F.min_by("header", "part").alias("header"), F.max("n_parts").alias("n_parts"), F.array_sort(F.collect_list(F.struct("part", "body"))).alias("b"))
    return citations.build_prompts(questions, sources.select("qid", "rank", "header", "n_parts", F.col("b.body").alias("bodies")))


def main() -> None:
    a = argparse.ArgumentParser()
    for name in ("--chunks", "--questions", "--out"):
        a.add_argument(name, required=True)
    a.add_argument("--laws", default="")
    a.add_argument("--vectors", default="")
    a.add_argument("--postings", default="")
    args = a.parse_args()
    spark = SparkSession.builder.appName("answer batch").getOrCreate()
    asked = tables.read_records(spark, args.questions, schemas.QUESTION).withColumnRenamed("id", "qid")
    rows = spark.read.parquet(args.chunks)
    chunks = chunking.searchable(rows)
    made = Snapshot(spark, args.vectors, schemas.VECTOR).read() if args.vectors else None
    found = postings.read_postings(spark, args.postings) if args.postings else None
    hits = ranked(asked, chunks, [x for x in args.laws.split(",") if x] or None, 10, made, models.hashing_encoder(), found)
    tables.write_records(hits, f"{args.out}/hits")
    done = spark.read.parquet(f"{args.out}/hits")
    tables.write_records(prompts(asked, chunks, done.filter("rank <= 5")), f"{args.out}/prompts")
    tables.write_records(citations.unanswered(asked, done), f"{args.out}/unanswered")
    variant = "hybrid_rerank_refs" if made is not None else "bm25_rerank_refs"
    keyed = done.select("qid", "rank", F.concat_ws(":", "law_slug", "article").alias("key")).withColumn("variant", F.lit(variant))
    measured = evaluation.first_gold_rank(asked.filter(F.size("gold") > 0).withColumn("variant", F.lit(variant)), keyed, ["variant", "qid"])
    tables.write_metrics(evaluation.metrics(measured, ["variant"]), evaluation.detail_rows(measured, keyed), f"{args.out}/metrics")


if __name__ == "__main__":
    main()
