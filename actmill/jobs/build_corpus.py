"""Stored pages to articles, chunks and an updated vector table.

python -m actmill.jobs.build_corpus --html 'pages/*.html' --meta 'pages/*.json' --out corpus [--vectors vectors] [--postings]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill import schemas
from actmill.functions import html
from actmill.operators import chunking, ingest, lexical, models, postings, quality, sync
from actmill.operators.snapshot import Snapshot
from actmill.sources import tables


def build(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, chunks, quarantine) of pages(page_id, html and the columns of PAGE_META). Pages are dealt evenly first.

    In quarantine are pages without metadata, without articles or that cannot be read, and articles with a problem.
    """
    unknown = F.coalesce("name", "short_ref", "url").isNull()
    good, empty = ingest.reject_empty(pages.filter(~unknown))
    unnamed = pages.filter(unknown).select("page_id", F.lit("no metadata").alias("problem"))
    dealt = good.repartition("page_id")
    articles, broken = ingest.clean_articles(html.raw_articles(dealt), good.drop("html", "n_articles"))
    rows = chunking.chunk_articles(articles.drop("page_id", "pos"))
    quarantine = broken.select("page_id", "problem").unionByName(empty.select("page_id", F.lit("no articles").alias("problem"))).unionByName(unnamed)
    return articles, rows, quarantine


def wanted_vectors(chunks: DataFrame) -> DataFrame:
    text = chunking.chunk_text()
    return chunks.select("id", text.alias("text"), "law_slug", "law_ref", "article", "part", chunking.content_hash(text).alias("hash"))


def embedder(encoder: models.Encoder) -> Callable[[DataFrame], DataFrame]:
    return lambda todo: todo.withColumn("embedding", sync.embed_column(encoder, F.col("text")))


def next_vectors(existing: DataFrame, chunks: DataFrame, encoder: models.Encoder) -> DataFrame:
    return sync.apply_sync(existing, wanted_vectors(chunks), embedder(encoder))


def main() -> None:
    a = argparse.ArgumentParser()
    for name in ("--html", "--meta", "--out"):
        a.add_argument(name, required=True)
    a.add_argument("--vectors", help="the vector table, a snapshot of buckets that is brought in step; made where it is missing")
    a.add_argument("--postings", action="store_true", help="store the chunks' postings by stems too")
    args = a.parse_args()
    spark = SparkSession.builder.appName("build corpus").getOrCreate()
    pages = tables.read_pages(spark, args.html, args.meta).drop("n_articles").withColumn("page_id", F.xxhash64("slug"))
    articles, chunks, quarantine = build(pages)
    tables.write_records(articles, f"{args.out}/articles", by="law_slug")
    tables.write_records(chunks, f"{args.out}/chunks")
    tables.write_records(quarantine, f"{args.out}/quarantine")
    written = spark.read.parquet(f"{args.out}/articles")
    counted = pages.select("page_id", ingest.count_marks(F.col("html")).alias("n_articles"))
    tables.write_records(quality.check_parse(written, counted), f"{args.out}/problems_parse")
    tables.write_records(quality.check_chunks(spark.read.parquet(f"{args.out}/chunks")), f"{args.out}/problems_chunks")
    if args.vectors:
        Snapshot(spark, args.vectors, schemas.VECTOR).sync(wanted_vectors(spark.read.parquet(f"{args.out}/chunks")), embedder(models.hashing_encoder()))
    if args.postings:
        index = lexical.token_index(chunking.searchable(spark.read.parquet(f"{args.out}/chunks")), stems=True)
        postings.postings(index).write(f"{args.out}/postings")


if __name__ == "__main__":
    main()
