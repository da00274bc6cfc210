"""Findings of round 4, each by a case that failed before."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from actmill.operators import ann, chunking, ingest, lexical, sync, vectors
from actmill.operators.storage import shared_folder


def test_articles_without_units_have_no_marginal_title(spark):
    rows = [(1, "", []), (2, "", None), (3, "", ["Scurt", "Text."]), (4, "", [None, "b"])]
    got = ingest.marginal_title(spark.createDataFrame(rows, "id long, title string, units array<string>")).orderBy("id").collect()
    assert [(r.title, r.units) for r in got] == [("", []), ("", None), ("Scurt", ["Text."]), ("", [None, "b"])]


def _bytes(spark):
    return sum(f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())


def chunks(spark, n, words=40):
    text = F.concat(F.lit("pana "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), (F.col("id") * i % 500).cast("string"))), " "))
    return spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").alias("chunk_pos"), F.lit("x").alias("law_slug"), F.col("id").cast("string").alias("article"), F.lit(1).alias("part"), text.alias("text"))


def test_an_index_takes_less_room_than_its_texts(spark):
    rows = chunks(spark, 4000)
    size, before = rows.agg(F.sum(F.octet_length("text"))).first()[0], _bytes(spark)
    index = lexical.token_index(rows, carry=("article", "part"))
    assert index.columns == ["chunk_id", "chunk_pos", "law_slug", "article", "part", "tokens"] and index.count() == 4000
    assert _bytes(spark) - before < size


def test_bm25_shuffles_no_row_for_each_pair_of_question_and_chunk(spark):
    index = lexical.token_index(chunks(spark, 5000))
    asked = spark.createDataFrame([(i, f"w{i} w{i + 7} pana") for i in range(40)], "qid long, question string")
    found = lexical.bm25_search(asked, index, 3)
    assert "chunk_id" not in "".join(x.split(", ENSURE")[0] for x in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:])
    assert found.groupBy("qid").count().filter("count <> 3").count() == 0 and found.count() == 120


def test_bm25_over_many_blocks_equals_one_block(spark, monkeypatch):
    index = lexical.token_index(chunks(spark, 700))
    asked = spark.createDataFrame([(i, f"w{i} w{i + 7} w{i} pana", ["x"] if i % 2 else None) for i in range(30)], "qid long, question string, laws array<string>")
    want = sorted(map(tuple, lexical.bm25_search(asked, index, 5).collect()))
    for name, value in (("BLOCK_CHUNKS", 64), ("BLOCK_QUESTIONS", 7), ("PAIRS", 50)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.bm25_search(asked, index, 5).collect())) == want and len(want) == 150


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-1e-9, 1e-9, -0.0, -0.1234565, 0.25]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(sync.rounded(F.col("v"), 6).alias("x")).collect()]
    assert got == [0, 0, 0, -0.123457, 0.25] and [math.copysign(1, x) for x in got] == [-1, 1, -1, -1, 1]


def test_index_finds_nine_tenths_of_vectors_without_clusters(spark):
    v = np.random.default_rng(3).normal(size=(12_000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(v)], "id long, pos long, vector array<double>")
    asked = corpus.filter("id % 200 = 0").select(F.col("id").alias("qid"), "vector")
    told = ann.recall(ann.search(asked, corpus, ann.build(corpus)), vectors.vector_search(asked, corpus, 10)).agg(F.sum("hit"), F.sum("n")).first()
    assert told[1] == 600 and told[0] >= 540


def test_groups_of_lines_are_found_once_for_each_unit(spark):
    units = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("u"))
    made = units.select(chunking.split_long_unit(F.col("u"), 60).alias("p"))
    assert made._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    pieces = made.first().p
    assert all(p.startswith("line 1\n") for p in pieces) and [x for p in pieces for x in p.split("\n")[1:]] == [f"line {i}" for i in range(2, 3001)]
