"""Rank fusion, reranking, grouping of chunks to articles, and the whole hybrid search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.functions.refs import pinned_articles
from actmill.operators.lexical import in_laws, with_laws

RRF_K = 60
METHODS = ("bm25", "vector")


@dataclass(frozen=True)
class SearchConfig:
    use_bm25: bool = True
    use_vector: bool = True
    use_rerank: bool = True
    use_explicit_refs: bool = True
    candidates: int = 30
    rerank_top: int = 20
    bm25_weight: float = 1.0


#: The named configurations that are compared with each other.
VARIANTS = {
    "bm25": SearchConfig(use_vector=False, use_rerank=False, use_explicit_refs=False),
    "vector": SearchConfig(use_bm25=False, use_rerank=False, use_explicit_refs=False),
    "hybrid": SearchConfig(use_rerank=False, use_explicit_refs=False),
    "hybrid_weighted": SearchConfig(use_rerank=False, use_explicit_refs=False, bm25_weight=0.3),
    "vector_rerank": SearchConfig(use_bm25=False, use_explicit_refs=False),
    "hybrid_rerank": SearchConfig(use_explicit_refs=False),
    "hybrid_rerank_refs": SearchConfig(),
}


def with_method(ranking: DataFrame, name: str, pos: int, weight: float = 1.0) -> DataFrame:
    return ranking.select("qid", "chunk_id", "rank", F.lit(name).alias("method"), F.lit(pos).alias("method_pos"), F.lit(float(weight)).alias("weight"))


def reciprocal_rank_fusion(rankings: DataFrame, keys: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """(*keys, chunk_id, score, methods, fused_rank) of the rows of with_method, one aggregate and one window.

    score is the sum of weight / (k + rank), rounded to 9 places; ties keep the order in which chunks were first seen,
    the whole first ranking before the second.
    """
    keys = keys or ["qid"]
    fused = rankings.groupBy(*keys, "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("method_pos", "rank")).alias("seen"),
        F.array_sort(F.collect_set("method")).alias("methods"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "seen", "chunk_id"))
    return fused.withColumn("fused_rank", place).drop("seen")


def rerank(fused: DataFrame, questions: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column], top: int = 20, keys: list[str] | None = None) -> DataFrame:
    """The fused top, scored as pairs (question, text); the new score replaces the fused one, ties keep the fused order."""
    keys = keys or ["qid"]
    pairs = fused.filter(F.col("fused_rank") <= top).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    scored = pairs.withColumn("score", scorer(F.col("question"), F.col("text"))).drop("question", "text")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "fused_rank"))
    return scored.withColumn("final_rank", place)


def group_to_articles(ranked: DataFrame, chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, law_slug, article, score, best_rank, parts, sources): found chunks of an article in its own order."""
    keys = keys or ["qid"]
    named = ranked.join(chunks.select("chunk_id", "law_slug", "article", "part"), "chunk_id")
    return named.groupBy(*keys, "law_slug", "article").agg(
        F.max_by("score", -F.col("final_rank")).alias("score"),
        F.min("final_rank").alias("best_rank"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("sources"),
    )


def top_articles(grouped: DataFrame, pinned: DataFrame, keys: list[str] | None = None, k: int = 5) -> DataFrame:
    """(*keys, rank, law_slug, article, score, explicit, sources, parts): pinned articles first, in reference order.

    pinned has keys, law_slug, article, ref_pos and parts; an article that is pinned is taken once.
    """
    keys = keys or ["qid"]
    rest = grouped.join(pinned.select(*keys, "law_slug", "article"), [*keys, "law_slug", "article"], "left_anti")
    first = pinned.select(
        *keys, "law_slug", "article", F.lit(float("inf")).alias("score"), F.lit(True).alias("explicit"),
        F.array(F.lit("ref")).alias("sources"), "parts", F.col("ref_pos").cast("long").alias("at"),
    )
    other = rest.select(*keys, "law_slug", "article", "score", F.lit(False).alias("explicit"), "sources", "parts", F.col("best_rank").cast("long").alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("explicit").desc(), "at", "law_slug", "article"))
    return first.unionByName(other).withColumn("rank", place).filter(F.col("rank") <= k).drop("at")


def article_parts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("law_slug", "article").agg(F.array_sort(F.collect_list("part")).alias("parts"))


def hybrid_search(
    questions: DataFrame, chunks: DataFrame, bm25: DataFrame | None, vector: DataFrame | None, refs: DataFrame | None,
    config: SearchConfig, scorer: Callable[[Column, Column], Column] | None = None, k: int = 5, laws: list[str] | None = None,
) -> DataFrame:
    """The whole search over rankings computed once; each step can be left out.

    With laws, or a column laws of questions, only articles of these acts are found, but explicit references are found in
    any act; the rankings should have been made with the same filter, before their cut.
    """
    asked = with_laws(questions, laws)
    if "laws" in asked.columns:
        inside = chunks.select("chunk_id", "law_slug")
        within = lambda r: r.join(asked.select("qid", "laws"), "qid").join(inside, "chunk_id").filter(in_laws(F.col("laws"), F.col("law_slug"))).select(*r.columns)
        bm25, vector = (r if r is None else within(r) for r in (bm25, vector))
    used = []
    if config.use_bm25 and bm25 is not None:
        used.append(with_method(bm25.filter(F.col("rank") <= config.candidates), "bm25", len(used), config.bm25_weight))
    if config.use_vector and vector is not None:
        used.append(with_method(vector.filter(F.col("rank") <= config.candidates), "vector", len(used)))
    if not used:
        raise ValueError("no ranking is in use")
    rankings = used[0] if len(used) == 1 else used[0].unionByName(used[1])
    fused = reciprocal_rank_fusion(rankings)
    if config.use_rerank and scorer is not None:
        ranked = rerank(fused, questions, chunks, scorer, config.rerank_top)
    else:
        ranked = fused.withColumn("final_rank", F.col("fused_rank"))
    pinned = refs if config.use_explicit_refs and refs is not None else None
    if pinned is None:
        spark = questions.sparkSession
        pinned = spark.createDataFrame([], f"qid {dict(questions.dtypes)['qid']}, law_slug string, article string, ref_pos int, parts array<int>")
    else:
        pinned = pinned_articles(pinned, article_parts(chunks))
    return top_articles(group_to_articles(ranked, chunks), pinned, k=k)


def sweep(
    questions: DataFrame, chunks: DataFrame, bm25: DataFrame, vector: DataFrame, refs: DataFrame, scorer: Callable[[Column, Column], Column],
    variants: dict[str, SearchConfig] | None = None, k: int = 10,
) -> DataFrame:
    """(variant, qid, rank, law_slug, article, ...): hits of all variants. Both rankings are read once; variants weigh them."""
    variants = variants or VARIANTS
    keys = ["variant", "qid"]
    rows = [
        F.struct(F.lit(name).alias("variant"), F.lit(m).alias("m"), F.lit(float(w)).alias("weight"), F.lit(c.candidates).alias("candidates"))
        for name, c in variants.items()
        for m, w, used in zip(METHODS, (c.bm25_weight, 1.0), (c.use_bm25, c.use_vector), strict=True)
        if used
    ]
    both = with_method(bm25, METHODS[0], 0).unionByName(with_method(vector, METHODS[1], 1)).drop("weight")
    spread = both.select("*", F.explode(F.array(*rows)).alias("v")).filter("v.m = method and rank <= v.candidates")
    fused = reciprocal_rank_fusion(spread.select("v.variant", "qid", "chunk_id", "rank", "method", "method_pos", "v.weight"), keys)
    again = {c.rerank_top: [n for n, x in variants.items() if x.use_rerank and x.rerank_top == c.rerank_top] for c in variants.values() if c.use_rerank}
    plain = fused.filter(~F.col("variant").isin([n for names in again.values() for n in names])).withColumn("final_rank", F.col("fused_rank"))
    for top, names in again.items():
        plain = plain.unionByName(rerank(fused.filter(F.col("variant").isin(names)), questions, chunks, scorer, top, keys))
    with_refs = [n for n, c in variants.items() if c.use_explicit_refs]
    pinned = refs.join(article_parts(chunks), ["law_slug", "article"]).select(F.explode(F.array(*map(F.lit, with_refs)).cast("array<string>")).alias("variant"), *refs.columns, "parts")
    return top_articles(group_to_articles(plain, chunks, keys), pinned, keys, k)
