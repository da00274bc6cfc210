"""Data-quality checks: each returns the rows that break a rule, empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.schemas import QUESTION_TYPES


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_questions(questions: DataFrame, laws: DataFrame) -> DataFrame:
    """(id, problem). laws(law_slug) are the known acts."""
    say = lambda df, what: df.select("id", F.lit(what).alias("problem"))
    named = questions.select("id", F.explode("gold").alias("key")).withColumn("law_slug", F.substring_index("key", ":", 1))
    return _union([
        say(questions.groupBy("id").count().filter("count > 1"), "repeated id"),
        say(questions.filter(~F.col("type").isin(*QUESTION_TYPES) | F.col("type").isNull()), "unknown type"),
        say(questions.filter((F.size("gold") == 0) != (F.col("type") == "unanswerable")), "gold against type"),
        say(named.join(laws.select("law_slug").distinct(), "law_slug", "left_anti").select("id").distinct(), "unknown act"),
        say(questions.filter(F.coalesce(F.trim("answer_key"), F.lit("")) == ""), "empty answer key"),
    ])


def check_chunks(chunks: DataFrame) -> DataFrame:
    """(id, problem): repeated chunk ids, and articles whose parts are not 1 to n_parts."""
    twice = chunks.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    parts = chunks.groupBy("law_slug", "article").agg(F.max("part").alias("top"), F.max("n_parts").alias("n"), F.count("*").alias("rows"))
    broken = parts.filter("top <> n or rows <> n").select(F.concat_ws(":", "law_slug", "article").alias("id"), F.lit("incomplete parts").alias("problem"))
    return twice.unionByName(broken)


def check_parse(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, problem). articles(page_id, abrogated, units), pages(page_id, n_articles)."""
    facts = articles.groupBy("page_id").agg(
        F.count("*").alias("parsed"),
        F.count_if(~F.col("abrogated") & (F.array_join("units", "") == "")).alias("empty"),
        F.count_if(F.exists("units", lambda u: u.startswith("(la "))).alias("notes"),
    )
    both = pages.join(facts, "page_id", "left").fillna(0, ["parsed", "empty", "notes"])
    say = lambda cond, what: both.filter(cond).select("page_id", F.lit(what).alias("problem"))
    return _union([say("parsed <> n_articles", "count differs"), say("empty > 0", "article without text"), say("notes > 0", "amendment note left")])
