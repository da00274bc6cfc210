"""Citations in answers, prompts from ranked sources, and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the prompt's frame.
SOURCES_HEAD, QUESTION_HEAD, EXTRACT = "SURSE:\n\n", "\n\n---\nÎNTREBARE: ", " (extras)"
REPUBLISHED = "forma republicată"
NO_SOURCES = "Nu am găsit în legile indexate prevederi relevante pentru această întrebare."


def markers(text: Column) -> Column:
    """Distinct numbers in brackets, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("bigint")))


def valid_citations(text: Column, n_sources: Column) -> Column:
    return F.filter(markers(text), lambda n: (n >= 1) & (n <= n_sources))


def invalid_citations(text: Column, n_sources: Column) -> Column:
    """Numbers without a source; one too large for a number counts as null."""
    return F.filter(markers(text), lambda n: n.isNull() | (n < 1) | (n > n_sources))


def mentions(text: Column, article: Column) -> Column:
    """The text names the article: no digit or caret follows the number; case matters."""
    return F.rlike(text, F.concat(F.lit(r"\bart(?:icolul|\.)?\s*\Q"), article, F.lit(r"\E(?![\d^])")))


def infer_cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, cited): places of the sources whose article an answer names. answers(id, text), hits(id, n, article)."""
    found = answers.join(hits, "id").filter(mentions(F.col("text"), F.col("article")))
    return found.groupBy("id").agg(F.array_sort(F.collect_set(F.col("n").cast("bigint"))).alias("cited"))


def resolve(cited: Column, inferred: Column, keys: Column) -> Column:
    """Keys of the cited sources; those inferred from the text where no marker is valid."""
    chosen = F.when(F.size(cited) > 0, cited).otherwise(F.coalesce(inferred, F.array().cast("array<bigint>")))
    return F.transform(chosen, lambda n: F.element_at(keys, n.cast("int")))


def format_source(n: Column, header: Column, bodies: Column, n_parts: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), header, F.when(n_parts != F.size(bodies), EXTRACT).otherwise(""), F.lit("\n"), F.array_join(bodies, "\n"))


def build_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, prompt). questions(qid, question), hits(qid, rank, header, bodies, n_parts)."""
    source = format_source(F.col("rank"), F.col("header"), F.col("bodies"), F.col("n_parts"))
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("source")))).alias("sources"))
    text = F.concat(F.lit(SOURCES_HEAD), F.array_join(F.col("sources.source"), "\n\n"), F.lit(QUESTION_HEAD), F.col("question"))
    return questions.join(per, "qid").select("qid", text.alias("prompt"))


def unanswered(questions: DataFrame, hits: DataFrame, answer: str = NO_SOURCES) -> DataFrame:
    return questions.join(hits.select("qid"), "qid", "left_anti").select("qid", F.lit(answer).alias("answer"))


def source_label(n: Column, law_name: Column, article: Column, header: Column) -> Column:
    """[n]  act · art. N · title, the title being what follows ' - ' in the header's last line."""
    last = F.element_at(F.split(header, "\n"), -1)
    title = F.when(F.instr(last, " - ") > 0, F.substring(last, F.instr(last, " - ") + 3, F.length(last)))
    parts = F.concat_ws(" · ", law_name, F.concat(F.lit("art. "), article), F.when(title != "", title))
    return F.concat(F.lit("["), n.cast("string"), F.lit("]  "), parts)


def crumb(header: Column) -> Column:
    """The path without the act."""
    path = F.split(F.element_at(F.split(header, "\n"), 1), " > ")
    return F.array_join(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), " / ")


def display_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd.MM.yyyy"), F.lit(REPUBLISHED))
