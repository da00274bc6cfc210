"""Articles to chunks: greedy groups of units, long units split at lines. All row-local; no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 3200


def group_starts(sizes: Column, max_chars: Column) -> Column:
    """First places of the greedy groups. A group is closed when the next unit does not fit and it is not empty.

    Only the starts are collected, so the fold costs the number of units times the copying of a few starts.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("size"))

    def step(a: Column, n: Column) -> Column:
        new = (a.i == 0) | (a["size"] + n > max_chars)
        starts = F.when(new, F.array_append(a.starts, a.i)).otherwise(a.starts)
        return F.struct(starts.alias("starts"), (a.i + 1).alias("i"), (F.when(new, 0).otherwise(a["size"]) + n + 1).alias("size"))

    return F.aggregate(sizes, zero, step, lambda a: a.starts)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once: an array of one element stands for one that is used more than once."""
    return F.transform(F.array(value), use)[0]


def group_units(units: Column, max_chars: Column) -> Column:
    """Arrays of consecutive units of at most max_chars characters with a separator each; a longer unit stands alone."""

    def take(u: Column, starts: Column, s: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size(starts), F.get(starts, k + 1)).otherwise(F.size(u))
        return F.slice(u, s + 1, end - s)

    starts = lambda u: once(max_chars, lambda m: group_starts(F.transform(u, F.length), m))
    return once(units, lambda u: once(starts(u), lambda a: F.transform(a, lambda s, k: take(u, a, s, k))))


def split_long_unit(unit: Column, max_chars: int) -> Column:
    """A unit over max_chars, cut between lines; each piece starts with the first line. A single line is never cut."""

    def cut(lines: Column) -> Column:
        intro, items = lines[0], F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1)))
        pieces = F.transform(group_units(items, F.lit(max_chars) - F.length(intro) - 1), lambda g: F.concat(intro, F.lit("\n"), F.array_join(g, "\n")))
        return F.when(F.size(lines) < 2, F.array(unit)).otherwise(pieces)

    return F.when(F.length(unit) <= max_chars, F.array(unit)).otherwise(once(F.split(unit, "\n"), cut))


def build_header(law_name: Column, law_ref: Column, hierarchy: Column, number: Column, title: Column) -> Column:
    path = F.array_join(F.concat(F.array(F.concat(law_name, F.lit(" ("), law_ref, F.lit(")"))), hierarchy), " > ")
    return F.concat(path, F.lit("\nArt. "), number, F.when(title != "", F.concat(F.lit(" - "), title)).otherwise(""))


def chunk_articles(articles: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows of schemas.CHUNK; columns of articles beyond its schema are carried along."""
    known = {"law_slug", "law_name", "law_ref", "number", "title", "hierarchy", "units", "url", "consolidation_date", "abrogated", "references"}
    extra = [c for c in articles.columns if c not in known]
    whole = articles.filter(~F.col("abrogated"))
    units = F.flatten(F.transform("units", lambda u: split_long_unit(u, max_chars)))
    header = build_header(*(F.col(c) for c in ("law_name", "law_ref", "hierarchy", "number", "title")))
    parts = whole.withColumn("_units", units).withColumns({"_groups": group_units(F.col("_units"), F.lit(max_chars)), "header": header})
    rows = parts.select("law_slug", "law_ref", "number", "header", "url", "consolidation_date", *extra, F.size("_groups").alias("n_parts"), F.posexplode("_groups").alias("_pos", "_group"))
    return rows.select(
        F.concat_ws(":", "law_slug", F.concat(F.lit("art"), "number"), (F.col("_pos") + 1).cast("string")).alias("id"),
        "law_slug", "law_ref", F.col("number").alias("article"), (F.col("_pos") + 1).alias("part"), "n_parts", "header",
        F.array_join("_group", "\n").alias("body"), "url", "consolidation_date", *extra,
    )


def chunk_text() -> Column:
    return F.concat_ws("\n", "header", "body")


def citation() -> Column:
    return F.concat(F.col("law_ref"), F.lit(", art. "), F.col("article"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by act, and (law_slug null) their number, upper median and largest length in the corpus."""
    from actmill.operators.evaluation import rank_percentiles

    sized = chunks.select("law_slug", F.length(chunk_text()).alias("n"))
    by = sized.groupBy("law_slug").agg(F.count("*").alias("n_chunks"))
    median = rank_percentiles(sized.select(F.lit(1).alias("g"), "n"), ["g"], "n", {"median": 0.5})
    total = sized.agg(F.count("*").alias("n_chunks"), F.max("n").alias("longest"))
    whole = total.crossJoin(F.broadcast(median.drop("g"))).select(F.lit(None).cast("string").alias("law_slug"), "n_chunks", "median", "longest")
    return by.select("law_slug", "n_chunks", F.lit(None).cast("int").alias("median"), F.lit(None).cast("int").alias("longest")).unionByName(whole)


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunk rows as the search has them: chunk_id, text, and chunk_pos by act, article and part."""
    return chunks.withColumnRenamed("id", "chunk_id").withColumns({"text": chunk_text(), "chunk_pos": F.struct("law_slug", "article", "part")})
