"""From stored pages to clean articles. Row-local columns, but for the version pick and the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.functions.text import normalize_cedilla

# Version links, the mark of an article, amendment notes, repealed pieces, headings.
VERSION_TITLE = r"Consolidarea din (\d{2}\.\d{2}\.\d{4})"
PAGE_NUMBER = r"DetaliiDocument(?:Afis)?/(\d+)"
ARTICLE_MARK = 'class="S_ART"'
AMENDMENT_NOTE = r"^\(la (data de )?\d{2}-\d{2}-\d{4}"
ABROGATED = r"^(\(\d+(\^\d+)?\)\s*|[a-z](\^\d+)?\)\s*|\d+\.\s*)?Abrogat[ăe]?\.?$"
HEADING = r"^Articolul\s+(.+)$"
TITLE_CHARS = 120


def consolidations(links: DataFrame, current: DataFrame) -> DataFrame:
    """(page_id, pos, doc_id, version_date) of links(page_id, pos, title, href); a link without a number means its own page."""
    day = F.to_date(F.regexp_extract("title", VERSION_TITLE, 1), "dd.MM.yyyy")
    own = F.nullif(F.regexp_extract("href", PAGE_NUMBER, 1), F.lit("")).cast("long")
    named = links.filter(F.col("title").rlike(VERSION_TITLE)).join(current.select("page_id", "current_doc_id"), "page_id")
    return named.select("page_id", "pos", F.coalesce(own, F.col("current_doc_id")).alias("doc_id"), day.alias("version_date"))


def latest_version(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of each key, the first on equal dates; one max_by, combined before the shuffle."""
    newest = F.max_by(F.struct("doc_id", "version_date"), F.struct("version_date", -F.col("pos")))
    return versions.groupBy(key).agg(newest.alias("v")).select(key, "v.doc_id", "v.version_date")


def with_seed(laws: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Acts without a version keep their seed page and a null date."""
    return laws.join(latest, key, "left").select(key, F.coalesce("doc_id", "seed_id").alias("doc_id"), "version_date")


def count_marks(html: Column, mark: str = ARTICLE_MARK) -> Column:
    return F.regexp_count(html, F.lit(rf"\Q{mark}\E"))


def is_amendment_note(text: Column) -> Column:
    return text.rlike(AMENDMENT_NOTE)


def is_abrogated(text: Column) -> Column:
    """Whatever the case of its letters."""
    return text.rlike(f"(?iu){ABROGATED}")


def article_abrogated(units: Column) -> Column:
    return F.forall(units, is_abrogated)


def drop_abrogated(units: Column) -> Column:
    """Units that are repealed as a whole, then repealed lines within units; untouched if all of them are repealed."""
    kept = F.filter(units, lambda u: ~is_abrogated(u))
    cut = F.transform(kept, lambda u: F.array_join(F.filter(F.split(u, "\n"), lambda x: ~is_abrogated(x)), "\n"))
    return F.when(article_abrogated(units), units).otherwise(cut)


def has_marginal_title(title: Column, units: Column) -> Column:
    first = F.get(units, F.lit(0))  # null where there is no unit
    plain = (F.length(first) < TITLE_CHARS) & (F.instr(first, "\n") == 0) & ~first.rlike(r"[.:;,]$")
    return (title == "") & (F.size(units) > 1) & plain


def marginal_title(df: DataFrame) -> DataFrame:
    """A short first unit without final punctuation is the title of an article that has none."""
    moved = has_marginal_title(F.col("title"), F.col("units"))
    df = df.withColumn("_moved", F.coalesce(moved, F.lit(False)))
    title = F.when(F.col("_moved"), F.get("units", F.lit(0))).otherwise(F.col("title"))
    units = F.when(F.col("_moved"), F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))).otherwise(F.col("units"))
    return df.withColumns({"title": title, "units": units}).drop("_moved")


def article_number(heading: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(heading, HEADING, 1)), F.lit("")), heading)


def clean_articles(raw: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, quarantine): raw rows with a problem go to the second."""
    good = raw.filter("problem is null").withColumns({"title": normalize_cedilla(F.col("title")), "units": F.transform("units", normalize_cedilla), "hierarchy": F.transform("hierarchy", normalize_cedilla)})
    titled = marginal_title(good)
    out = titled.join(meta, "page_id").select(
        "page_id", "pos", F.col("slug").alias("law_slug"), F.col("name").alias("law_name"), F.col("short_ref").alias("law_ref"),
        article_number(F.col("heading")).alias("number"), "title", "hierarchy", drop_abrogated(F.col("units")).alias("units"), "url",
        F.col("consolidation_date").cast("string").alias("consolidation_date"), article_abrogated(F.col("units")).alias("abrogated"),
        F.array_sort(F.array_distinct("references")).alias("references"),
    )
    return out, raw.filter("problem is not null")


def article_stats(articles: DataFrame) -> DataFrame:
    return articles.groupBy("law_slug").agg(F.count("*").alias("n_articles"), F.count_if(~F.col("abrogated")).alias("n_in_force"))


def reject_empty(pages: DataFrame, mark: str = ARTICLE_MARK) -> tuple[DataFrame, DataFrame]:
    """(pages with articles, pages without)."""
    counted = pages.withColumn("n_articles", count_marks(F.col("html"), mark))
    return counted.filter("n_articles > 0"), counted.filter("n_articles = 0")


