"""References to acts and articles in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The acts by slug, name, short reference, page number, and the lower-case names people use, in this order.
LAWS = [
    ("constitutia", "Constituția României", "Constituția", 47355, ["constitutia", "constitutie", "constitutiei"]),
    ("codul_muncii", "Codul muncii", "Legea 53/2003", 309240, ["codul muncii", "codului muncii", "codul de munca", "53/2003", "legea 53"]),
    ("codul_rutier", "Circulația pe drumurile publice", "OUG 195/2002", 84237, ["codul rutier", "codului rutier", "195/2002", "oug 195"]),
    ("legea_societatilor", "Legea societăților", "Legea 31/1990", 169688, ["legea societatilor", "legii societatilor", "31/1990", "legea 31"]),
    ("codul_penal", "Codul penal", "Legea 286/2009", 268760, ["codul penal", "codului penal", "cod penal", "286/2009", "legea 286"]),
    ("regimul_contraventiilor", "Regimul juridic al contravențiilor", "OG 2/2001", 38393, ["regimul contraventiilor", "og 2/2001", "2/2001", "ordonanta 2/2001"]),
]
# Fixed value: an article number, and its superscript after a caret or a word for index.
ARTICLE = r"\bart(?:icolul|icolului|icol|\.)?\s*(\d+)(?:\s*(?:\^|ind(?:ice)?\.?)\s*(\d+))?"


def named_by(plain: Column, aliases: list[str]) -> Column:
    """Any alias stands in the text as whole words; the text is lower-cased and without diacritics."""
    return plain.rlike("(?:" + "|".join(rf"\b\Q{a}\E\b" for a in aliases) + ")")


def detect_laws(plain: Column, laws: list[tuple] = LAWS) -> Column:
    """Slugs of the acts named in the text, in the order of laws. One expression, as the list of acts is fixed."""
    found = F.array(*(F.when(named_by(plain, law[4]), law[0]) for law in laws))
    return F.filter(found, lambda x: x.isNotNull())


def article_numbers(plain: Column) -> Column:
    """Distinct article numbers in order of appearance, with ^ before a superscript."""
    numbers = F.regexp_extract_all(plain, F.lit(ARTICLE), F.lit(1))
    above = F.regexp_extract_all(plain, F.lit(ARTICLE), F.lit(2))
    return F.array_distinct(F.zip_with(numbers, above, lambda n, s: F.when(s == "", n).otherwise(F.concat(n, F.lit("^"), s))))


def detect_article_refs(questions: DataFrame, plain: str, laws: list[tuple] = LAWS) -> DataFrame:
    """(qid, ref_pos, law_slug, article), where exactly one act is named."""
    found = questions.select("qid", detect_laws(F.col(plain), laws).alias("laws"), article_numbers(F.col(plain)).alias("articles"))
    return found.filter(F.size("laws") == 1).select("qid", F.posexplode("articles").alias("ref_pos", "article"), F.col("laws")[0].alias("law_slug"))


def pinned_articles(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """References to articles of the corpus; any law filter does not apply to them."""
    return refs.join(articles, ["law_slug", "article"])
