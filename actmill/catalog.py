"""Queries by name over the shared tables, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actmill.catalog_sql import ORACLE_SQL
from actmill.functions import citations as cit
from actmill.functions import html, refs, text
from actmill import schemas
from actmill.operators import ann, chunking, evaluation, fusion, ingest, lexical, models, postings, quality, sync, vectors
from actmill.operators.snapshot import Snapshot
from actmill.operators.storage import shared_folder, stored
from actmill.sources import tables as src

QUERIES = {}
#: Below this BM25 score a chunk is not relevant enough to answer from.
LEAST_SCORE = 45
LAW_FILTER = ["src1", "src2", "src3"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return src.spread(src.table(spark, d, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")


# Text.


@query
def strip_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.strip_diacritics(F.lower("text")).alias("plain"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


@query
def normalize_cedilla(spark: SparkSession, d: str) -> DataFrame:
    # The tables have no cedillas: s and t before a vowel take one first.
    return docs(spark, d).select("doc_id", text.normalize_cedilla(F.regexp_replace(F.regexp_replace("text", "s([aeiou])", "ş$1"), "T([aeiou])", "Ţ$1")).alias("text"))


@query
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.collapse_ws(F.regexp_replace("text", " ", " \t ")).alias("text"))


@query
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    return text.stem_vocabulary(docs(spark, d).select(text.tokenize(F.col("text")).alias("tokens")), "tokens")


# Ingest.


@query
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    orders = src.table(spark, d, "orders").select(F.col("o_custkey").alias("law"), F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("version_date"), F.col("o_orderkey").alias("pos"))
    laws = src.table(spark, d, "customer").select(F.col("c_custkey").alias("law"), (-F.col("c_custkey")).alias("seed_id"))
    return ingest.with_seed(laws, ingest.latest_version(orders, "law"), "law").select("law", "doc_id", F.col("version_date").cast("string").alias("version_date"))


@query
def consolidations(spark: SparkSession, d: str) -> DataFrame:
    # A history block made of each page's number, before its own markup.
    link = lambda n, day: F.concat(F.lit('<a title="Consolidarea din '), day, F.lit('" href="/Public/DetaliiDocument/'), n, F.lit('">v</a>'))
    day = lambda k: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 500 + k).cast("int")), "dd.MM.yyyy")
    shown = F.concat(F.lit('<a id="fa_selectata" title="Consolidarea din '), day(9), F.lit('">v</a>'))
    pages = src.table(spark, d, "pages")
    made = pages.select("page_id", F.concat(F.lit('<div id="istoric_fa">'), shown, link(F.col("page_id") * 10, day(5)), link(F.col("page_id") * 10 + 1, day(9)), F.lit("</div>"), "html").alias("html"))
    found = ingest.consolidations(html.version_links(made), pages.select("page_id", (F.col("page_id") + 5).alias("current_doc_id")))
    return found.select("page_id", "pos", "doc_id", F.col("version_date").cast("string").alias("version_date"))


@query
def count_elements(spark: SparkSession, d: str) -> DataFrame:
    good, bad = ingest.reject_empty(src.table(spark, d, "pages"), 'class="ad"')
    return good.select("page_id", "n_articles", F.lit(False).alias("rejected")).unionByName(bad.select("page_id", "n_articles", F.lit(True).alias("rejected")))


def _marked_units(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document; by place some become amendment notes or repealed pieces."""
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""),
        lambda x, i: F.when((F.col("doc_id") + i) % 7 == 0, F.concat(F.lit("(la data de 01-02-2020 "), x))
        .when((F.col("doc_id") + i) % 7 == 1, F.lit("b) abrogată."))
        .when((F.col("doc_id") + i) % 7 == 2, F.lit("(2^1) Abrogat"))
        .when(F.col("doc_id") % 10 == 3, F.lit("ABROGATE."))
        .otherwise(x),
    )
    return docs(spark, d).select("doc_id", lines.alias("units"))


@query
def amendment_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("units", lambda u: ~ingest.is_amendment_note(u))
    return _marked_units(spark, d).select("doc_id", kept.alias("units"))


@query
def abrogated_filter(spark: SparkSession, d: str) -> DataFrame:
    u = _marked_units(spark, d)
    return u.select("doc_id", ingest.article_abrogated(F.col("units")).alias("abrogated"), ingest.drop_abrogated(F.col("units")).alias("units"))


@query
def marginal_title(spark: SparkSession, d: str) -> DataFrame:
    cut = F.transform("units", lambda u: F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(u, r"[.]$", "")).otherwise(u))
    return ingest.marginal_title(src.articles(spark, d).select("doc_id", "title", cut.alias("units"))).select("doc_id", "title", "units")


@query
def article_number(spark: SparkSession, d: str) -> DataFrame:
    # Each line as a heading, of an article or of something else.
    heading = lambda x, i: F.concat(F.when((F.col("doc_id") + i) % 3 == 0, "Anexa ").otherwise("Articolul  "), x, F.when(i % 2 == 0, "^1 ").otherwise(""))
    numbers = F.transform(F.split("text", "\n"), lambda x, i: ingest.article_number(heading(x, i)))
    return docs(spark, d).select("doc_id", numbers.alias("numbers"))


@query
def article_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.article_stats(src.articles(spark, d).withColumn("abrogated", F.col("doc_id") % 10 == 3))


@query
def article_references(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[A-Z]\p{L}+"), F.lit(0))
    return docs(spark, d).select("doc_id", F.array_sort(F.array_distinct(found)).alias("references"))


@query
def parse_pages(spark: SparkSession, d: str) -> DataFrame:
    # The pages' own paragraphs take the classes of articles, so that every page has some.
    pages = src.table(spark, d, "pages")
    ready = F.regexp_replace(F.regexp_replace("html", "<article[^>]*>", '<div class="S_ART"><span class="S_ART_TTL">Articolul 1</span><div class="S_ART_BDY">'), "</article>", "</div></div>")
    meta = pages.select("page_id", F.lit("web").alias("slug"), F.lit("Web").alias("name"), F.lit("W").alias("short_ref"), "url", F.lit(None).cast("date").alias("consolidation_date"))
    articles, _ = ingest.clean_articles(html.raw_articles(pages.select("page_id", F.regexp_replace(ready, "<p>", '<p class="S_PAR">').alias("html"))), meta)
    return articles


@query
def hierarchy_paths(spark: SparkSession, d: str) -> DataFrame:
    # Each page's own markup as the body of an article, below a title and, for every other page, a chapter.
    n = F.col("page_id")
    title = F.concat(F.lit('<div class="S_TTL"><span class="S_TTL_TTL">Partea '), n, F.lit('</span><span class="S_TTL_DEN">despre '), n % 7, F.lit("</span>"))
    chapter = F.when(n % 2 == 0, F.concat(F.lit('<div class="S_CAP"><span class="S_CAP_TTL">Grupa '), n % 5, F.lit("</span>"))).otherwise("")
    html_of = F.concat(title, chapter, F.lit('<div class="S_ART"><span class="S_ART_TTL">Articolul 1</span><div class="S_ART_BDY">'), "html", F.lit("</div></div>"))
    return html.raw_articles(src.table(spark, d, "pages").select("page_id", html_of.alias("html"))).select("page_id", "heading", "hierarchy")


# Chunks.


@query
def group_units(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", F.transform(chunking.group_units(lines, F.lit(600)), F.size).alias("sizes"))


@query
def split_long_unit(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", chunking.split_long_unit(F.col("text"), 1500).alias("pieces"))


@query
def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    return src.chunks(spark, d).select("chunk_id", "law_slug", "law_ref", "article", "part", "n_parts", "header", "body", "url", chunking.citation().alias("citation"))


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_stats(src.chunks(spark, d))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return src.chunks(spark, d).select("chunk_id", chunking.content_hash(F.col("text")).alias("hash"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("id"), "text", chunking.content_hash(F.col("text")).alias("hash"))


def _existing(spark: SparkSession, d: str) -> DataFrame:
    """An older snapshot: some documents missing, some with another text, some that are gone since."""
    own = docs(spark, d).filter("doc_id % 7 <> 0")
    old = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    gone = docs(spark, d).filter("doc_id % 13 = 0").select((-F.col("doc_id") - 1).alias("id"), "text")
    rows = own.select(F.col("doc_id").alias("id"), old.alias("text")).unionByName(gone)
    return rows.select("id", "text", chunking.content_hash(F.col("text")).alias("hash"))


@query
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return sync.diff_index(_existing(spark, d), _wanted(spark, d))


@query
def sync_apply(spark: SparkSession, d: str) -> DataFrame:
    old = _existing(spark, d).select("id", "hash", F.lit("kept").alias("origin"))
    return sync.apply_sync(old, _wanted(spark, d), lambda todo: todo.withColumn("origin", F.lit("embedded")))


@query
def snapshot_sync(spark: SparkSession, d: str) -> DataFrame:
    table = Snapshot(spark, f"{shared_folder(spark)}/snapshot-{uuid.uuid4()}", "id long, hash string, origin string", 16)
    table.sync(_existing(spark, d).select("id", "hash"), lambda todo: todo.withColumn("origin", F.lit("kept")))
    table.sync(_wanted(spark, d).select("id", "hash"), lambda todo: todo.withColumn("origin", F.lit("embedded")))
    return table.read()


@query
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", sync.embed_column(models.hashing_encoder(), F.col("text")).alias("embedding"))


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = src.table(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda x, i: x.cast("double") * (i % 3 + 1))
    return v.select("vec_id", F.transform(sync.l2_normalize(scaled), lambda x: sync.rounded(x, 6)).alias("unit"))


# Search.


@query
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.idf_table(lexical.token_index(src.chunks(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_idf_levels(spark: SparkSession, d: str) -> DataFrame:
    """An idf depends on the document frequency alone: how many terms have each."""
    idf = lexical.idf_table(lexical.token_index(src.chunks(spark, d)))
    return idf.groupBy("df").agg(F.count("*").alias("n_terms"), F.round(F.max("idf"), 6).alias("idf"), F.count_distinct(F.round("idf", 6)).alias("n_idf"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """The token index, with what names a chunk's article: chunks are made once for it, and not stored with their texts."""
    return lexical.token_index(src.chunks(spark, d), carry=("doc_id", "article", "part"))


def _chunks_of(spark: SparkSession, d: str, index: DataFrame, *rankings: DataFrame) -> DataFrame:
    """All chunks, with text, of the documents that rankings(chunk_id) name: few, and made from these documents again."""
    named = reduce(DataFrame.unionByName, (r.select("chunk_id") for r in rankings))
    return src.chunks(spark, d, stored(index.select("chunk_id", "doc_id").join(named, "chunk_id").select("doc_id").distinct()))


def _bm25(spark: SparkSession, d: str, laws: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    return lexical.bm25_search(src.questions(spark, d), lexical.token_index(src.chunks(spark, d)) if index is None else index, laws=laws)


@query
def bm25_stems(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_search(src.questions(spark, d), lexical.token_index(src.chunks(spark, d), stems=True), stems=True)


@query
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


@query
def bm25_law_filter(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, LAW_FILTER)


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their own acts: two for a third of them, an empty list and none for the others."""
    laws = F.when(F.col("qid") % 3 == 0, F.array(F.lit("src1"), F.lit("src5"))).when(F.col("qid") % 3 == 1, F.array().cast("array<string>"))
    return src.questions(spark, d).withColumn("laws", laws)


@query
def bm25_laws_each(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_search(_limited(spark, d), lexical.token_index(src.chunks(spark, d)))


@query
def bm25_pruned(spark: SparkSession, d: str) -> DataFrame:
    return postings.pruned_search(src.questions(spark, d), postings.postings(lexical.token_index(src.chunks(spark, d))))


@query
def bm25_skipped(spark: SparkSession, d: str) -> DataFrame:
    return postings.skipped_share(src.questions(spark, d), postings.postings(lexical.token_index(src.chunks(spark, d))))


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = src.table(spark, d, "embeddings")
    corpus = v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return vectors.vector_search(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), corpus, 10)


def _vector_each(spark: SparkSession, d: str, index: DataFrame | None = None) -> DataFrame:
    asked = stored(src.question_vectors(spark, d).join(_limited(spark, d).select("qid", "laws"), "qid"))
    return vectors.vector_search(asked, src.document_vectors(spark, d, index)).withColumnRenamed("id", "chunk_id")


@query
def vector_laws_each(spark: SparkSession, d: str) -> DataFrame:
    return _vector_each(spark, d)


@query
def vector_law_filter(spark: SparkSession, d: str) -> DataFrame:
    v = src.document_vectors(spark, d)
    return vectors.vector_search(src.question_vectors(spark, d), v, laws=LAW_FILTER).withColumnRenamed("id", "chunk_id")


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = src.table(spark, d, "embeddings")
    corpus = v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), corpus


@query
def ann_search(spark: SparkSession, d: str) -> DataFrame:
    asked, corpus = _embeddings(spark, d)
    return ann.search(asked, corpus, ann.build(corpus))


@query
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the exact search's rows, whether the index finds nine tenths at least, and as many rows for every question."""
    asked, corpus = _embeddings(spark, d)
    found, exact = stored(ann.search(asked, corpus, ann.build(corpus))), vectors.vector_search(asked, corpus, 10)
    told = ann.recall(found, exact).join(found.groupBy("qid").agg(F.count("*").alias("given")), "qid", "left")
    return told.agg(F.count("*").alias("n_queries"), (F.sum("hit") >= 0.9 * F.sum("n")).alias("enough"), F.every(F.col("given") == F.col("n")).alias("full"))


def _rankings(spark: SparkSession, d: str, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both rankings, stored: a few rows for each question, which the joins that follow can ship to the chunks."""
    vector = vectors.vector_search(stored(src.question_vectors(spark, d)), src.document_vectors(spark, d, index))
    return stored(_bm25(spark, d, index=index)), stored(vector.withColumnRenamed("id", "chunk_id"))


def _fused(spark: SparkSession, d: str, weight: float, index: DataFrame) -> DataFrame:
    bm25, vector = _rankings(spark, d, index)
    return fusion.reciprocal_rank_fusion(fusion.with_method(bm25, "bm25", 0, weight).unionByName(fusion.with_method(vector, "vector", 1)))


@query
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 1.0, _index(spark, d))


@query
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, 0.3, _index(spark, d))


@query
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    fused = stored(_fused(spark, d, 1.0, index))
    ranked = fusion.rerank(fused, src.questions(spark, d), _chunks_of(spark, d, index, fused), models.overlap_scorer)
    return ranked.select("qid", "chunk_id", "score", "fused_rank", "final_rank")


@query
def group_articles(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return fusion.group_to_articles(_fused(spark, d, 1.0, index).withColumn("final_rank", F.col("fused_rank")), index)


def _pins(spark: SparkSession, d: str) -> DataFrame:
    """Two references for every fourth question, in the documents of its own and the next number."""
    q = src.questions(spark, d).filter("qid % 4 = 0").select("qid", F.posexplode(F.array(F.col("qid"), F.col("qid") + 1)).alias("ref_pos", "doc_id"))
    return q.join(docs(spark, d).select("doc_id", F.col("source").alias("law_slug")), "doc_id").select("qid", "ref_pos", "law_slug", F.col("doc_id").cast("string").alias("article"))


@query
def pinned(spark: SparkSession, d: str) -> DataFrame:
    return refs.pinned_articles(_pins(spark, d), fusion.article_parts(src.chunks(spark, d))).select("qid", "ref_pos", "law_slug", "article", "parts")


@query
def hybrid_top5(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    hits = fusion.hybrid_search(src.questions(spark, d), index, *_rankings(spark, d, index), stored(_pins(spark, d)), fusion.SearchConfig(use_rerank=False))
    return hits.withColumn("score", F.when(F.col("explicit"), -1.0).otherwise(F.col("score")))


@query
def hybrid_laws(spark: SparkSession, d: str) -> DataFrame:
    """Each question inside its own acts; its explicit references in any."""
    index, asked = _index(spark, d), _limited(spark, d)
    bm25, vector = stored(lexical.bm25_search(asked, index)), stored(_vector_each(spark, d, index))
    hits = fusion.hybrid_search(asked, index, bm25, vector, stored(_pins(spark, d)), fusion.SearchConfig(use_rerank=False))
    return hits.withColumn("score", F.when(F.col("explicit"), -1.0).otherwise(F.col("score")))


# References and citations.


@query
def detect_laws(spark: SparkSession, d: str) -> DataFrame:
    q = src.scripted_questions(spark, d).select("qid", text.strip_diacritics(F.lower("question")).alias("plain"))
    return q.select("qid", refs.detect_laws(F.col("plain")).alias("laws"))


@query
def detect_refs(spark: SparkSession, d: str) -> DataFrame:
    q = src.scripted_questions(spark, d).select("qid", text.strip_diacritics(F.lower("question")).alias("plain"))
    return refs.detect_article_refs(q, "plain")


@query
def check_citations(spark: SparkSession, d: str) -> DataFrame:
    a = src.answers(spark, d)
    return a.select("id", cit.valid_citations(F.col("text"), F.col("n_sources")).alias("cited"), cit.invalid_citations(F.col("text"), F.col("n_sources")).alias("invalid"))


@query
def infer_citations(spark: SparkSession, d: str) -> DataFrame:
    return cit.infer_cited(src.answers(spark, d).select("id", "text"), src.answer_hits(spark, d))


@query
def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    a = src.answers(spark, d).withColumn("cited", cit.valid_citations(F.col("text"), F.col("n_sources")))
    inferred = cit.infer_cited(a.select("id", "text"), src.answer_hits(spark, d)).withColumnRenamed("cited", "inferred")
    keys = src.answer_hits(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "article"))).alias("h")).select("id", F.col("h.article").alias("keys"))
    return a.join(inferred, "id", "left").join(keys, "id").select("id", cit.resolve(F.col("cited"), F.col("inferred"), F.col("keys")).alias("resolved"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks of each question as sources of one chunk each; chunks of a low score are no source."""
    index = _index(spark, d)
    best = stored(_bm25(spark, d, index=index).filter(f"rank <= 3 and score >= {LEAST_SCORE}"))
    return best.join(_chunks_of(spark, d, index, best), "chunk_id").select("qid", "rank", "header", F.array("body").alias("bodies"), "n_parts", "law_slug", "law_ref", "article", "part")


@query
def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    return cit.build_prompts(src.questions(spark, d), _hits(spark, d))


@query
def unanswered(spark: SparkSession, d: str) -> DataFrame:
    return cit.unanswered(src.questions(spark, d), _hits(spark, d))


@query
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    titled = F.concat("header", F.when(F.col("part") % 2 == 0, " - Titlu - doi").otherwise(""))
    day = F.when(F.col("doc_id") % 2 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")))
    return src.chunks(spark, d).select(
        "chunk_id", cit.source_label(F.col("part"), F.col("law_ref"), F.col("article"), titled).alias("label"), cit.crumb(F.col("header")).alias("crumb"), cit.display_date(day).alias("shown"),
    )


@query
def law_versions(spark: SparkSession, d: str) -> DataFrame:
    first = src.chunks(spark, d).groupBy("law_slug").agg(F.min_by(F.struct("consolidation_date", "url"), "chunk_pos").alias("v"))
    return first.select("law_slug", F.col("v.consolidation_date").alias("consolidation_date"), F.col("v.url").alias("url"))


@query
def split_cited(spark: SparkSession, d: str) -> DataFrame:
    a = src.answers(spark, d).select("id", cit.valid_citations(F.col("text"), F.col("n_sources")).alias("cited"), (F.col("turn") % 10 == 1).alias("llm_error"))
    rows = src.answer_hits(spark, d).join(a, "id")
    return rows.select("id", "n", (F.array_contains("cited", F.col("n").cast("bigint")) | F.col("llm_error")).alias("is_primary"))


# Evaluation.


def _keys(spark: SparkSession, ranking: DataFrame, index: DataFrame) -> DataFrame:
    """A ranking of chunks as one of articles: (qid, rank, key), ten at most."""
    grouped = fusion.group_to_articles(ranking.withColumns({"final_rank": F.col("rank"), "methods": F.array(F.lit("m"))}), index)
    none = spark.createDataFrame([], "qid long, law_slug string, article string, ref_pos int, parts array<int>")
    return fusion.top_articles(grouped, none, k=10).select("qid", "rank", F.concat_ws(":", "law_slug", "article").alias("key"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return evaluation.first_gold_rank(stored(src.evaluation_questions(spark, d)), stored(_keys(spark, stored(_bm25(spark, d, index=index)), index)))


@query
def first_gold_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("qid", "type", "rank", "gold")


@query
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_ranked(spark, d).filter(F.size("gold") > 0).withColumn("variant", F.lit("bm25")), ["variant"])


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(questions by variant with rank, hits by variant)."""
    index, pins = _index(spark, d), stored(_pins(spark, d))
    both = _rankings(spark, d, index)
    pinned = pins.join(index.select("chunk_id", "law_slug", "article"), ["law_slug", "article"])
    chunks = stored(_chunks_of(spark, d, index, *both, pinned).select("chunk_id", "law_slug", "article", "part", "text"))
    found = fusion.sweep(src.questions(spark, d), chunks, *both, pins, models.overlap_scorer)
    hits = stored(found.select("variant", "qid", "rank", F.concat_ws(":", "law_slug", "article").alias("key")))
    asked = stored(src.evaluation_questions(spark, d).filter(F.size("gold") > 0))
    each = asked.select("*", F.explode(F.array(*map(F.lit, fusion.VARIANTS))).alias("variant"))
    return evaluation.first_gold_rank(each, hits, ["variant", "qid"]), hits


@query
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d).withColumns({"variant": F.lit("bm25"), "type": F.when(F.length("question") > 200, "long").otherwise(F.col("type"))})
    return evaluation.metrics_by_type(ranked)


@query
def variant_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_sweep(spark, d)[0], ["variant"])


@query
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.detail_rows(*_sweep(spark, d))


@query
def misses(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.misses(_sweep(spark, d)[0], "hybrid_weighted")


@query
def compare_embeddings(spark: SparkSession, d: str) -> DataFrame:
    # Gold is a shared label; the model of 32 dimensions is the first half of the vectors, made unit length again.
    v = src.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("full"))
    half = sync.l2_normalize(F.slice("full", 1, 32))
    out = None
    for name, vector in (("full", F.col("full")), ("half", half)):
        rows = v.select("vec_id", "label", vector.alias("vector"))
        asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label", "vector")
        hits = vectors.vector_search(asked.select("qid", "vector"), rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "vector"), 11)
        others = hits.filter("id <> qid").join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("key")), "id").filter("rank > 1").select("qid", (F.col("rank") - 1).alias("rank"), "key")
        ranked = evaluation.first_gold_rank(asked.select("qid", F.array("label").alias("gold")), others)
        part = evaluation.metrics(ranked.withColumn("model", F.lit(name)), ["model"]).withColumn("dim", F.lit(64 if name == "full" else 32))
        out = part if out is None else out.unionByName(part)
    return out


@query
def compare_articles(spark: SparkSession, d: str) -> DataFrame:
    # Three vectors in a row are an article's chunks; gold are the other articles with a vector of the question's label.
    v = src.table(spark, d, "embeddings").select("vec_id", "label", F.concat(F.lit("art"), F.floor(F.col("vec_id") / 3)).alias("key"), F.col("embedding").cast("array<double>").alias("full"))
    models_of = F.explode(F.array(F.struct(F.lit("full").alias("model"), F.col("full").alias("vector")), F.struct(F.lit("half").alias("model"), sync.l2_normalize(F.slice("full", 1, 32)).alias("vector"))))
    rows = v.select("vec_id", "key", models_of.alias("m")).select("m.model", F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "key", "m.vector")
    asked = rows.filter("id % 100 = 0").select("model", F.col("id").alias("qid"), "vector")
    own = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("key").alias("own"))
    gold = own.join(v.select("label", "key").distinct(), "label").filter("key <> own").groupBy("qid").agg(F.array_sort(F.collect_set("key")).alias("gold"))
    return evaluation.compare_models(rows, asked, gold)


@query
def log_batches(spark: SparkSession, d: str) -> DataFrame:
    """The answer log appended in two batches, the first one twice."""
    rows, path = src.answer_log(spark, d).drop("seq"), f"{shared_folder(spark)}/log-{uuid.uuid4()}"
    for batch, kept in (("a", "model <> 'm2'"), ("a", "model <> 'm2'"), ("b", "model = 'm2'")):
        src.append_log(rows.filter(kept), path, batch)
    log = src.read_log(spark, path, schemas.ANSWER_LOG)
    return log.groupBy((F.col("model") != "m2").alias("first")).agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_seq"), F.min("seq").alias("low"), F.max("seq").alias("high"))


@query
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    # A conversation's first question, the last answers of three models, and two documents as what they go by.
    c = src.table(spark, d, "conversations")
    key = F.when(F.col("conv_id") % 3 == 1, " ").when(F.col("conv_id") % 3 == 2, F.concat(F.lit("key "), "conv_id"))
    asked = c.filter("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("q")).select(F.col("conv_id").cast("string").alias("id"), F.col("q.text").alias("question"), key.alias("answer_key"))
    answers = c.filter("role = 'assistant'").groupBy("conv_id", F.concat(F.lit("m"), F.col("turn") % 3).alias("model")).agg(F.max(F.struct("turn", "text")).alias("a"))
    given = c.filter("conv_id % 4 <> 0").select("conv_id").distinct().select("conv_id", F.posexplode(F.array(F.col("conv_id"), F.col("conv_id") + 1)).alias("at", "doc_id"))
    header = F.concat(F.upper("source"), F.lit(": "), "doc_id")
    sources = given.join(docs(spark, d), "doc_id").select(F.col("conv_id").cast("string").alias("id"), (F.col("at") + 1).alias("rank"), header.alias("header"), F.array("text").alias("bodies"), (1 + F.col("doc_id") % 2).alias("n_parts"))
    told = evaluation.judge_prompts(asked, answers.select(F.col("conv_id").cast("string").alias("id"), "model", F.col("a.text").alias("answer")), sources)
    return told.select("id", _labels(), "prompt")


def _labels():
    return F.transform(F.map_entries("labels"), lambda x: F.concat(x["key"], F.lit("="), x["value"])).alias("labels")


@query
def latest_logs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latest_answers(src.answer_log(spark, d)).select("id", "model", "seq", "latency_ms", "cited")


@query
def error_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.error_pairs(src.answer_log(spark, d))


@query
def todo_answers(spark: SparkSession, d: str) -> DataFrame:
    log = src.answer_log(spark, d)
    every = src.questions(spark, d).select(F.col("qid").cast("string").alias("id"))
    return evaluation.todo_answers(every, log.select("model").distinct(), log)


@query
def todo_judgments(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.todo_judgments(src.answer_log(spark, d), src.judgment_log(spark, d))


@query
def answer_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.answer_report(src.log_questions(spark, d), src.answer_log(spark, d), src.judgment_log(spark, d))


@query
def judge_batch(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.judge_batch(src.answer_log(spark, d)).select("id", _labels())


@query
def rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rank_percentiles(src.table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


# Data quality.


@query
def dq_questions(spark: SparkSession, d: str) -> DataFrame:
    q = src.evaluation_questions(spark, d)
    broken = q.select(
        (F.col("qid") - F.when(F.col("qid") % 10 == 9, 1).otherwise(0)).cast("string").alias("id"), F.when(F.col("qid") % 8 == 1, "other").otherwise(F.col("type")).alias("type"), "gold",
        F.when(F.col("qid") % 6 == 5, " ").otherwise(F.col("question")).alias("answer_key"),
    )
    return quality.check_questions(broken, docs(spark, d).filter("source <> 'src3'").select(F.col("source").alias("law_slug")))


@query
def dq_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = src.chunks(spark, d).withColumnRenamed("chunk_id", "id")
    doubled = c.filter("doc_id % 50 = 1").unionByName(c.filter("not (doc_id % 20 = 2 and part = 1)"))
    return quality.check_chunks(doubled)


@query
def dq_parse(spark: SparkSession, d: str) -> DataFrame:
    pages = src.table(spark, d, "pages")
    counted = pages.select("page_id", ingest.count_marks(F.col("html"), "<p").alias("n_articles"))
    pieces = pages.select("page_id", F.explode(F.split("html", "<p")).alias("piece"))
    articles = pieces.select("page_id", (F.length("piece") % 5 == 0).alias("abrogated"), F.array(F.when(F.length("piece") % 7 == 0, "").when(F.length("piece") % 11 == 0, "(la data").otherwise(F.col("piece"))).alias("units"))
    return quality.check_parse(articles, counted)
