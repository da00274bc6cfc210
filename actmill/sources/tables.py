"""Readers and writers with explicit schemas, and views of the shared tables in our schemas."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actmill import schemas
from actmill.operators.chunking import chunk_articles, chunk_text, once
from actmill.operators.snapshot import Files
from actmill.operators.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than cores dealt over all cores by key; a larger one as it is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def read_pages(spark: SparkSession, html_glob: str, meta_glob: str) -> DataFrame:
    """PAGE_META columns and html: whole files joined with their JSON by slug, the file name up to the first dot.

    A page without JSON stays, with nulls in all other columns.
    """
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)
    html = spark.read.text(html_glob, wholetext=True).select(slug.alias("slug"), F.col("value").alias("html"))
    meta = spark.read.schema(schemas.PAGE_META).json(meta_glob, multiLine=True)
    return html.join(meta, "slug", "left").select(*meta.columns, "html")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of articles, chunks or questions; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines, batches and loose files alike; empty where it does not exist yet. seq orders its rows."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_log(df: DataFrame, path: str, batch: str) -> bool:
    """Add a batch of rows once: a batch of the same name that is there whole already adds nothing (False).

    The batch is a folder of its own, which counts when its job has ended; one left by a job that failed is written over.
    seq continues from the log's highest, without gaps, in the order of the rows as given; a seq of df gives way to it.
    One batch is added at a time: two jobs that append at once would number from the same place.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ . and -")
    if Files(spark, path).exists(f"batch-{batch}/_SUCCESS"):
        return False
    last = read_log(spark, path, "seq BIGINT").agg(F.max("seq")).first()[0]
    seated = stored(df.drop("seq").withColumn("_seat", F.monotonically_increasing_id()))
    part = F.shiftright("_seat", 33)
    counts = seated.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition of the batch.
    placed = seated.withColumn("_part", part).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    seq = F.lit(-1 if last is None else last) + 1 + F.col("_before") + F.col("_seat").bitwiseAND(F.lit((1 << 33) - 1))
    placed.withColumn("seq", seq).drop("_seat", "_part", "_n", "_before").write.mode("overwrite").json(f"{path}/batch-{batch}")
    return True


def write_metrics(metrics: DataFrame, details: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    details.write.mode("overwrite").json(f"{path}/details")


# Views of the shared tables.


def articles(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Each document as an article of the act named by its source, its lines as units; doc_id is carried along.

    only(doc_id) are the documents that are wanted, of all otherwise.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    d = spread(d, "doc_id") if only is None else d.join(only.select("doc_id"), "doc_id", "left_semi")
    units = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    name = F.upper("source")
    return d.select(
        "doc_id", F.col("source").alias("law_slug"), name.alias("law_name"), name.alias("law_ref"), F.col("doc_id").cast("string").alias("number"), F.lit("").alias("title"),
        F.array("lang").alias("hierarchy"), units.alias("units"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"), F.lit(None).cast("string").alias("consolidation_date"),
        F.lit(False).alias("abrogated"),
    )


def chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Chunks of the articles, with chunk_id, text and chunk_pos: corpus order by document and part."""
    rows = chunk_articles(articles(spark, sf_dir, only)).withColumn("text", chunk_text())
    return rows.withColumnRenamed("id", "chunk_id").withColumn("chunk_pos", F.struct("doc_id", "part"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def gold_pairs(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id) where the document's text contains the question's.

    Five words inside a question, from the second on, are whole words wherever it stands; documents are found by that
    run of words, one key each, and then checked. Questions of fewer than seven words are checked against all documents.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    # Each word is hashed once; a run's key is a hash of its words' hashes.
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    run = lambda h, i: F.xxhash64(*(F.get(h, i + n) for n in range(5)))
    q = asked.withColumn("w", words(F.col("question")))
    keyed = q.filter(F.size("w") >= 7).select("qid", "question", run(hashes(F.col("w")), F.lit(1)).alias("run"))
    runs = once(hashes(words(F.col("text"))), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 5, F.lit(0))), lambda i: run(h, i)))
    spread = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    near = spread.join(keyed, "run").select("qid", "question", "doc_id").distinct()
    long = near.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "question"))
    short = docs.join(q.filter(F.size("w") < 7), F.contains("text", "question"))
    return long.select("qid", "doc_id").unionByName(short.select("qid", "doc_id"))


def evaluation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question, gold, type): gold are the articles that contain the passage."""
    asked, docs = questions(spark, sf_dir), spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    keys = docs.select("doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key"))
    gold = gold_pairs(asked, docs.select("doc_id", "text")).join(keys, "doc_id").groupBy("qid").agg(F.array_sort(F.collect_set("key")).alias("gold"))
    out = asked.join(gold, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    return out.withColumn("type", F.when(F.size("gold") > 0, "natural").otherwise("unanswerable"))


def document_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(id, pos, law_slug, vector): a document's vector for each of its chunks, where it has one. rows are chunks made before."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    rows = chunks(spark, sf_dir, v) if rows is None else rows
    parts = rows.select("doc_id", F.col("chunk_id").alias("id"), F.col("chunk_pos").alias("pos"), "law_slug")
    return parts.join(v, "doc_id").select("id", "pos", "law_slug", "vector")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return v.join(questions(spark, sf_dir).select("qid"), "qid", "left_semi")


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as an answer log: models by doc_id, a first failed try for some, and a later second answer for others."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    tries = lab.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")).filter("t = 0 or (doc_id % 5 = 0 and t = 1) or (doc_id % 11 = 0 and t = 2)")
    failed = (F.col("t") == 0) & (F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 13 == 0)
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return tries.select(
        (F.col("doc_id") % 97).cast("string").alias("id"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"),
        (F.col("n_chars") + F.col("t")).alias("latency_ms"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 1000).alias("output_tokens"),
        F.when(F.col("doc_id") % 2 == 0, F.array(key)).otherwise(F.array().cast("array<string>")).alias("cited"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>")).alias("invalid_citations"),
        F.when(failed, "quota").alias("error"), (F.col("doc_id") * 3 + F.col("t")).alias("seq"),
    )


def judgment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgments: each question's models with quality as correctness and toxic as refusal; some judged twice."""
    lab = table(spark, sf_dir, "labels").filter("doc_id % 17 <> 0")
    rows = lab.select((F.col("doc_id") % 97).cast("string").alias("id"), F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), "doc_id", "quality", "toxic", (F.col("doc_id") % 2).alias("round"))
    one = rows.groupBy("id", "round", "model").agg(F.max_by(F.struct("quality", "toxic", "doc_id"), "doc_id").alias("v"))
    score = F.struct((F.col("v.quality") * 2 - F.col("v.doc_id") % 2 * F.col("v.quality")).cast("int").alias("correctness"), (F.col("v.toxic") == 0).alias("faithful"), (F.col("v.toxic") == 1).alias("refused"))
    per = one.groupBy("id", "round").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model"), score.alias("s"))))).alias("scores"))
    return per.select("id", "scores", F.col("round").alias("seq"))


def log_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, gold) of the questions of both logs: gold from the labelled documents of the same remainder."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    good = F.when(F.col("quality") == 1, F.concat_ws(":", "source", F.col("doc_id").cast("string")))
    per = lab.filter("doc_id % 97 <> 3").groupBy((F.col("doc_id") % 97).alias("r")).agg(F.array_sort(F.collect_set(good)).alias("gold"))
    gold = F.when(F.col("r") % 6 == 0, F.array().cast("array<string>")).otherwise(F.col("gold"))
    kind = F.when(F.col("r") % 6 == 0, "unanswerable").when(F.col("r") % 6 == 1, "trap").otherwise("natural")
    return per.select(F.col("r").cast("string").alias("id"), kind.alias("type"), gold.alias("gold"))


def scripted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): a document's text with references to articles and acts put before it, by doc_id."""
    from actmill.functions.refs import LAWS

    d = table(spark, sf_dir, "documents")
    alias = F.element_at(F.array(*(F.lit(law[4][-1].upper()) for law in LAWS)), (F.col("doc_id") % 6 + 1).cast("int"))
    other = F.when(F.col("doc_id") % 7 == 0, F.lit(" și Codul Penal")).otherwise("")
    number = F.concat(F.lit("Art. "), F.col("doc_id") % 400, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ind. "), F.col("doc_id") % 4)).otherwise(""), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(", articolul "), F.col("doc_id") % 31, F.lit("^2"))).otherwise(""))
    law = F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.concat(F.lit(" din "), alias))
    return d.select(F.col("doc_id").alias("qid"), F.concat_ws(" ", F.concat(number, law, other), "text").alias("question"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, n_sources): assistant turns with markers and article mentions put behind them."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    mark = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" ["), F.col("turn") % 6, F.lit("] [2] [9] [2]")))
    text = F.concat(F.col("text"), mark, F.lit(" vezi art. "), (F.length("text") % 50).cast("string"), F.when(F.col("turn") % 4 == 0, "^1").otherwise(""), F.lit(" si articolul "), F.col("turn"))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), text.alias("text"), (F.col("turn") % 5).cast("bigint").alias("n_sources"), "turn", F.length("text").alias("len"))


def answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, article): four sources for each answer."""
    a = answers(spark, sf_dir)
    found = F.array((F.col("len") % 50).cast("string"), F.concat((F.col("len") % 50).cast("string"), F.lit("^1")), F.col("turn").cast("string"), (F.col("len") % 7).cast("string"))
    return a.select("id", F.posexplode(found).alias("n0", "article")).select("id", (F.col("n0") + 1).alias("n"), "article")
