"""BM25 over stored postings: blocks by falling impact with their maxima, and a search that leaves out what cannot win.

Three tables are built once from the token index:

* forward: a row for each chunk, its distinct terms in order with their counts, and its length;
* terms: a row for each term, its document frequency and idf;
* blocks: each term's postings (chunk, act, impact) by falling level of impact, about BLOCK of them a row, with the
  block's highest impact. A posting's impact is what one use of the term in a question adds to the chunk's score.

A search for the k best chunks of many questions at once:

1. Probe: the best blocks of each question's heaviest terms; the chunks of the highest sums get their exact score from
   forward. The k-th of them is a floor under the question's k-th score.
2. Prune: a question's terms stand in order, rarest first. A chunk whose first term lies in a block of bound b (the
   block's maximum plus the maxima of all later terms) scores b at most, so blocks with b below SHARE of the floor are
   never joined to their postings. The rest is summed by (question, chunk), combined before the shuffle. The k-th of these
   sums is a higher floor; what the left-out blocks could still add is known, and chunks that cannot reach the floor
   with it go.
3. Score: the chunks left get what terms with skipped blocks add from forward, and the k best are kept.

Sums are compared with SLACK, which is more than rounding to 6 places can move, so ranks and ties equal those of scoring
every posting. A term of negative idf has no upper bound above 0, and its least impact is taken off the floor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actmill.operators.lexical import B, K1, asked_terms, corpus_stats, idf_of, in_laws
from actmill.operators.storage import stored

#: Postings of a block, about; of a term that has one block only; levels of the others.
BLOCK, ONE_BLOCK, LEVELS = 1024, 128, 8
PROBE_TERMS, PROBE_POSTINGS, SHARE, SLACK = 8, 512, 0.5, 3e-6


@dataclass(frozen=True)
class Postings:
    forward: DataFrame
    terms: DataFrame
    blocks: DataFrame

    def write(self, path: str) -> None:
        """Blocks lie in order of their terms, so that a reader's term filter skips row groups."""
        self.forward.write.mode("overwrite").parquet(f"{path}/forward")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.blocks.repartitionByRange("term", "level").sortWithinPartitions("term", "level").write.mode("overwrite").parquet(f"{path}/blocks")


def read_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(*(spark.read.parquet(f"{path}/{name}") for name in ("forward", "terms", "blocks")))


def counted(tokens: Column) -> Column:
    """Distinct tokens in order with their counts: runs of the sorted array, inside the row."""
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    runs = lambda s, at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1)), lambda a, z: F.struct(F.get(s, a - 1).alias("term"), (z - a).alias("tf")))
    # Arrays of one element stand for values that are used more than once.
    whole = F.transform(F.array(F.array_sort(tokens)), lambda s: F.transform(F.array(starts(s)), lambda at: runs(s, at))[0])[0]
    return F.when(F.size(tokens) > 0, whole).otherwise(F.array().cast("array<struct<term: string, tf: int>>"))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def postings(index: DataFrame) -> Postings:
    """The three tables of a token index (chunk_id, chunk_pos, law_slug, tokens), written once."""
    keep = [c for c in index.columns if c != "tokens"]
    stats = corpus_stats(index)
    runs = index.select(*keep, F.size("tokens").alias("dl"), counted(F.col("tokens")).alias("runs")).crossJoin(F.broadcast(stats.select("avgdl")))
    forward = stored(runs.select(*keep, "dl", "avgdl", F.col("runs.term").alias("words"), F.col("runs.tf").alias("counts")))
    df = forward.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = stored(idf_of(df, stats))
    law = ["law_slug"] if "law_slug" in keep else []
    each = forward.select("chunk_id", *law, "dl", "avgdl", F.explode(F.arrays_zip("words", "counts")).alias("r")).select("chunk_id", *law, F.col("r.words").alias("term"), weight(F.col("r.counts"), F.col("dl"), F.col("avgdl")).alias("w"))
    # The level is of what the chunk alone decides; a level of many postings is cut further, by the chunk.
    level = F.lit(LEVELS - 1) - F.least(F.floor(F.col("w") / (K1 + 1) * LEVELS), F.lit(LEVELS - 1))
    cut = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("df") / BLOCK))
    level = F.when(F.col("df") <= ONE_BLOCK, 0).otherwise(level)
    dealt = each.join(terms, "term").select("term", level.cast("int").alias("level"), cut.alias("cut"), "chunk_id", *law, (F.col("w") * F.col("idf")).alias("impact"))
    blocks = dealt.groupBy("term", "level", "cut").agg(F.max("impact").alias("high"), F.min("impact").alias("low"), F.count("*").alias("n"), F.collect_list(F.struct("chunk_id", *law, "impact")).alias("entries"))
    return Postings(forward, terms, stored(blocks))


def _questions(questions: DataFrame, found: Postings, stems: bool, laws: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """(asked, heads): a row for each question and term with its bounds, and one for each of its blocks."""
    asked = asked_terms(questions, stems, laws)
    words = asked.select("term").distinct()
    heads = found.blocks.select("term", "level", "cut", "high", "low", "n").join(words, "term", "left_semi")
    tops = heads.groupBy("term").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    known = asked.join(found.terms, "term").join(tops, "term")
    later = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(1, Window.unboundedFollowing)
    up = F.greatest(F.col("qtf") * F.col("high"), F.lit(0.0))
    known = known.select(*asked.columns, "idf", up.alias("up"), F.least(F.col("qtf") * F.col("low"), F.lit(0.0)).alias("down"), F.coalesce(F.sum(up).over(later), F.lit(0.0)).alias("after"))
    return stored(known), stored(heads)


def _exact(pairs: DataFrame, asked: DataFrame, found: Postings) -> DataFrame:
    """pairs(qid, chunk_id, sure) with score and chunk_pos: sure and what the terms of asked add, unrounded."""
    use = asked.groupBy("qid").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("use"))
    both = pairs.join(use, "qid", "left").join(found.forward, "chunk_id")
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    # A term that the chunk has not got has no count, and adds nothing.
    tf = lambda u: F.get("counts", F.array_position("words", u["term"]).cast("int") - 1)
    more = F.aggregate("use", F.lit(0.0), lambda acc, u: acc + F.coalesce(u["w"] * (K1 + 1) / (1 + norm / tf(u)), F.lit(0.0)))
    return both.select("qid", "chunk_id", "chunk_pos", (F.col("sure") + F.coalesce(more, F.lit(0.0))).alias("score"))


def _sums(joined: DataFrame, part: Column) -> DataFrame:
    """Sums by question and chunk of rows with a block's entries, of the question's acts only."""
    rows = joined.select("*", F.explode("entries").alias("e"))
    if "laws" in rows.columns:
        rows = rows.filter(in_laws(F.col("laws"), F.col("e.law_slug")))
    return rows.groupBy("qid", F.col("e.chunk_id").alias("chunk_id")).agg(part.alias("part"))


def _floors(asked: DataFrame, heads: DataFrame, found: Postings, k: int) -> DataFrame:
    """(qid, floor): a k-th exact score among probed chunks, less what terms of negative idf may take; null below k chunks."""
    heavy = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("up").desc(), "term"))
    before = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("high").desc(), "level", "cut").rowsBetween(Window.unboundedPreceding, -1))
    best = heads.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < PROBE_POSTINGS).select("term", "level", "cut")
    probed = asked.withColumn("place", heavy).filter(F.col("place") <= PROBE_TERMS).drop("place").join(best, "term")
    sums = _sums(probed.join(found.blocks.select("term", "level", "cut", "entries"), ["term", "level", "cut"]), F.sum(F.col("qtf") * F.col("e.impact")))
    most = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("part").desc(), "chunk_id"))
    exact = _exact(sums.withColumn("place", most).filter(F.col("place") <= 2 * k).select("qid", "chunk_id", F.lit(0.0).alias("sure")), asked, found)
    # null where a question has fewer chunks than k
    floors = exact.groupBy("qid").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("floor"))
    return asked.select("qid").distinct().join(floors, "qid", "left")


def _bounded(asked: DataFrame, heads: DataFrame, floors: DataFrame) -> DataFrame:
    """A row for each question and block of its terms, with skipped: whether its bound stays below the question's share."""
    bound = F.greatest(F.col("qtf") * F.col("high"), F.lit(0.0)) + F.col("after")
    low = F.coalesce(bound < F.col("floor") * SHARE - SLACK, F.lit(False))
    return asked.join(floors, "qid").join(heads.select("term", "level", "cut", "high", "n"), "term").withColumn("skipped", low)


def pruned_search(questions: DataFrame, found: Postings, k: int = 30, laws: list[str] | None = None, stems: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank), row for row what lexical.bm25_search() gives."""
    asked, heads = _questions(questions, found, stems, laws)
    bounded = stored(_bounded(asked, heads, _floors(asked, heads, found, k)))
    left_out = bounded.filter("skipped").groupBy("qid", "term").agg(F.max(F.greatest(F.col("qtf") * F.col("high"), F.lit(0.0))).alias("missed"))
    missed = left_out.groupBy("qid").agg(F.sum("missed").alias("all_missed"))
    kept = bounded.filter("not skipped").join(left_out, ["qid", "term"], "left").join(found.blocks.select("term", "level", "cut", "entries"), ["term", "level", "cut"])
    impact = F.col("qtf") * F.col("e.impact")
    # Of terms without a skipped block all is known: sure. The others are looked up again in the chunks that stay.
    sure = F.sum(F.when(F.col("missed").isNull(), impact).otherwise(F.lit(0.0)))
    sums = stored(_sums(kept, F.struct(F.sum(impact).alias("found"), F.sum(impact - F.coalesce("missed", F.lit(0.0))).alias("over"), sure.alias("sure"))))
    # What is found may still fall by terms of negative idf that were left out.
    down = asked.groupBy("qid").agg(F.sum("down").alias("down"))
    most = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("part.found").desc()))
    higher = sums.withColumn("place", most).filter(F.col("place") == k).select("qid", F.col("part.found").alias("kth"))
    facts = bounded.select("qid", "floor").distinct().join(missed, "qid", "left").join(higher, "qid", "left").join(down, "qid")
    facts = facts.select("qid", F.coalesce("all_missed", F.lit(0.0)).alias("all_missed"), F.coalesce(F.greatest("floor", F.col("kth") + F.col("down")), F.lit(float("-inf"))).alias("floor"))
    pairs = sums.join(facts, "qid").filter(F.col("part.over") + F.col("all_missed") >= F.col("floor") - SLACK).select("qid", "chunk_id", F.col("part.sure").alias("sure"))
    scored = _exact(pairs, asked.join(left_out.select("qid", "term"), ["qid", "term"], "left_semi"), found).withColumn("score", F.round("score", 6)).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_pos"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")


def skipped_share(questions: DataFrame, found: Postings, k: int = 30, laws: list[str] | None = None, stems: bool = False) -> DataFrame:
    """(qid, blocks, skipped_blocks, postings, skipped_postings, share): what pruned_search() never joins, by question."""
    asked, heads = _questions(questions, found, stems, laws)
    bounded = _bounded(asked, heads, _floors(asked, heads, found, k))
    skipped = F.col("skipped").cast("int")
    out = bounded.groupBy("qid").agg(F.count("*").alias("blocks"), F.sum(skipped).alias("skipped_blocks"), F.sum("n").alias("postings"), F.sum(F.col("n") * skipped).alias("skipped_postings"))
    return out.withColumn("share", F.round(F.col("skipped_postings") / F.col("postings"), 6))
