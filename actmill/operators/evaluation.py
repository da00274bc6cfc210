"""Retrieval metrics, variant sweeps, answer logs and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.functions.citations import format_source
from actmill.operators.vectors import vector_search

K_VALUES = (1, 3, 5, 10)
MOST_MODELS = 1_000
#: Bins of a group, of about as many rows each, among which a percentile is looked up.
BINS = 64


def rank_percentiles(df: DataFrame, keys: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """(*keys, *places): the sorted value at place floor(n * q) from 0, q below 1, so the upper of two middle values at 0.5.

    Values (numbers, dates or times) are counted by (keys, value) first, combined before the shuffle. Approximate
    quantiles only choose where each group's values are cut into BINS bins; the counts of the bins tell the few that hold
    a wanted place, and only their values are ordered, bin by bin. So no task orders a whole group, and results are exact.
    Nulls are left out; a null key is a group.
    """
    known = df.filter(F.col(value).isNotNull())
    counted = known.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cuts = known.groupBy(*keys).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 10 * BINS).alias("_cuts"))
    binned = _joined(counted, cuts, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda x: x <= F.col(value)))).drop("_cuts")
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_held").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_held")).withColumns({"_before": before, "_n": F.sum("_held").over(group)})
    place = lambda q: F.floor(F.col("_n") * q)
    holds = [(place(q) >= F.col("_before")) & (place(q) < F.col("_before") + F.col("_held")) for q in places.values()]
    near = _joined(binned, bins.filter(reduce(Column.__or__, holds)), [*keys, "_bin"])
    run = F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    hit = lambda q: F.min(F.when(F.col("_upto") > place(q), F.col(value)))
    return near.withColumn("_upto", F.col("_before") + run).groupBy(*keys).agg(*(hit(q).alias(name) for name, q in places.items()))


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys, a null key equal to a null key."""
    named = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_of_{k}" for k in keys))


def first_gold_rank(questions: DataFrame, hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """questions with rank: the first hit whose key is in gold, null where none is. hits(*keys, rank, key)."""
    keys = keys or ["qid"]
    gold = questions.select(*keys, F.explode("gold").alias("key"))
    best = hits.join(gold, [*keys, "key"]).groupBy(*keys).agg(F.min("rank").alias("rank"))
    return questions.join(best, keys, "left")


def recall(k: int) -> Column:
    return F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)


def mrr() -> Column:
    return F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6)


def metrics(ranked: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), *(recall(k).alias(f"recall_{k}") for k in K_VALUES), mrr().alias("mrr"))


def metrics_by_type(ranked: DataFrame) -> DataFrame:
    """By variant, and by variant and type, in one pass: grouping sets. type is null for the total."""
    return ranked.groupingSets([["variant"], ["variant", "type"]], "variant", "type").agg(F.count("*").alias("n"), recall(5).alias("recall_5"), mrr().alias("mrr"))


def detail_rows(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """(variant, qid, type, rank, top5)."""
    top = hits.filter("rank <= 5").groupBy("variant", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("t"))
    return ranked.join(top.select("variant", "qid", F.col("t.key").alias("top5")), ["variant", "qid"], "left").select("variant", "qid", "type", "rank", F.coalesce("top5", F.array().cast("array<string>")).alias("top5"))


def misses(ranked: DataFrame, variant: str) -> DataFrame:
    """Rows of a variant that are not first; questions without a hit are among them."""
    return ranked.filter((F.col("variant") == variant) & ~F.col("rank").eqNullSafe(1)).select("qid", "type", "rank")


def latest_answers(log: DataFrame) -> DataFrame:
    """The last answer without an error of each (id, model); an aggregate, combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("id", "model")]
    last = log.filter("error is null").groupBy("id", "model").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return last.select("id", "model", *(F.col(f"r.{c}") for c in rest))


def latest_judgments(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", *(F.col(f"r.{c}") for c in rest))


def error_pairs(log: DataFrame) -> DataFrame:
    """(model, errors): pairs of question and model that ever failed."""
    return log.filter("error is not null").select("id", "model").distinct().groupBy("model").agg(F.count("*").alias("errors"))


def todo_answers(questions: DataFrame, models: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs without an answer. models is a short list: it is checked to have MOST_MODELS rows at most."""
    names = [r[0] for r in models.select("model").distinct().limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    done = log.filter("error is null").select("id", "model")
    pairs = questions.select("id", F.explode(F.array(*map(F.lit, sorted(names))).cast("array<string>")).alias("model"))
    return pairs.join(done, ["id", "model"], "left_anti")


def todo_judgments(log: DataFrame, judged: DataFrame) -> DataFrame:
    """Questions whose answering models are not just those judged last."""
    answered = log.filter("error is null").groupBy("id").agg(F.array_sort(F.collect_set("model")).alias("answered"))
    last = latest_judgments(judged).select("id", F.array_sort(F.map_keys("scores")).alias("known"))
    return answered.join(last, "id", "left").filter(~F.col("answered").eqNullSafe(F.col("known"))).select("id", "answered")


def answer_report(questions: DataFrame, log: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each judged model; null where a group is empty.

    A judged pair without an answer, or whose question is not known, is in no figure but dropped, which counts them; a
    model with no other pairs has n 0.
    """
    scores = latest_judgments(judged).select("id", F.explode("scores").alias("model", "s"))
    rows = scores.join(latest_answers(log).select("id", "model", "latency_ms", "output_tokens", "cited", "invalid_citations"), ["id", "model"]).join(questions.select("id", "type", "gold"), "id")
    answerable = F.size("gold") > 0
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    mean = lambda c, where=None: F.round(F.avg(c if where is None else F.when(where, c)), 6)
    facts = rows.groupBy("model").agg(
        F.count("*").alias("n"), mean(F.col("s.correctness") / 2).alias("score"), mean(yes(F.col("s.correctness") == 2)).alias("fully_correct"),
        mean(yes(F.col("s.faithful"))).alias("faithful"), mean(yes(F.arrays_overlap("cited", "gold")), answerable).alias("cites_gold"),
        mean(yes(F.col("s.refused")), ~answerable).alias("correct_refusals"), mean(yes(F.col("s.refused")), answerable & (F.col("type") != "trap")).alias("false_refusals"),
        mean(yes(F.col("s.correctness") == 2), F.col("type") == "trap").alias("traps"), F.sum(F.size("invalid_citations")).alias("invalid_citations"),
        mean(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    spread = rank_percentiles(rows, ["model"], "latency_ms", {"p50": 0.5, "p90": 0.9})
    every = scores.groupBy("model").agg(F.count("*").alias("judged"))
    out = every.join(facts, "model", "left").join(spread, "model", "left").join(error_pairs(log), "model", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("dropped", F.col("judged") - F.col("n")).drop("judged")
    return out.withColumns({"latency_p50_s": F.col("p50") / 1000, "latency_p90_s": F.col("p90") / 1000, "errors": F.coalesce("errors", F.lit(0))}).drop("p50", "p90")


def judge_batch(log: DataFrame) -> DataFrame:
    """(id, labels): the answering models of a question under letters, in an order that a hash of both fixes."""
    lettered = _lettered(latest_answers(log).select("id", "model"))
    return lettered.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "model")))).alias("labels"))


def judge_prompts(questions: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, labels, prompt): one request for each question, with the answers under letters in place of model names.

    questions has id, question and answer_key (what a right answer says; null where none is known), answers has id, model
    and answer, sources has id, rank, header, bodies and n_parts, as prompts have them: what the answers were given to go
    by. Questions without an answer have no row; one without sources has none in its prompt.
    """
    lettered = _lettered(answers.select("id", "model", "answer"))
    per = lettered.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "model", "answer"))).alias("a"))
    source = format_source(F.col("rank"), F.col("header"), F.col("bodies"), F.col("n_parts"))
    given = sources.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", source.alias("source")))).alias("s"))
    named = per.join(questions.select("id", "question", "answer_key"), "id").join(given, "id", "left")
    shown = F.array_join(F.transform("a", lambda x: F.concat(F.lit("## "), x["label"], F.lit("\n"), F.coalesce(x["answer"], F.lit("")))), "\n\n")
    part = lambda head, text, where: F.when(where, F.concat(F.lit(f"# {head}\n"), text, F.lit("\n\n"))).otherwise("")
    prompt = F.concat(
        part("Question", F.col("question"), F.lit(True)), part("Sources", F.array_join("s.source", "\n\n"), F.col("s").isNotNull()),
        part("Key", F.col("answer_key"), F.coalesce(F.trim("answer_key") != "", F.lit(False))), F.lit("# Answers\n\n"), shown,
    )
    return named.select("id", F.map_from_arrays("a.label", "a.model").alias("labels"), prompt.alias("prompt"))


def compare_models(vectors: DataFrame, asked: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """(model, n, recall_1 ... recall_10, mrr, dim): embedding models by exact search alone.

    vectors has model, id, pos, key (of the article) and vector, asked has model, qid and vector, questions has qid and
    gold (keys). A question's k hits are distinct articles: the cut falls after each article's best chunk was chosen, in
    the search itself. models are a short list, checked to have MOST_MODELS rows at most.
    """
    dims = vectors.groupBy("model").agg(F.max(F.size("vector")).alias("dim")).limit(MOST_MODELS + 1).collect()
    if len(dims) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    out = []
    for model, dim in sorted(dims):
        rows, own = vectors.filter(F.col("model") == model), asked.filter(F.col("model") == model)
        hits = vector_search(own.select("qid", "vector"), rows.select("id", "pos", "key", "vector"), k, key="key")
        ranked = first_gold_rank(questions.join(own.select("qid"), "qid", "left_semi"), hits)
        out.append(metrics(ranked.withColumn("model", F.lit(model)), ["model"]).withColumn("dim", F.lit(dim)))
    return reduce(DataFrame.unionByName, out)


def _lettered(answers: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.sha2(F.concat_ws(":", "id", "model"), 256), "model"))
    return answers.withColumn("label", F.chr(F.lit(64) + place))
