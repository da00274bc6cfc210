from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actmill.functions import citations, refs, text
from actmill.operators import ann, evaluation, fusion, lexical, models, postings, quality, vectors


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Ce spune art. 145 din Codul muncii?", [("codul_muncii", "145")]),
        ("articolul 152^2 din codul muncii", [("codul_muncii", "152^2")]),
        ("art. 152 ind. 2 Legea 53/2003", [("codul_muncii", "152^2")]),
        ("art. 1 și art. 16, art 1 din Constituției", [("constitutia", "1"), ("constitutia", "16")]),
        ("art. 5", []),
        ("art. 5 din codul muncii și codul penal", []),
        ("art. 5 din 310/2004", []),
    ],
)
def test_references(spark, question, want):
    q = spark.createDataFrame([(1, question)], "qid long, question string").withColumn("plain", text.strip_diacritics(F.lower("question")))
    got = refs.detect_article_refs(q, "plain").orderBy("ref_pos").collect()
    assert [(r.law_slug, r.article) for r in got] == want


def corpus(spark):
    rows = [("c1", 1, "x", "a", 1, "concediu de odihnă plătit"), ("c2", 2, "x", "b", 1, "amendă pentru viteză"), ("c3", 3, "y", "c", 1, "concediu medical"), ("c4", 4, "y", "d", 1, "taxe")]
    return spark.createDataFrame(rows, "chunk_id string, chunk_pos long, law_slug string, article string, part int, text string")


def test_bm25_by_formula(spark):
    q = spark.createDataFrame([(1, "odihna concediu concediu"), (2, "de la")], "qid long, question string")
    got = {r.chunk_id: r.score for r in lexical.bm25_search(q, lexical.token_index(corpus(spark))).collect()}
    docs = {"c1": ["concediu", "odihna", "platit"], "c2": ["amenda", "viteza"], "c3": ["concediu", "medical"], "c4": ["taxe"]}
    avg = sum(map(len, docs.values())) / 4
    df = {t: sum(t in d for d in docs.values()) for t in {x for d in docs.values() for x in d}}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    score = lambda d: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("odihna", "concediu", "concediu") if t in d)
    want = {k: round(score(d), 6) for k, d in docs.items() if score(d) > 0}
    assert got == pytest.approx(want) and "c1" in got
    assert [r.chunk_id for r in lexical.bm25_search(q, lexical.token_index(corpus(spark)), laws=["y"]).collect()] == [k for k in want if k == "c3"]


def test_inflected_words_meet_on_stems(spark):
    q = spark.createDataFrame([(1, "taxelor"), (2, "amenda")], "qid long, question string")
    assert {r.qid for r in lexical.bm25_search(q, lexical.token_index(corpus(spark))).collect()} == {2}
    got = lexical.bm25_search(q, lexical.token_index(corpus(spark), stems=True), stems=True).collect()
    assert {(r.qid, r.chunk_id) for r in got} == {(1, "c4"), (2, "c2")}


def test_laws_filter_before_the_cut(spark):
    v = spark.createDataFrame([(i, i, [1.0, i / 100], "x" if i < 40 else "y") for i in range(50)], "id long, pos long, vector array<double>, law_slug string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert {r.id for r in vectors.vector_search(q, v, 5, ["y"]).collect()} == {45, 46, 47, 48, 49} or {r.id for r in vectors.vector_search(q, v, 5, ["y"]).collect()} == set(range(40, 45))
    chunks = corpus(spark)
    bm = spark.createDataFrame([(1, "c1", 9.0, 1), (1, "c3", 8.0, 2)], "qid long, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([(1, "concediu")], "qid long, question string")
    config = fusion.SearchConfig(use_vector=False, use_rerank=False)
    got = fusion.hybrid_search(asked, chunks, bm, None, None, config, laws=["y"]).collect()
    assert [(r.law_slug, r.article) for r in got] == [("y", "c")]
    # An explicit reference is found in any act, whatever the filter.
    pin = spark.createDataFrame([(1, 0, "x", "b")], "qid long, ref_pos int, law_slug string, article string")
    for own in ({"laws": ["y"]}, {}):
        each = asked if own else asked.withColumn("laws", F.array(F.lit("y")))
        got = fusion.hybrid_search(each, chunks, bm, None, pin, config, **own).orderBy("rank").collect()
        assert [(r.law_slug, r.article) for r in got] == [("x", "b"), ("y", "c")]
    with pytest.raises(ValueError):
        lexical.with_laws(each, ["y"])


def test_all_variants(spark):
    chunks, asked = corpus(spark), spark.createDataFrame([(1, "concediu medical")], "qid long, question string")
    bm = spark.createDataFrame([(1, "c1", 9.0, 1), (1, "c3", 8.0, 2)], "qid long, chunk_id string, score double, rank int")
    ve = spark.createDataFrame([(1, "c4", 0.9, 1), (1, "c3", 0.8, 2)], "qid long, chunk_id string, score double, rank int")
    pin = spark.createDataFrame([(1, 0, "x", "b")], "qid long, ref_pos int, law_slug string, article string")
    got = {}
    for r in fusion.sweep(asked, chunks, bm, ve, pin, models.overlap_scorer).orderBy("rank").collect():
        got.setdefault(r.variant, []).append(r.article)
    assert got == {"bm25": ["a", "c"], "vector": ["d", "c"], "hybrid": ["c", "a", "d"], "hybrid_weighted": ["c", "d", "a"], "vector_rerank": ["c", "d"], "hybrid_rerank": ["c", "a", "d"], "hybrid_rerank_refs": ["b", "c", "a", "d"]}


def test_judge_prompts(spark):
    q = spark.createDataFrame([("1", "cine?", "nimeni"), ("2", "ce?", None), ("3", "fara raspuns", "x")], "id string, question string, answer_key string")
    a = spark.createDataFrame([("1", "m1", "eu"), ("1", "m2", "tu"), ("2", "m1", None)], "id string, model string, answer string")
    s = spark.createDataFrame([("1", 2, "H2", ["b"], 1), ("1", 1, "H1", ["a"], 3)], "id string, rank int, header string, bodies array<string>, n_parts int")
    got = {r.id: (dict(r.labels), r.prompt) for r in evaluation.judge_prompts(q, a, s).collect()}
    assert "\n\n# Sources\n[1] H1 (extras)\na\n\n[2] H2\nb\n\n# Key\nnimeni\n\n# Answers\n\n## A\n" in got["1"][1] and "# Sources" not in got["2"][1]
    assert set(got) == {"1", "2"} and set(got["1"][0].values()) == {"m1", "m2"} and "m1" not in got["1"][1] and "nimeni" in got["1"][1]
    order = [got["1"][0][x] for x in "AB"]
    assert got["1"][1].index({"m1": "eu", "m2": "tu"}[order[0]]) < got["1"][1].index({"m1": "eu", "m2": "tu"}[order[1]]) and "# Key" not in got["2"][1]


def test_rrf(spark):
    r = spark.createDataFrame([(1, "a", 1, "m", 0, 1.0), (1, "b", 2, "m", 0, 1.0), (1, "c", 1, "n", 1, 1.0), (1, "b", 2, "n", 1, 1.0)], "qid long, chunk_id string, rank int, method string, method_pos int, weight double")
    got = fusion.reciprocal_rank_fusion(r).orderBy("fused_rank").collect()
    assert [(x.chunk_id, x.score) for x in got] == [("b", round(2 / 62, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 61, 9))]
    assert got[0].methods == ["m", "n"]


def test_hybrid_pins_and_groups(spark):
    chunks = corpus(spark).unionByName(spark.createDataFrame([("c5", 5, "x", "a", 2, "alt text")], corpus(spark).schema))
    q = spark.createDataFrame([(1, "concediu")], "qid long, question string")
    bm = spark.createDataFrame([(1, "c5", 9.0, 1), (1, "c3", 8.0, 2), (1, "c1", 7.0, 3)], "qid long, chunk_id string, score double, rank int")
    ve = spark.createDataFrame([(1, "c3", 0.9, 1)], "qid long, chunk_id string, score double, rank int")
    pin = spark.createDataFrame([(1, 0, "x", "b"), (1, 1, "x", "none")], "qid long, ref_pos int, law_slug string, article string")
    got = fusion.hybrid_search(q, chunks, bm, ve, pin, fusion.SearchConfig(use_rerank=False)).orderBy("rank").collect()
    assert [(r.article, r.explicit) for r in got] == [("b", True), ("c", False), ("a", False)]
    assert got[0].score == float("inf") and got[1].sources == ["bm25", "vector"] and got[2].parts == [1, 2]
    again = fusion.hybrid_search(q, chunks, bm, ve, None, fusion.SearchConfig(use_vector=False), models.overlap_scorer).orderBy("rank").collect()
    assert [r.article for r in again] == ["c", "a"] and again[0].score == 1.0


def unit_vectors(n, width, seed):
    m = np.random.default_rng(seed).normal(size=(n, width))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_vectors_exact_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, pos long, vector array<float>")
    q = c.filter("id < 7").select(F.col("id").alias("qid"), "vector")
    want = {i: [int(j) for j in np.lexsort((np.arange(60), -np.round(m.astype(np.float32).astype(float)[i] @ m.astype(np.float32).astype(float).T, 6)))[:5]] for i in range(7)}
    for size in (1 << 20, 8 * 8 * 4):  # one block, or four vectors each
        monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
        got = {}
        for r in vectors.vector_search(q, c.repartition(3), 5).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == want


def test_vector_search_plans_without_the_driver(spark):
    c = spark.range(10).select("id", F.col("id").alias("pos"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    vectors.vector_search(c.withColumnRenamed("id", "qid"), c, 3)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_vectors_of_distinct_keys_and_own_laws(spark, monkeypatch):
    m = unit_vectors(90, 6, 4)
    rows = [(i, i % 40, [float(x) for x in v], f"k{i % 11}" if i % 11 else None, f"law{i % 4}") for i, v in enumerate(m)]
    c = spark.createDataFrame(rows, "id long, pos long, vector array<double>, key string, law_slug string").unionByName(spark.createDataFrame([(99, 0, None, "k1", "law1")], "id long, pos long, vector array<double>, key string, law_slug string"))
    own = {0: None, 1: [], 2: ["law1", "law3", "none"], 3: ["none"]}
    q = spark.createDataFrame([(i, [float(x) for x in m[i]], own[i]) for i in own], "qid long, vector array<double>, laws array<string>")
    sims = np.round(m @ m.T, 6)

    def plain(i, k, by_key):
        out, seen = [], set()
        for j in sorted(range(90), key=lambda j: (-sims[i, j], j % 40)):
            if (not own[i] or f"law{j % 4}" in own[i]) and not (by_key and j % 11 in seen):
                seen.add(j % 11)
                out.append(j)
        return out[:k]

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 6 * 7)
    for key in (None, "key"):
        got = {}
        for r in vectors.vector_search(q, c, 7, key=key).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == {i: plain(i, 7, key) for i in own if plain(i, 7, key)}


def test_inverted_lists(spark, tmp_path):
    rng = np.random.default_rng(5)
    m = np.repeat(unit_vectors(12, 16, 6), 60, axis=0) + 0.4 * rng.normal(size=(720, 16))
    m = np.vstack([m, np.repeat(m[:1], 500, axis=0)])  # a crowd of one vector
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, pos long, vector array<double>")
    q = c.filter("id % 37 = 1").select(F.col("id").alias("qid"), "vector")
    exact = vectors.vector_search(q, c, 10)
    index = ann.build(c)
    assert index.centroids.agg(F.sum("size")).first()[0] == len(m) and index.lists.select(F.sum(F.size("ids"))).first()[0] == len(m)
    index.write(str(tmp_path / "index"))
    found = ann.search(q, c, ann.read_index(spark, str(tmp_path / "index")), 10)
    told = ann.recall(found, exact).collect()
    assert sum(r.hit for r in told) >= 0.9 * sum(r.n for r in told)
    assert {r["n"] for r in found.groupBy("qid").agg(F.count("*").alias("n")).collect()} == {10}
    # All lists probed, all rows scored again: the exact result.
    few = c.filter("id < 200")
    whole = ann.search(q, few, ann.build(few, 8), 50, probes=8)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, vectors.vector_search(q, few, 50).collect()))
    assert ann.search(q, c.filter("false"), ann.build(c.filter("false"))).count() == 0


def some_chunks(spark, n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(20_000)]
    rows = [(f"c{i}", i, f"law{i % 3}", f"a{i}", 1, " ".join(rng.choices(words, k=rng.choice((3, 20, 120))))) for i in range(n)]
    return spark.createDataFrame(rows, corpus(spark).schema), words


@pytest.mark.parametrize(("block", "one_block", "share"), [(1024, 128, 0.5), (4, 2, 1.0)])
def test_pruned_bm25_equals_all_postings(spark, monkeypatch, block, one_block, share):
    chunks, words = some_chunks(spark, 300, 8)
    rng = random.Random(9)
    asked = [(i, " ".join(rng.choices(words, k=rng.choice((1, 3, 12)))), [None, [], ["law1"]][i % 3]) for i in range(25)] + [(98, "nothing known", None), (99, "", None)]
    q = spark.createDataFrame(asked, "qid long, question string, laws array<string>")
    for name, value in (("BLOCK", block), ("ONE_BLOCK", one_block), ("SHARE", share), ("PROBE_POSTINGS", 16)):
        monkeypatch.setattr(postings, name, value)
    index = lexical.token_index(chunks)
    want = sorted(map(tuple, lexical.bm25_search(q, index, 7).collect()))
    made = postings.postings(index)
    assert sorted(map(tuple, postings.pruned_search(q, made, 7).collect())) == want
    told = postings.skipped_share(q, made, 7).collect()
    assert len(told) == 25 and sum(r.skipped_postings for r in told) > 0


def test_pruned_bm25_with_terms_in_most_chunks_and_stored(spark, tmp_path):
    rows = [(f"c{i}", i, "x", "a", 1, "often " + "often " * (i % 5) + ("rare " if i % 17 == 0 else "") + f"own{i}") for i in range(60)]
    index = lexical.token_index(spark.createDataFrame(rows, corpus(spark).schema))
    q = spark.createDataFrame([(1, "often rare own3"), (2, "often"), (3, "own5 often often")], "qid long, question string")
    made = postings.postings(index)
    made.write(str(tmp_path / "p"))
    got = postings.pruned_search(q, postings.read_postings(spark, str(tmp_path / "p")), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25_search(q, index, 4).collect()))


def test_report_counts_dropped_pairs(spark):
    q = spark.createDataFrame([("1", "natural", ["x:1"]), ("2", "trap", ["x:2"])], "id string, type string, gold array<string>")
    log = spark.createDataFrame([("1", "a", 10, 5, ["x:1"], [], None, 1), ("2", "a", 30, 5, [], [], "quota", 2)], "id string, model string, latency_ms long, output_tokens long, cited array<string>, invalid_citations array<int>, error string, seq long")
    s = {"correctness": 2, "faithful": True, "refused": False}
    judged = spark.createDataFrame([("1", {"a": s, "b": s}, 1), ("2", {"a": s}, 2), ("9", {"a": s}, 3)], "id string, scores map<string, struct<correctness: int, faithful: boolean, refused: boolean>>, seq long")
    assert {r.model: (r.n, r.dropped, r.errors) for r in evaluation.answer_report(q, log, judged).collect()} == {"a": (1, 2, 1), "b": (0, 1, 0)}


def test_citations(spark):
    df = spark.createDataFrame([("vezi [2] și [1], iar [7] [2]", 3)], "t string, n int")
    r = df.select(citations.valid_citations(F.col("t"), F.col("n")).alias("ok"), citations.invalid_citations(F.col("t"), F.col("n")).alias("bad")).first()
    assert list(r.ok) == [2, 1] and list(r.bad) == [7]
    a = spark.createDataFrame([(1, "Potrivit art. 228, art. 22 și articolul 152^2")], "id long, text string")
    h = spark.createDataFrame([(1, 1, "228"), (1, 2, "22"), (1, 3, "229"), (1, 4, "152^2"), (1, 5, "152")], "id long, n int, article string")
    assert list(citations.infer_cited(a, h).first().cited) == [1, 2, 4]
    q = spark.createDataFrame([(1, "ce?"), (2, "nu")], "qid long, question string")
    s = spark.createDataFrame([(1, 1, "H1", ["b1", "b2"], 2), (1, 2, "H2", ["c"], 3)], "qid long, rank int, header string, bodies array<string>, n_parts int")
    assert citations.build_prompts(q, s).first().prompt == "SURSE:\n\n[1] H1\nb1\nb2\n\n[2] H2 (extras)\nc\n\n---\nÎNTREBARE: ce?"
    assert [r.qid for r in citations.unanswered(q, s).collect()] == [2]


def test_metrics(spark):
    q = spark.createDataFrame([(1, ["a:1", "b:2"], "natural"), (2, ["c:3"], "natural"), (3, ["d:4"], "trap"), (4, ["e:5"], "trap")], "qid long, gold array<string>, type string")
    hits = spark.createDataFrame([(1, 1, "b:2"), (1, 2, "a:1"), (2, 3, "c:3"), (4, 2, "e:5"), (3, 1, "x:9")], "qid long, rank int, key string")
    ranked = evaluation.first_gold_rank(q, hits).withColumn("variant", F.lit("v"))
    assert {r.qid: r["rank"] for r in ranked.collect()} == {1: 1, 2: 3, 3: None, 4: 2}
    m = evaluation.metrics(ranked, ["variant"]).first()
    assert (m.recall_1, m.recall_3, m.recall_10, m.mrr) == (0.25, 0.75, 0.75, round((1 + 1 / 3 + 1 / 2) / 4, 6))
    assert {(r.type, r.n) for r in evaluation.metrics_by_type(ranked).collect()} == {(None, 4), ("natural", 2), ("trap", 2)}
    assert sorted(r.qid for r in evaluation.misses(ranked, "v").collect()) == [2, 3, 4]


def test_logs(spark):
    log = spark.createDataFrame([("1", "a", 10, None, 1), ("1", "a", 30, None, 2), ("1", "b", 5, "x", 3), ("2", "b", 7, "x", 4), ("2", "b", 8, None, 5)], "id string, model string, latency_ms long, error string, seq long")
    assert {(r.id, r.model, r.latency_ms) for r in evaluation.latest_answers(log).collect()} == {("1", "a", 30), ("2", "b", 8)}
    assert {(r.model, r.errors) for r in evaluation.error_pairs(log).collect()} == {("b", 2)}
    q, m = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("a",), ("b",)], "model string")
    assert {(r.id, r.model) for r in evaluation.todo_answers(q, m, log).collect()} == {("1", "b"), ("2", "a")}
    judged = spark.createDataFrame([("1", {"a": 1}, 1), ("2", {"a": 1}, 1)], "id string, scores map<string,int>, seq long")
    assert [r.id for r in evaluation.todo_judgments(log, judged).collect()] == ["2"]
    assert {r.id: dict(r.labels) for r in evaluation.judge_batch(log).collect()} == {"1": {"A": "a"}, "2": {"A": "b"}}
    p = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 5), ("h", None)], "k string, v int")
    assert {r.k: (r.p50, r.p90) for r in evaluation.rank_percentiles(p, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()} == {"g": (3, 4), "h": (5, 5)}


def test_percentiles_by_bins(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice((rng.random(), 0.5, rng.randrange(9)))) for _ in range(6000)] + [(None, rng.random()) for _ in range(700)] + [("one", 2.0), ("none", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    places = {"low": 0.0, "p50": 0.5, "p90": 0.9, "high": 0.9999}
    want = {}
    for key in ("hot", None, "one"):
        values = sorted(v for k, v in rows if k == key)
        want[key] = tuple(values[int(len(values) * q)] for q in places.values())
    got = evaluation.rank_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", places).collect()
    assert {r.k: (r.low, r.p50, r.p90, r.high) for r in got} == want


def test_question_checks(spark):
    q = spark.createDataFrame([("1", "natural", ["x:1"], "k"), ("1", "odd", ["z:1"], "k"), ("2", "trap", [], " ")], "id string, type string, gold array<string>, answer_key string")
    got = {(r.id, r.problem) for r in quality.check_questions(q, spark.createDataFrame([("x",)], "law_slug string")).collect()}
    assert got == {("1", "repeated id"), ("1", "unknown type"), ("2", "gold against type"), ("1", "unknown act"), ("2", "empty answer key")}
