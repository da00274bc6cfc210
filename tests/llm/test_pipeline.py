"""The pipeline's stages on the smallest tables, and on odd rows."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from actmill.llm import decontam, langid, linededup, omh

SF = "/root/testdata/sf0.001"


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by = dict(corpus_pipeline.STAGES)
    first = by["language"](spark, docs, SF).cache()
    assert first.columns == columns and first.count() >= docs.count() - 1
    second = by["line_dedup"](spark, first, SF).cache()
    want = {r.doc_id: r.text for r in linededup.lines_deduplicated(first).collect() if r.n_deleted == 0 or r.text}
    assert {r.doc_id: r.text for r in second.collect()} == want and second.columns == columns
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = by["near_duplicates"](spark, second, SF).cache()
    classes = {r.doc_id: r.class_id for r in omh.near_duplicate_classes(second).collect()}
    assert sorted(r.doc_id for r in third.collect()) == sorted(set(classes.values())) and third.columns == columns
    fourth = by["decontamination"](spark, third, SF).cache()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r.doc_id for r in decontam.contained_items(third, items).collect() if r.contaminated}
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - found and fourth.columns == columns
    last = by["tokens"](spark, fourth, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in fourth.collect()) and all(r.n_tokens == len(r.ids) for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in last)


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    words = "the quick brown fox jumps over a lazy dog and runs far away from all the others in the long night"
    rows = [(1, words, "en", "s", 0, 1), (1, words, "en", "s", 0, 1), (2, None, None, None, None, None), (3, "", "en", None, 0, 2), (None, words + " again", None, "s", None, 3), (5, "...", "en", "s", 3, 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "tokens" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert [r.doc_id for r in docs.collect()] in ([1], [])


def test_language_stage_learns_from_all_rows(spark, monkeypatch):
    """The models that the stage rejects by are calibrated on every text of the learning folds."""
    rng = random.Random(21)
    rows = [(i, " ".join("".join(rng.choices("abcdef", k=rng.randrange(2, 7))) for _ in range(rng.randrange(1, 12))), "x", "s", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    models = []
    monkeypatch.setattr(corpus_pipeline, "fit", lambda train: models.append(langid.fit(train)) or models[-1])
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, docs, SF).collect()}
    texts = sorted({r.text for r in docs.filter(langid.fold(4) != 2).collect()})
    h, n = models[0].entropies(texts)
    assert len(texts) > 4000 and abs(models[0].mean[0] - np.average(h[:, 0], weights=np.sqrt(np.minimum(n, langid.LONG)))) < 1e-6
    assert kept == {i for (i, *_), out in zip(rows, models[0].predict([t for _, t, *_ in rows])[2], strict=True) if not out}


def test_small_tables_take_few_tasks(spark):
    """Many steps over few rows: models and components start few tasks, however many partitions a shuffle has."""
    tracker, partitions = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def tasks(group: str, run) -> int:
        spark.sparkContext.setJobGroup(group, group)
        run()
        infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return sum(x.numCompletedTasks for x in infos if x)

    links = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 40)], "hub long, key long, likeness double").coalesce(1)
    counts = spark.createDataFrame([("x", i * 7919 % 65536 << 16 | i % 11, 1 + i % 3) for i in range(300)], "lang string, gram long, n long").coalesce(1)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = []
        assert tasks("components", lambda: found.extend(omh.components(links).collect())) < 101
        assert {r.class_key for r in found} == {1} and len(found) == 40
        assert tasks("models", lambda: langid.model_rows(counts)[0].collect()) < 5 * 101
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_model_steps_have_small_plans(spark, monkeypatch):
    """No step of the models plans the steps before it again: the driver's memory goes with the size of a plan."""
    plans = []
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    cut = langid.checkpointed
    monkeypatch.setattr(langid, "checkpointed", lambda df: plans.append(size(df)) or cut(df))
    counts = spark.createDataFrame([("x", i * 7919 % 65536 << 16 | i % 11, 1 + i % 3) for i in range(300)], "lang string, gram long, n long")
    rows, unseen, _ = langid.model_rows(counts)
    plans.append(size(rows))
    assert set(unseen) == {"x"} and {r.kind for r in rows.select("kind").distinct().collect()} == set(range(langid.KINDS))
    assert max(plans) < 60, plans
