"""Merkle manifests and Feistel shards against plain versions, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actmill.llm import merkle, sharding

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, `group` int, shard string, held int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text) -> str:
    return h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_report(rows: list) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = levels([leaf(r, r.text) for r in groups[s]])
    top, out = levels([trees[s][-1][0] for s in names]), []
    for place, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            fold, beside = leaf(r, r.text.replace("\n", "") if touched else r.text), []
            for tree, k in ((trees[s], i), (top, place)):
                for level in tree[:-1]:
                    first = k // 3 * 3
                    left, right = level[first:k], level[k + 1 : first + 3]
                    beside += left + right
                    fold = h(*left, fold, *right)
                    k //= 3
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], h(*beside), fold, fold == top[-1][0]))
    return out


CASES = [
    (None, None, None, None, None, 1, 1, "s", 1), (1, None, "a", 3, "a\nb", 1, 1, "s", 1), (1, None, "a", 3, "a\nb", 1, 1, "s", 1), (1, "x", "a", 3, "", 1, 1, None, 1),
    (2, "", "é", 3, "ü\n", 1, 1, "s", 1), (2, "-", "é", 3, "ü\n" * 3000, 1, 1, "s", 1), *((i % 7, "hot", "q", i, f"t\n{i % 3}", 0, 0, "s", 1) for i in range(40)),
    *((9, "same", "q", 5, "one\ntext", 0, 0, "s", 1) for _ in range(11)),
]


def test_manifest_with_odd_rows(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    got = merkle.tampering_report(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_report(df.collect())))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame(CASES[3:4], SCHEMA)
    assert list(map(tuple, merkle.tampering_report(one).collect())) == plain_report(one.collect())
    assert merkle.tampering_report(one.filter("false")).count() == 0


def test_manifest_of_many_groups_does_not_depend_on_partitions(spark):
    rows = [(i, f"s{i % 29}" if i % 4 else None, "l", i, f"text {i}\n", 0, 0, "", 0) for i in range(400)]
    want = sorted(map(repr, plain_report(spark.createDataFrame(rows, SCHEMA).collect())))
    for n in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        assert sorted(map(repr, map(tuple, merkle.tampering_report(df).collect()))) == want


def test_proofs_fold_to_the_root_and_a_changed_field_does_not(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    of = merkle.leaf(F.col("doc_id"), F.col("text"))
    told = merkle.manifest(df, F.col("source"), [F.col("doc_id")], of, [F.col("doc_id"), F.col("text")])
    rows = told.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("same"), merkle.folded(merkle.leaf(F.col("doc_id"), F.concat("text", F.lit("!"))), F.col("proof")).alias("other"), "root", "text").collect()
    assert all(r.same == r.root for r in rows)
    assert all(r.other != r.root for r in rows if r.text is not None)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_and_its_inverse(n, seed):
    at = sharding.permuted(np.arange(n), n, seed)
    assert sorted(at.tolist()) == list(range(n))
    assert (sharding.restored(at, n, seed) == np.arange(n)).all()


def test_permutation_of_many_rows():
    n = 7_000_000_000_000
    rows = np.random.default_rng(1).integers(0, n, 2000)
    at = sharding.permuted(rows, n)
    assert ((at >= 0) & (at < n)).all()
    assert (sharding.restored(at, n) == rows).all()


def test_shards_with_odd_rows(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    got = sharding.document_shards(df).toPandas()
    assert len(got) == len(CASES)
    counts = got.groupby("shard").slot.agg(["count", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] == counts["count"] - 1).all()
    assert not got.duplicated(["shard", "slot"]).any()
    assert sorted(got["size"]) == sorted(len((r[4] or "").encode()) + 1 for r in CASES)
    assert sorted(got.text_crc32.dropna()) == sorted(zlib.crc32(r[4].encode()) for r in CASES if r[4] is not None)
    shard, slot = sharding.place_of(got.row_number.to_numpy(), len(CASES))
    assert (shard == got["shard"]).all() and (slot == got.slot).all()
    assert (sharding.row_of(shard, slot, len(CASES)) == got.row_number).all()
    assert sharding.document_shards(df.filter("false")).count() == 0


def test_shards_keep_other_columns_and_do_not_depend_on_partitions(spark):
    rows = [(i, f"t{i}", i % 3, "old") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole int, slot string")
    places = []
    for n in (1, 9):
        got = sharding.sharded(df.repartition(n), [F.col("doc_id")], 7, 5)
        assert got.columns == ["doc_id", "text", "whole", "row_number", "position", "shard", "slot"]
        places.append(sorted((r.doc_id, r.text, r.whole, r.row_number, r["shard"], r.slot) for r in got.collect()))
    assert places[0] == places[1]
    assert [(p[0], p[1], p[2]) for p in places[0]] == [r[:3] for r in rows]
    assert [p[3] for p in places[0]] == list(range(500))


def test_written_shards_are_read_in_order_of_slots(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(90)], "doc_id long, text string")
    placed = sharding.sharded(df, [F.col("doc_id")], 4)
    sharding.write_shards(placed, str(tmp_path / "out"), 6)
    for k in range(4):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("part-*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(len(slots)))


def test_no_shards(spark):
    with pytest.raises(ValueError):
        sharding.sharded(spark.createDataFrame([(1,)], "doc_id long"), [F.col("doc_id")], 0)
