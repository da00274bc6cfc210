"""Approximate nearest vectors: an inverted-list index with residual codes, probed list by list.

Building: centroids come from a few rounds of k-means on a bounded sample (SAMPLE rows, chosen by hash). Every row goes to
its nearest centroid's list; its residual is kept as one signed byte a dimension, with a scale for each row. A list is
stored as rows of CUT vectors at most, so a crowded list is many rows and no task holds it whole.

Searching: a question looks into lists in order of their centroids' likeness, PROBES at least and as many as the index
asks for, and on until they hold ENOUGH times k rows. What the index asks for is measured when it is built: TRIED rows of
the sample look for their NEAR nearest others, and SURE of these lie in so many lists. Neighbours in a sample are farther
than in all rows, so this is on the safe side; where vectors have no clusters, it comes near to all lists. Lists meet questions in a join by list; each pair is a product of matrices on decoded vectors. The
best RERANK times k of a question are scored again with the exact vectors, joined by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actmill.operators.storage import stored
from actmill.operators.vectors import best, places

#: Rows that the centroids are fitted on, most lists, rounds of k-means, vectors of a stored row.
SAMPLE, MOST_LISTS, ROUNDS, CUT = 20_000, 1_024, 12, 2_048
PROBES, ENOUGH, RERANK = 24, 20, 4
TRIED, NEAR, SURE = 512, 10, 0.97


@dataclass(frozen=True)
class Index:
    """centroids(list, size, vector, probes) and lists(list, cut, scales, codes, ids, poss); both are tables."""

    centroids: DataFrame
    lists: DataFrame

    def write(self, path: str) -> None:
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        self.lists.repartitionByRange("list", "cut").sortWithinPartitions("list", "cut").write.mode("overwrite").parquet(f"{path}/lists")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"))


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit length by k-means on likeness; a list without rows is started again at the row worst served."""
    rng = np.random.default_rng(7)
    centers = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        sims = sample @ centers.T
        of = sims.argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centers)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(sims.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.divide(sums, norm, out=centers, where=norm > 0)
    return centers


def probes_of(sample: np.ndarray, centers: np.ndarray) -> int:
    """How many lists, in order of likeness, hold SURE of the NEAR nearest others of TRIED rows of the sample."""
    if len(sample) < 2:
        return 1
    tried = np.random.default_rng(11).permutation(len(sample))[:TRIED]
    own, sims = (sample @ centers.T).argmax(axis=1), sample[tried] @ sample.T
    sims[np.arange(len(tried)), tried] = -np.inf
    near = min(NEAR, len(sample) - 1)
    found = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    place = np.argsort(np.argsort(-(sample[tried] @ centers.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, own[found], 1), SURE, method="higher")) + 1


def build(corpus: DataFrame, lists: int | None = None) -> Index:
    """The index of corpus(id, pos, vector), unit vectors; by default the square root of its rows as lists, MOST_LISTS at most.

    The sample of SAMPLE rows and the centroids pass the driver; both are bounded. Every row is indexed.
    """
    spark, rows = corpus.sparkSession, corpus.filter(F.col("vector").isNotNull())
    n = rows.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col("vector").cast("array<double>").alias("v")).limit(SAMPLE)
    sample = np.array([r[0] for r in chosen.collect()], np.float64)
    if not len(sample):
        sample = np.zeros((1, 1))
    centers = fitted(sample, min(lists or max(1, int(n**0.5)), MOST_LISTS, len(sample)))
    sent = spark.sparkContext.broadcast(centers)
    probes, kinds = probes_of(sample, centers), dict(corpus.dtypes)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            of = (v @ sent.value.T).argmax(axis=1)
            rest = v - sent.value[of]
            scale = np.abs(rest).max(axis=1) / 127
            codes = np.round(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of.astype(np.int32)), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "pos", "list", "scale", "code"])

    each = stored(rows.select("id", "pos", "vector").mapInArrow(coded, f"id {kinds['id']}, pos {kinds['pos']}, list int, scale double, code binary"))
    sizes = each.groupBy("list").agg(F.count("*").alias("size"))
    cut = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CUT)).cast("int")
    dealt = each.join(F.broadcast(sizes), "list").withColumn("cut", cut)  # a row for each list: MOST_LISTS at most
    packed = dealt.groupBy("list", "cut").agg(F.collect_list(F.struct("id", "pos", "scale", "code")).alias("e"))
    table = packed.select("list", "cut", F.col("e.scale").alias("scales"), F.col("e.code").alias("codes"), F.col("e.id").alias("ids"), F.col("e.pos").alias("poss"))
    known = {r[0]: r[1] for r in sizes.collect()}
    made = spark.createDataFrame([(i, int(known.get(i, 0)), c.tolist(), probes) for i, c in enumerate(centers)], "list int, size long, vector array<double>, probes int")
    return Index(made, stored(table))


def _probes(queries: DataFrame, index: Index, k: int, probes: int | None) -> DataFrame:
    """(list, qids, vectors): the questions that look into each list."""
    rows = sorted(index.centroids.collect())  # MOST_LISTS rows at most
    centers, sizes = np.array([r["vector"] for r in rows], np.float64), np.array([r["size"] for r in rows])
    probes = max(PROBES, rows[0]["probes"] if rows else 0) if probes is None else probes
    sent = queries.sparkSession.sparkContext.broadcast((centers, sizes))
    kind = dict(queries.dtypes)["qid"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, sizes = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            order = np.argsort(-(v @ centers.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            line, spot = np.nonzero((np.arange(order.shape[1]) < probes) | (before < ENOUGH * k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(line)), pa.array(order[line, spot].astype(np.int32)), b.column(1).take(pa.array(line))], ["qid", "list", "vector"])

    asked = queries.filter(F.col("vector").isNotNull()).select("qid", F.col("vector").cast("array<double>").alias("vector"))
    return asked.mapInArrow(choose, f"qid {kind}, list int, vector array<double>")


def search(queries: DataFrame, corpus: DataFrame, index: Index, k: int = 10, probes: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best rows found, scored exactly; queries(qid, vector), corpus(id, pos, vector)."""
    looked = _probes(queries, index, k, probes)
    # Questions of a list are cut too, so that a list that all look into is many pairs of rows.
    groups = looked.groupBy("list", F.pmod(F.xxhash64("qid"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct("qid", "vector")).alias("q"))
    both = index.lists.join(groups.select("list", F.col("q.qid").alias("qids"), F.col("q.vector").alias("asked")), "list").join(F.broadcast(index.centroids.select("list", F.col("vector").alias("center"))), "list")
    kinds = dict(corpus.dtypes)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
                codes = np.frombuffer(b"".join(row["codes"].as_py()), np.int8).reshape(len(row["codes"]), -1)
                v = codes * np.array(row["scales"].as_py())[:, None] + np.array(row["center"].as_py())
                sims = np.array(row["asked"].as_py()) @ v.T
                line, column = best(sims, places(row["poss"].values), None, RERANK * k)
                yield pa.RecordBatch.from_arrays([row["qids"].values.take(pa.array(line)), row["ids"].values.take(pa.array(column)), pa.array(sims[line, column])], ["qid", "id", "like"])

    rough = both.select("scales", "codes", "center", "ids", "poss", "qids", "asked").mapInArrow(near, f"qid {dict(queries.dtypes)['qid']}, id {kinds['id']}, like double")
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("like").desc(), "id"))
    few = rough.withColumn("place", first).filter(F.col("place") <= RERANK * k).select("qid", "id")
    exact = few.join(queries.select("qid", F.col("vector").alias("asked")), "qid").join(corpus.select("id", "pos", "vector"), "id")
    dot = F.aggregate(F.zip_with("asked", "vector", lambda a, x: a.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "pos"))
    return exact.select("qid", "id", "pos", F.round(dot, 6).alias("score")).withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, n, hit): of exact results, how many were found, question by question."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
