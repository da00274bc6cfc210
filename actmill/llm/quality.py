"""Operator 4: quality scores by histogram gradient-boosted trees over document statistics.

Tasks reduce each whole text to the statistics FEATURES. The trees are grown in numpy on a sample of at most TRAIN_ROWS
labelled rows (those of smallest hash of doc_id), from gradient histograms over BINS quantile bins, to a fixed depth.
They are kept as complete binary trees, flattened into arrays of features, thresholds and leaves, so that a batch of
documents descends all trees by array indexing.

Defined results: a null text counts as empty and gets the score of an empty text; without any labelled row each score is
0.5; with labels of one class alone the scores are near that class; repeated rows get equal scores; a null label or
doc_id teaches nothing, and a null doc_id is scored like any other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import U64, checkpointed, extended, shingle_hashes, slices, small_batches, utf8, word_hashes
from actmill.llm.langid import fold

TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, SMOOTH = 60, 4, 64, 0.2, 1.0
FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "shouts", "bars", "stops", "commas", "non_ascii", "lines_per_word", "log_line", "distinct_words", "top_word", "distinct_lines", "repeated_shingles"]
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c, _k in ((b"#$%&*^~<>=+\\/_{}[]@`", 3), (b"!?", 4), (b"|", 5), (b".;:", 6), (b",", 7)):
    _KIND[list(_c)] = _k
_KIND[128:] = 8
_KIND[10] = 9
_KIND[97:123] = 10


def _distinct(values: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """By group: how many distinct values, and how often the most frequent one occurs."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(groups, np.int64)
    np.maximum.at(most, g[at], np.diff(np.append(at, len(v))))
    return np.bincount(g[at], minlength=groups), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) float32."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(of * 16 + _KIND[data], minlength=n * 16).reshape(n, 16).astype(np.float64)
    words, per = word_hashes(data, offsets)
    word_of = np.repeat(np.arange(n), per)
    different, most = _distinct(words, word_of, n)
    shingles, k = shingle_hashes(words, per, 3)
    other, _ = _distinct(shingles, np.repeat(np.arange(n), k), n)
    borders = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_of = np.searchsorted(offsets, borders[:-1], "right") - 1
    line_words, in_line = word_hashes(data, borders) if len(borders) > 1 else (words, np.zeros(0, np.int64))
    # A line is told by the sum of its words' hashes.
    ends = np.concatenate([np.zeros(1, U64), np.cumsum(line_words, dtype=U64)])
    stop = np.cumsum(in_line)
    lines, _ = _distinct(ends[stop] - ends[stop - in_line], line_of, n)
    n_lines = np.bincount(line_of, minlength=n)
    letters = counts[:, 1] + counts[:, 8] + counts[:, 10]
    w, b, ln = np.maximum(per, 1), np.maximum(size, 1), np.maximum(n_lines, 1)
    out = [np.log1p(size), np.log1p(per), size / w, counts[:, 1] / np.maximum(letters, 1), counts[:, 2] / b, (b - letters - counts[:, 0] - counts[:, 9] - counts[:, 2]) / b, counts[:, 3] / w, counts[:, 4] / w, counts[:, 5] / w, counts[:, 6] / w, counts[:, 7] / w, counts[:, 8] / b, n_lines / w, np.log1p(size / ln), different / w, most / w, lines / ln, 1 - other / np.maximum(k, 1)]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Trees:
    """feature and threshold are (rounds, 2**depth - 1); leaf is (rounds, 2**depth). A value above a threshold goes right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss, second-order, by histograms."""
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    feature, threshold, leaf = np.zeros((rounds, 2**depth - 1), np.int64), np.full((rounds, 2**depth - 1), np.inf, np.float32), np.zeros((rounds, 2**depth))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    f = x.shape[1]
    slots = np.arange(f) * BINS
    margin = np.full(len(y), base)
    for t in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            at, k = node - (2**level - 1), 2**level
            cell = (at[:, None] * (f * BINS) + slots + codes).ravel()
            hists = [np.bincount(cell, np.repeat(v, f), k * f * BINS).reshape(k, f, BINS).cumsum(axis=2) for v in (g, h)]
            gl, hl = hists
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            for i, b in enumerate(best):
                c, e = divmod(int(b), BINS)
                if gain[i, c, e] > 1e-6 and e < len(edges[c]):
                    feature[t, 2**level - 1 + i], threshold[t, 2**level - 1 + i] = c, edges[c][e]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - (2**depth - 1)
        leaf[t] = -RATE * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + SMOOTH)
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs without its text, and with features, an array of float; other columns stay."""
    small_batches(docs.sparkSession)
    docs = docs.drop("features")
    at = docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]
    schema = extended(docs.drop("text").schema, "features array<float>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(at))
            parts = [statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), lists], [*(b.schema.names[i] for i in keep), "features"])

    return docs.mapInArrow(task, schema)


def fit(features: DataFrame, labels: DataFrame) -> Trees:
    """Trees from features(doc_id, features) and labels(doc_id, label), on TRAIN_ROWS rows at most."""
    known = labels.filter("label is not null").select(F.col("doc_id").alias("labelled"), "label")
    rows = features.join(known, F.col("doc_id") == F.col("labelled")).select("features", "label", F.xxhash64("doc_id").alias("h"))
    # The rows of smallest hash; a share that holds them is set first, so that tasks send few rows to the last one.
    share = 1.5 * TRAIN_ROWS / max(rows.count(), 1)
    near = rows if share >= 1 else rows.filter(F.col("h") <= F.lit(int(-(2**63) + share * 2**64)))
    got = near.orderBy("h", "features").limit(TRAIN_ROWS).toArrow()
    x = np.asarray(got.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.asarray(got.column("label").to_pylist(), np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels has doc_id and quality."""
    features = checkpointed(with_statistics(docs.select("doc_id", "text", (fold(3) == 1).alias("held_out"))))
    trees = fit(features.filter("not held_out"), labels.select("doc_id", F.col("quality").alias("label")))
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).values.to_numpy()[b.column(2).offsets[0].as_py() :].reshape(-1, len(FEATURES))[: b.num_rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.scores(x))], ["doc_id", "held_out", "score"])

    scored = features.select("doc_id", "held_out", "features").mapInArrow(task, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
