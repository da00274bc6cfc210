"""Operator 5: toxicity scores by averaged subword embeddings and a linear softmax.

A word (a run of letters and digits, in lower case, between two marks) is the bag of its n-grams of SHORTEST to LONGEST
characters and of the word itself, each hashed to one of BUCKETS embeddings; a text is the average over all n-grams of all
its words. An n-gram counts by its rarity in the sample, PRIOR neutral n-grams are averaged in, and the average of a text
of few different n-grams (one word over and over) is drawn towards neutral, by 1 - exp(-different / DIFFERENT). Embeddings
and softmax are trained jointly in numpy, on minibatches with a falling rate. A misspelt word shares most n-grams with the
word it was made from. As a text's logits are linear in its average, each bucket's embedding is multiplied by the softmax
weights once, and tasks add one number for each n-gram of the whole text.

The training sample is the one bound: at most TRAIN_ROWS labelled documents, half of them of each label where there are
so many (those of smallest hash of doc_id). In training the labels' odds are the square root of their odds among all
labelled documents; every bucket that occurs in the sample is trained. The sample's bags pass the driver one partition at
a time.

Defined results: a null text counts as empty; a text without words has the score of the intercept; without labelled rows
each score is 0.5; a null label or doc_id teaches nothing; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import BASE, U64, checkpointed, mix, slices, small_batches, utf8
from actmill.llm.langid import fold

BUCKETS, DIMENSIONS = 1 << 18, 2
TRAIN_ROWS = 4_000
#: Averages over thousands of n-grams are small; they are scaled up before the softmax.
SCALE = 500.0
STEPS, MINIBATCH, RATE, DECAY, START = 300, 128, 0.02, 0.1, 0.1
PRIOR, DIFFERENT = 50, 400
SHORTEST, LONGEST = 3, 6
_WORD: list[np.ndarray] = []


def _in_words() -> np.ndarray:
    """For each code point: can it be in a word."""
    if not _WORD:
        _WORD.append(np.array([chr(i).isalnum() for i in range(0x110000)]))
    return _WORD[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and the text it is in."""
    n = len(texts)
    # A mark in front of each text and after each, so that words don't meet.
    cp = np.frombuffer(("\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    border = cp == 10
    text_of = np.minimum(np.maximum(np.cumsum(border) - 1, 0), max(n - 1, 0))
    inside = _in_words()[cp]
    x = np.where(inside, cp, 32).astype(U64) + U64(1)
    found, where = [], []
    acc = x.copy()
    clean = np.ones(len(x), bool)  # no mark within, but for the ends
    for k in range(2, LONGEST + 1):
        if len(x) < k:
            break
        acc = acc[:-1] * U64(BASE) + x[k - 1 :]
        clean = clean[: len(x) - k + 1]
        if k > 2:
            clean = clean & inside[k - 2 : len(x) - 1]
        if k >= SHORTEST:
            at = np.flatnonzero(clean)
            found.append(mix(acc[at] + U64(k)))
            where.append(text_of[at + 1])
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    if len(start):
        # Whole words: sums of mixed characters by place in the word.
        h = np.zeros(len(x) + 1, U64)
        place = np.arange(len(x)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(x)]])))
        h[1:] = np.cumsum(np.where(inside, mix(x * U64(BASE) + place.astype(U64)), U64(0)), dtype=U64)
        found.append(mix(h[end] - h[start]))
        where.append(text_of[start])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(found) >> U64(65 - BUCKETS.bit_length())).astype(np.int64), np.concatenate(where).astype(np.int64)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different buckets of each text, sorted by text, their shares of its average, and the text each is in."""
    bucket, text_of = subwords(texts)
    cell, n = np.unique(text_of * BUCKETS + bucket, return_counts=True)
    row = cell // BUCKETS
    total, different = np.bincount(row, n, len(texts)), np.bincount(row, minlength=len(texts))
    drawn = (1 - np.exp(-different / DIFFERENT)) / (total + PRIOR)
    return cell % BUCKETS, n * drawn[row], row


@dataclass
class Model:
    """weight[bucket] and intercept: the difference of the two classes' logits."""

    weight: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bucket, share, row = bags(texts)
        mean = np.bincount(row, self.weight[bucket] * share, len(texts))
        return 1 / (1 + np.exp(-np.clip(mean + self.intercept, -30, 30)))


def train(buckets: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, odds: float = 1.0) -> Model:
    """Embeddings and softmax from each text's buckets and their shares of its n-grams."""
    if not len(y):
        return Model(np.zeros(BUCKETS), 0.0)
    random = np.random.default_rng(7)
    texts = np.zeros(BUCKETS, np.int64)
    for b in buckets:
        texts[b] += 1
    known = np.flatnonzero(texts)
    rarity = np.log((len(y) + 1) / texts[known]).astype(np.float32)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    rows = [place[b] for b in buckets]
    shares = [s * rarity[r] for s, r in zip(shares, rows, strict=True)]
    emb = START * random.uniform(-1, 1, (len(known), DIMENSIONS)).astype(np.float32)
    soft = random.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    classes = np.bincount(y, minlength=2)
    share = np.array([1, odds]) / (1 + odds) if classes.all() else (classes + 1) / (len(y) + 2)
    weight = (len(y) * share / np.maximum(classes, 1)).astype(np.float32)
    bias = np.log(share).astype(np.float32)
    params = [emb, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [0.0] * len(params)
    step, per_epoch = 0, -(-len(y) // MINIBATCH)
    epochs = -(-STEPS // per_epoch)
    steps = epochs * per_epoch
    for _ in range(epochs):
        order = random.permutation(len(y))
        for lo in range(0, len(y), MINIBATCH):
            batch = order[lo : lo + MINIBATCH]
            ids, share = (np.concatenate([v[r] for r in batch]) for v in (rows, shares))
            sizes = np.array([len(rows[r]) for r in batch])
            of, ends = np.repeat(np.arange(len(batch)), sizes), np.cumsum(sizes) - sizes
            part = emb[ids] * share[:, None]
            mean = np.zeros((len(batch), DIMENSIONS), np.float32)
            some = np.flatnonzero(np.diff(np.append(ends, len(ids))))
            mean[some] = SCALE * np.add.reduceat(part, ends[some], axis=0) if len(ids) else 0
            logit = mean @ soft + bias
            logit -= logit.max(axis=1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[y[batch]][:, None] / len(batch)
            back = SCALE * (p @ soft.T)[of] * share[:, None]
            d_emb = np.stack([np.bincount(ids, back[:, k], len(known)) for k in range(DIMENSIONS)], axis=1).astype(np.float32)
            grads = [d_emb + DECAY / len(y) * emb, mean.T @ p, p.sum(axis=0)]
            rate = RATE * (1 - step / steps)
            step += 1
            # The step is Adam's, with one second moment for each matrix: a bucket moves by its evidence, so that one
            # that occurs in few texts stays near its start.
            for i, (w, g, m) in enumerate(zip(params, grads, first, strict=True)):
                m += 0.1 * (g - m)
                second[i] += 0.01 * (float(np.mean(g * g)) - second[i])
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(BUCKETS)
    out[known] = SCALE * rarity * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(out, float(bias[1] - bias[0]))


def _texts(b: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    """The texts of a batch, a few megabytes at a time; a null is empty."""
    _, off = utf8(b.column(column))
    for lo, hi in slices(off):
        yield [t or "" for t in b.column(column).slice(lo, hi - lo).to_pylist()]


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(labelled, label): the documents to learn from, TRAIN_ROWS at most; and the odds of label 1 in training.

    Hashes decide; a share of them is set first, so that tasks send few rows to the last one.
    """
    known = labels.filter("label in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("labelled"), F.col("label").cast("int").alias("label")).distinct()
    known = known.join(docs.select("doc_id").filter("doc_id is not null"), F.col("labelled") == F.col("doc_id"), "left_semi")
    have = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    half = TRAIN_ROWS // 2
    want = {x: max(half, TRAIN_ROWS - have.get(1 - x, 0)) for x in (0, 1)}
    h = F.xxhash64("labelled", F.lit(5))
    parts = []
    for x in (0, 1):
        share = min(1.0, 1.5 * want[x] / max(have.get(x, 0), 1))
        near = known.filter((F.col("label") == x) & (h <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)))
        parts.append(near.orderBy(h, "labelled").limit(want[x]))
    return parts[0].unionByName(parts[1]), float(np.sqrt((have.get(1, 0) + 1) / (have.get(0, 0) + 1)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from docs(doc_id, text) and labels(doc_id, label), on a sample of labelled rows."""
    small_batches(docs.sparkSession)
    chosen, odds = sampled(docs, labels)
    sample = checkpointed(chosen)
    # At most TRAIN_ROWS short rows are broadcast.
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("text", "label", F.xxhash64("doc_id", "text").alias("h"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: list[list[bytes]] = [[], []]
            for texts in _texts(b, 0):
                bucket, share, row = bags(texts)
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    cells[0].append(bucket[lo:hi].astype("<u4").tobytes())
                    cells[1].append(share[lo:hi].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in cells), b.column(1), b.column(2)], ["buckets", "shares", "label", "h"])

    found = []
    for r in rows.mapInArrow(task, "buckets binary, shares binary, label int, h long").toLocalIterator():
        found.append((r[3], r[2], np.frombuffer(r[0], "<u4").astype(np.int32), np.frombuffer(r[1], "<f4")))
        if len(found) > 2 * TRAIN_ROWS:  # rows that repeat a sampled doc_id may exceed the bound
            found = sorted(found, key=lambda f: f[:2])[:TRAIN_ROWS]
    # Sorted, the result does not depend on the partitions.
    found = sorted(found, key=lambda f: f[:2])[:TRAIN_ROWS]
    return train([f[2] for f in found], [f[3] for f in found], np.array([f[1] for f in found], np.int64), odds)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels has doc_id and toxic."""
    small_batches(docs.sparkSession)
    held = fold(3) == 1
    model = fit(docs.filter(~held).select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("label")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [sent.value.scores(texts) for texts in _texts(b, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(task, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
