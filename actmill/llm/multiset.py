"""Operator 2: homomorphic multiset hash of documents.

A paragraph (a piece between newlines, empty ones included) is hashed to a wide vector; a document is the sum of its
paragraphs' vectors, lane by lane modulo a power of two. Sums do not depend on order, and a paragraph is inserted or
deleted by adding or subtracting its vector. The vector has two parts:

* 16 lanes modulo 2**64, filled from BLAKE2b of the paragraph. They are the fingerprint: equal multisets of paragraphs
  have equal lanes, others differ but for a chance of 2**-1024.
* 1024 lanes modulo 2**16: each word, with the word before it in its paragraph, adds +1 or -1 to one hashed lane. The
  cosine of two such sums estimates the cosine of the two bags of word pairs, within about 0.03.

Defined results: a null text counts as empty; an empty text is one empty paragraph; two texts with equal fingerprint
lanes have likeness 1; otherwise a text without words has likeness 0 to any text. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.llm.arrays import BASE, U64, checkpointed, extended, mix, small_batches, word_hashes

EQUAL_LANES, LIKE_LANES = 16, 1024


def states(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(len(texts), 16) uint64 and (len(texts), 1024) int16: the sums of the texts' paragraphs."""
    if not texts:
        return np.zeros((0, EQUAL_LANES), U64), np.zeros((0, LIKE_LANES), np.int16)
    per_text = np.array([t.count("\n") + 1 for t in texts], np.int64)
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    digests = []
    for p in data.split(b"\n"):
        digests.append(hashlib.blake2b(p, person=b"lanes 0-7").digest())
        digests.append(hashlib.blake2b(p, person=b"lanes 8-15").digest())
    lanes = np.frombuffer(b"".join(digests), U64).reshape(-1, EQUAL_LANES)
    first = np.cumsum(per_text) - per_text
    equal = np.add.reduceat(lanes, first, axis=0)
    flat = np.frombuffer(data, np.uint8)
    borders = np.concatenate([[0], np.flatnonzero(flat == 10) + 1, [len(flat)]])
    words, counts = word_hashes(flat, borders)
    before = np.zeros(len(words), U64)
    before[1:] = words[:-1]
    starts = (np.cumsum(counts) - counts)[counts > 0]
    before[starts] = 1
    pair = mix(before * U64(BASE) + words)
    text_of = np.repeat(np.repeat(np.arange(len(texts)), per_text), counts)
    sign = 1.0 - 2.0 * ((pair >> U64(20)) & U64(1)).astype(np.float64)
    cell = text_of * LIKE_LANES + (pair & U64(LIKE_LANES - 1)).astype(np.int64)
    like = np.bincount(cell, sign, len(texts) * LIKE_LANES).reshape(-1, LIKE_LANES)
    return equal, like.astype(np.int64).astype(np.int16)


def insert(state: tuple[np.ndarray, np.ndarray], paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The state of one document after these paragraphs are added to it."""
    e, k = states(["\n".join(paragraphs)])
    return state[0] + e[0], state[1] + k[0]


def delete(state: tuple[np.ndarray, np.ndarray], paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    e, k = states(["\n".join(paragraphs)])
    return state[0] - e[0], state[1] - k[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a[0] == b[0]).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def hexed(equal: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.ascontiguousarray(equal.astype(">u8"))]


def fingerprint_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fingerprint string, and equal_lanes and like_lanes binary, from which documents can be edited and compared.

    Columns of these names give way to them.
    """
    small_batches(df.sparkSession)
    extra = ["fingerprint", "equal_lanes", "like_lanes"]
    df = df.drop(*extra)
    at = df.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, k = states([t or "" for t in b.column(at).to_pylist()])
            cols = [hexed(e), [r.tobytes() for r in e], [r.tobytes() for r in k]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), *(pa.array(c, pa.binary()) for c in cols[1:])], [*b.schema.names, *extra])

    return df.mapInArrow(task, extended(df.schema, "fingerprint string, equal_lanes binary, like_lanes binary"))


_REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(ids: list, texts: list[str], nexts: list[str]) -> list[list]:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
    n = len(texts)
    e, k = states([*texts, *edited, *nexts])
    own, new, following = ((e[i : i + n], k[i : i + n]) for i in (0, n, 2 * n))
    return [ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], hexed(own[0]), hexed(new[0]), likeness(own, new).tolist(), likeness(own, following).tolist()]


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against itself with the last half replaced by the start of the next one, in descending doc_id.

    The texts are dealt once, by ranges of doc_id. Each task walks its sorted range with one row of delay; only the
    first and the last text of each range meet again, in a join of two rows for each task. Ties of doc_id are ordered by
    the text's hash; null ids come last.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [f.split()[0] for f in _REPORT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [*fields, "edge", "part", "text"]

    def rows(columns: list[list]) -> pa.RecordBatch:
        n = len(columns[0])
        tail = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *tail], names)

    def edge(kind: str, doc_id, text: str, part: int) -> pa.RecordBatch:
        blank = [pa.nulls(1, k) for k in kinds[1:]]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *blank, pa.array([kind]), pa.array([part], pa.int64()), pa.array([text], pa.string())], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, late = TaskContext.get().partitionId(), None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            if late is None:
                yield edge("first", ids[0], texts[0], part)
            else:
                ids, texts = [late[0], *ids], [late[1], *texts]
            late = (ids[-1], texts[-1])
            at = 0
            while at < len(ids) - 1:  # a few texts at a time, by size
                to, size = at + 1, len(texts[at])
                while to < len(ids) - 1 and to - at < 64 and size < 1 << 20:
                    size += len(texts[to])
                    to += 1
                yield rows(_report(ids[at:to], texts[at:to], texts[at + 1 : to + 1]))
                at = to
        if late is not None:
            yield edge("last", late[0], late[1], part)

    walked = checkpointed(ranged.mapInArrow(walk, f"{_REPORT}, edge string, part long, text string"))
    firsts = walked.filter("edge = 'first'").select("part", F.col("text").alias("next_text"))
    # One row for each range: which range follows it, the last one being followed by the first.
    follows = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("lead"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("head"))
    follows = follows.select("part", F.coalesce("lead", "head").alias("next_part"))
    lasts = walked.filter("edge = 'last'").select("doc_id", "text", "part").join(follows, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = _report([i], [t], [n])
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], fields)

    return walked.filter("edge is null").select(*fields).unionByName(pairs.mapInArrow(finish, _REPORT))
