"""Vectorised helpers that run inside tasks, on the UTF-8 bytes of Arrow string columns.

Texts reach a task as Arrow batches. All helpers work on one flat byte array with document offsets, in slices of a few
megabytes, so that memory is bounded by the slice (or by the one longest text), not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
SLICE_BYTES = 1 << 21
ROWS_PER_BATCH = 256
#: Odd multipliers of the polynomial hashes, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def small_batches(spark: SparkSession) -> None:
    """Few texts per Arrow batch: texts may be long, and a batch has to fit beside its numpy arrays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; a folder of the warehouse where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_to = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(set_to or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields behind."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads a polynomial hash over all bits."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, U64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        down[0] = 1
        with np.errstate(over="ignore"):
            have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """H with len(data)+1 entries; (H[e]-H[s]) * base**-s identifies data[s:e] wherever it stands."""
    up, _ = powers(len(data), base)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    return mix((h[ends] - h[starts]) * powers(len(h), base)[1][starts])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(col) else data[:0], off - off[0] if len(col) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word (a maximal run without ASCII white space), and the number of words of each document."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in slices(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        while lo < hi:  # only one long text takes several rounds; they are cut at white space
            end = hi
            if hi - lo > 2 * SLICE_BYTES:
                cut = lo + SLICE_BYTES
                while cut < hi and not _SPACE[data[cut]]:
                    cut += 1
                end = cut
            part = data[lo:end]
            inside = ~_SPACE[part]
            borders = offsets[first : last + 1]
            borders = borders[(borders > lo) & (borders < end)] - lo
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            starts[borders] |= inside[borders]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            ends[borders - 1] |= inside[borders - 1]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            hashes.append(span_hash(prefix_hash(part), s, e))
            at = np.searchsorted(offsets[first : last + 1], s + lo, "right") - 1 + first
            counts += np.bincount(at, minlength=len(counts))
            lo = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their number per document; a text of 1 to k-1 words is one shingle."""
    ends = np.cumsum(counts)
    starts = ends - counts
    with np.errstate(over="ignore"):
        acc = np.zeros(len(words), U64)
        for j in range(k):
            acc[: max(len(words) - j, 0)] += words[j:] * U64(pow(OTHER_BASE, j + 1, 1 << 64))
        keep = np.ones(len(words), bool)
        for j in range(1, k):
            tail = ends - j
            keep[tail[(tail >= starts) & (counts >= j)]] = False
        short = np.flatnonzero((counts > 0) & (counts < k))
        for d in short:
            w = words[starts[d] : ends[d]]
            acc[starts[d]] = np.sum(w * np.array([pow(BASE, j + 1, 1 << 64) for j in range(len(w))], U64)) + U64(len(w))
            keep[starts[d]] = True
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    return mix(acc[keep]), n


def lowered(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, F.lower(F.coalesce(F.col(text), F.lit(""))))
