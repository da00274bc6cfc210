"""Operator 12: reproducible shuffle into shards, by a Feistel permutation of global row numbers.

Rows are numbered from 0 to N - 1 in a stated order. A Feistel network over the smallest even number of bits that holds N
permutes the numbers; one that falls at N or above is permuted again until it falls below (cycle walking, less than four
steps on average), which is a permutation of 0 to N - 1. Position p goes to shard p modulo the number of shards, at slot
p divided by it: counts differ by one at most and slots have no gaps. The same order, seed and N give the same places,
however the table is partitioned, and place_of() and row_of() compute them in both directions without reading anything.

Defined results: rows with a null in the order stand first; rows equal in the whole order are interchangeable; empty and
null texts are rows like any other; an empty table has no rows. A column of the table that has the name of an output
column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed
from actmill.llm.ordering import apart, numbered

SHARDS, SEED, ROUNDS = 16, 20_240_611, 6
#: Odd multipliers of the round function, below 2**32.
FIRST, SECOND = 0x9E3779B1, 0x85EBCA6B


def round_keys(seed: int) -> list[int]:
    """A key of 32 bits for each round."""
    return [(seed * FIRST + (i + 1) * SECOND + (seed >> 7) * (2 * i + 1)) % (1 << 32) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half of the network over n numbers; 1 to 32."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    x = (x + np.uint64(key)) & low
    x = (x * np.uint64(FIRST)) & low
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(SECOND)) & low
    x ^= x >> np.uint64(13)
    return x & mask


def _walk(x: np.ndarray, n: int, step) -> np.ndarray:
    """step again for every number that is not below n yet."""
    x = step(np.asarray(x, np.uint64))
    far = np.flatnonzero(x >= np.uint64(n))
    while len(far):
        x[far] = step(x[far])
        far = far[x[far] >= np.uint64(n)]
    return x.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Positions of row numbers below n."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in round_keys(seed):
            left, right = right, left ^ _round(right, key, mask)
        return (left << bits) | right

    return _walk(rows, n, step)


def restored(positions: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row numbers of positions: the inverse of permuted()."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in reversed(round_keys(seed)):
            left, right = right ^ _round(left, key, mask), left
        return (left << bits) | right

    return _walk(positions, n, step)


def place_of(rows: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    at = permuted(rows, n, seed)
    return at % shards, at // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number at a shard's slot."""
    return restored(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def sharded(rows: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with row_number, position, shard and slot. Each row is dealt once, by ranges of the order."""
    if not 0 < shards < 1 << 31:
        raise ValueError("there must be one shard at least, and fewer than 2**31")
    outputs = ("row_number", "position", "shard", "slot")
    rows = rows.drop(*outputs)
    whole, held = (apart(rows, x) for x in ("whole", "held"))
    placed = numbered(checkpointed(rows.withColumn(whole, F.lit(0))), whole, [c.asc_nulls_first() for c in order], "row_number", held)

    @F.pandas_udf("long")
    def position(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for row, n in batches:
            yield pd.Series(permuted(row.to_numpy(), int(n.iloc[0]), seed) if len(row) else row)

    at = placed.withColumn("position", position("row_number", held))
    return at.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards)}).drop(whole, held)


def write_shards(placed: DataFrame, path: str, files: int) -> None:
    """Rows of sharded() as a folder for each shard, in order of the slots inside and across its files."""
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def document_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, position: places without the texts.

    Documents are ordered by doc_id, ties by the text's SHA-256; counts of shards differ by one at most (law `rows`).
    """
    text = F.col("text")
    facts = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("of"))
    placed = sharded(facts, [F.col("doc_id"), F.col("of")], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
