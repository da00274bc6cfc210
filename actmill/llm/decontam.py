"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.

Texts and test items become sets of five-word shingles (words are runs without white space, in lower case; a text of one
to four words is one shingle). An item is in a document if at least 0.8 of its distinct shingles are.

Containment of a short item in a long text gives a tiny Jaccard similarity, so items are partitioned by size, the sizes
doubling from one part to the next, and each document is cut anew for each part: into half-overlapping windows of twice
the part's largest size. Any run of shingles as long as such an item lies inside a window, and item and window have a
similarity of at least 0.19 where the item is contained. HASHES minima are compared; one that agrees makes the pair a
candidate, which a contained item misses with odds of (1 - 0.19) ** 64, about 1e-6. The windows' minima come from the
minima of blocks, doubled from one part to the next, so all parts cost little more than one. The first part's blocks are
as small as the smallest item, so that this holds for an item of a single shingle too. Candidates are verified by
exact containment in the whole document's shingles.

The items are sent to the tasks in blocks of at most BLOCK_BYTES of text; one pass over the documents for each block.

Defined results: null and empty texts and items contain nothing and are contained in nothing; an item of fewer than five
words is found in a document of just these words; repeated items are all reported; a null item_id or doc_id is reported
as null. Items whose shingles lie scattered over more than a window are found only by chance. Other columns of the
tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import U64, mix, shingle_hashes, slices, small_batches, utf8, word_hashes

SHINGLE_WORDS, CONTAINED = 5, 0.8
HASHES, BLOCK = 64, 8
PIECE = 1 << 15
BLOCK_BYTES = 16 << 20
_ODD = (mix(np.arange(1, HASHES + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = mix(np.arange(1, HASHES + 1, dtype=U64)).astype(np.uint32)
_NONE = np.uint32(0xFFFFFFFF)


def _part(size: int, block: int) -> int:
    """Part p has items of up to block * 2**p shingles."""
    return max(0, int(np.ceil(np.log2(max(size, 1) / block))))


class Items:
    """A block of test items: their shingles, and for each part and hash the sorted minima."""

    def __init__(self, ids: list, texts: list[str]):
        data, off = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        words, counts = word_hashes(data, off)
        sh, n = shingle_hashes(words, counts, SHINGLE_WORDS)
        ends = np.cumsum(n)
        self.ids = ids
        #: Distinct shingles of each item, and how many of them a document must have.
        self.shingles = [np.unique(sh[e - c : e]) for e, c in zip(ends, n, strict=True)]
        self.needs = [int(np.ceil(CONTAINED * len(s) - 1e-9)) for s in self.shingles]
        #: Shingles of a block: as many as the smallest item has, rounded up to a power of two, BLOCK at most.
        self.block = min(BLOCK, 1 << (min((len(s) for s in self.shingles if len(s)), default=BLOCK) - 1).bit_length())
        minima: dict[int, list[tuple[int, np.ndarray]]] = {}
        for at, s in enumerate(self.shingles):
            if len(s):
                minima.setdefault(_part(len(s), self.block), []).append((at, hashed(s).min(axis=1)))
        self.parts = {}
        for p, found in minima.items():
            which = np.array([at for at, _ in found])
            values = np.stack([m for _, m in found], axis=1)
            order = np.argsort(values, axis=1)
            filters = np.zeros((HASHES, 1 << 16), bool)
            for i in range(HASHES):
                filters[i, values[i] >> np.uint32(16)] = True
            self.parts[p] = (np.take_along_axis(values, order, 1), which[order], filters)

    def pairs(self, sh: np.ndarray, ends: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) of the verified pairs, documents by position."""
        if not self.parts:
            return []
        # A long document is searched in pieces that overlap by the widest window.
        overlap = 2 * self.block << max(self.parts)
        step = max(PIECE, 8 * overlap)
        pieces = [(int(ends[d] - n[d] + at), int(min(n[d] - at, step + overlap)), int(d)) for d in np.flatnonzero(n) for at in range(0, int(n[d]), step)]
        candidates: set[tuple[int, int]] = set()
        while pieces:
            take, size = 0, 0
            while take < len(pieces) and (not take or size + pieces[take][1] <= step + overlap):
                size += pieces[take][1]
                take += 1
            candidates |= self._candidates(sh, pieces[:take])
            pieces = pieces[take:]
        found, own = [], {}
        for d, item in sorted(candidates):
            if d not in own:
                own = {d: np.unique(sh[ends[d] - n[d] : ends[d]])}
            if np.isin(self.shingles[item], own[d], assume_unique=True).sum() >= self.needs[item]:
                found.append((d, item))
        return found

    def _candidates(self, sh: np.ndarray, pieces: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
        # Each piece starts a new block; the last one is padded with the largest value.
        n, name = np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces])
        blocks = -(-n // self.block)
        first = np.cumsum(blocks) - blocks
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, source = within + np.repeat(first * self.block, n), within + np.repeat([p[0] for p in pieces], n)
        folded = _fold(sh[source])
        low = np.empty((HASHES, int(blocks.sum())), np.uint32)
        for i in range(HASHES):
            row = np.full(low.shape[1] * self.block, _NONE, np.uint32)
            row[place] = _hash(folded, i)
            low[i] = row.reshape(-1, self.block).min(axis=1)
        piece = np.repeat(np.arange(len(n)), blocks)
        found: set[tuple[int, int]] = set()
        for p in range(max(self.parts) + 1):
            if p in self.parts:
                window = low.copy()
                np.minimum(low[:, :-1], low[:, 1:], out=window[:, :-1], where=(piece[1:] == piece[:-1])[None, :])
                values, which, filters = self.parts[p]
                for i in range(HASHES):
                    near = np.flatnonzero(filters[i][window[i] >> np.uint32(16)])
                    if len(near):
                        v = window[i, near]
                        lo, hi = np.searchsorted(values[i], v, "left"), np.searchsorted(values[i], v, "right")
                        for k in np.flatnonzero(hi > lo):
                            found.update((int(name[piece[near[k]]]), int(x)) for x in which[i, lo[k] : hi[k]])
            if p < max(self.parts):  # neighbouring blocks of a piece become one
                at = np.arange(len(piece)) - np.searchsorted(piece, piece)
                even = np.flatnonzero(at % 2 == 0)
                paired = np.flatnonzero((even + 1 < len(piece)) & (piece[np.minimum(even + 1, len(piece) - 1)] == piece[even]))
                half = low[:, even]
                half[:, paired] = np.minimum(half[:, paired], low[:, even[paired] + 1])
                low, piece = half, piece[even]
        return found


def _fold(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)


def _hash(folded: np.ndarray, i: int) -> np.ndarray:
    h = folded * _ODD[i] + _ADD[i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def hashed(shingles: np.ndarray) -> np.ndarray:
    folded = _fold(shingles)
    return np.stack([_hash(folded, i) for i in range(HASHES)])


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """The test items in blocks whose texts take BLOCK_BYTES at most, or are one text."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = 1 + 2 * int(size) // BLOCK_BYTES  # half full on average
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def with_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with item_ids, the sorted ids of the contained items, empty where there is none. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    out = docs.drop("item_ids").withColumn("item_ids", F.array().cast("array<long>"))
    for block in item_blocks(items.select(F.col("item_id").cast("long"), "text")):
        rows = block.filter("text is not null").orderBy(F.col("item_id").asc_nulls_first(), "text").collect()
        if rows:
            out = _searched(out, docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    return out


def _searched(docs: DataFrame, sent: Broadcast) -> DataFrame:
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(*sent.value)
        for b in batches:
            found = [x or [] for x in b.column(b.num_columns - 1).to_pylist()]
            data, off = utf8(pc.utf8_lower(b.column(at)))
            for lo, hi in slices(off):
                words, counts = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sh, n = shingle_hashes(words, counts, SHINGLE_WORDS)
                for d, item in known.pairs(sh, np.cumsum(n), n):
                    found[lo + d].append(known.ids[item])
            found = [sorted(x, key=lambda i: (i is not None, i)) for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], b.schema.names)

    return docs.mapInArrow(task, docs.schema)


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_ids and contaminated of each row of docs."""
    return with_items(docs.select("doc_id", "text"), items).select("doc_id", "item_ids", (F.size("item_ids") > 0).alias("contaminated"))
