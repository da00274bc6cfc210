"""Operator 10: removal of repeated byte strings, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of LENGTH bytes that also starts elsewhere, in another document or the same one, goes.

1. Anchors. The anchor of a window of LENGTH bytes is its GRAM-byte string of smallest hash, the leftmost on ties. It
   depends on the window's content alone, so equal windows have equal anchors. Neighbouring windows with the same anchor
   form a segment. Tasks emit a row for each segment: anchor hash, hash of its bytes, place.
2. Pruning. Segments whose anchor occurs once go. The others are folded: equal segments (by the 64-bit hashes of anchor
   and of bytes, which are independent) stand once, with the number of their places as weight.
3. Blocks. One place's bytes of each different segment are taken from the texts, dealt by anchor and packed into blocks
   of whole anchors. A block's suffixes are sorted by their first LENGTH bytes, the Burrows-Wheeler transform follows, and
   intervals are extended backwards, breadth first: those that appear in round l mark the places where neighbouring
   suffixes share just l bytes. After LENGTH rounds the suffixes between two marks share LENGTH bytes; if their weights
   sum to two or more, their windows are repeated. Every removed byte comes from such an interval.
   The segments of an anchor that holds more than CROWD_BYTES of them (the edge of a passage that very many documents
   share) are split into parts of windows with more common context, folded and pruned once more, and dealt by that
   context into blocks of their own.
4. Intervals go back to all places of their segments, and each text is cut once. The texts are dealt by row once, for
   taking bytes and for cutting.

Defined results: a null text counts as empty; texts shorter than LENGTH bytes lose nothing; all copies of a repeated
text lose every byte; a null doc_id is a row like any other; repeated rows are copies of each other. Rows are told apart
by doc_id and text, so rows equal in both get the same result, each its own row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import OTHER_BASE, U64, mix, powers, prefix_hash, slices, small_batches, span_hash, utf8

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
BLOCK_BYTES, CROWD_BYTES, PARTS = 1 << 19, 1 << 20, 64
PIECE_BYTES = 1 << 21


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i, by block minima from the left and from the right."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, anchor, content, start, windows, lead: the segments of all documents.

    start is in the document, windows is the number of windows, lead is the anchor's distance from start.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for first, last in slices(offsets, PIECE_BYTES):
        lo, hi = int(offsets[first]), int(offsets[last])
        at = lo
        while at < hi:  # one long text is taken in pieces that overlap, so that each window lies in one
            end = min(hi, at + 2 * PIECE_BYTES)
            found.append(_segments(data[at:end], np.clip(offsets[first : last + 1], at, end) - at, first, at - offsets[first : last + 1]))
            if end == hi:
                break
            at = end - LENGTH + 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(6))


def _segments(part: np.ndarray, offsets: np.ndarray, first: int, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(part)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < LENGTH:
        return none
    h = prefix_hash(part)
    grams = mix((h[GRAM:] - h[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    low = U64((1 << 23) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), WINDOW)
    anchor = (least & low).astype(np.int64)
    lengths = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= offsets[1:][doc_of]
    start = np.flatnonzero(valid)
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    s, windows = start[begin], np.diff(np.append(begin, len(start)))
    other = prefix_hash(part, OTHER_BASE)
    content = span_hash(other, s, s + windows + LENGTH - 1, OTHER_BASE)
    doc = doc_of[s]
    return doc + first, grams[anchor[s]].view(np.int64), content.view(np.int64), s + moved[doc], windows, anchor[s] - s


def suffixes(x: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first symbols, at least length of them, by doubling; ties are in any order."""
    n = len(x)
    symbols, x = np.unique(x, return_inverse=True)
    bits = int(len(symbols)).bit_length()
    have = 64 // bits
    key = np.zeros(n, U64)  # as many symbols at once as a word holds; 0 stands behind the end
    padded = np.concatenate([x.astype(U64) + U64(1), np.zeros(have, U64)])
    for j in range(have):
        key = (key << U64(bits)) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        if have >= length or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: max(n - have, 0)] = rank[have:] + 1
        key = rank * (n + 1) + follow
        have *= 2


def shared_prefixes(x: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """mark[i] is true where the suffixes order[i-1] and order[i] share at least length symbols.

    Backward extension, breadth first: an interval (lo, hi) of a string w becomes, for each symbol c, the interval of cw.
    Where that interval ends without a mark, the two suffixes there share as many symbols as w has. Intervals whose end
    is marked already are not followed.
    """
    n = len(x)
    symbols, x = np.unique(x, return_inverse=True)
    sigma = len(symbols)
    before = x[order - 1].astype(np.uint16)  # the symbol in front of each suffix; the text is taken as a ring
    total = np.bincount(x, minlength=sigma)
    starts = np.concatenate([[0], np.cumsum(total)[:-1]])
    place = np.argsort(before, kind="stable")
    step = 16
    cells = np.bincount((np.arange(n) // step + 1) * sigma + before, minlength=(n // step + 2) * sigma)
    sampled = np.cumsum(cells.reshape(-1, sigma), axis=0, dtype=np.int32)
    goes = np.empty(n, np.int64)  # where each place's suffix goes when the symbol in front is put before it
    goes[place] = np.arange(n)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])  # equal ends: one symbol in front of all between
    marked = np.zeros(n + 1, bool)
    marked[0] = marked[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        # Intervals with one symbol in front go as a whole, small ones list their symbols, large ones ask for all symbols.
        one = changes[lo] == changes[hi - 1]
        next_lo, next_hi = [goes[lo[one]]], [goes[hi[one] - 1] + 1]
        lo, hi = lo[~one], hi[~one]
        small = hi - lo <= 4 * step
        a, size = lo[small], (hi - lo)[small]
        if len(a):
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            group = np.repeat(np.arange(len(a)), size) * sigma + before[at]
            by = np.argsort(group, kind="stable")
            g = group[by]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            first = goes[at[by[cut]]]
            next_lo.append(first)
            next_hi.append(first + np.diff(np.append(cut, len(g))))
        a, b = lo[~small], hi[~small]
        for i in range(0, len(a), 4096):
            lo_rank, hi_rank = (_all_ranks(sampled, before, e[i : i + 4096], step) for e in (a, b))
            some = hi_rank > lo_rank
            next_lo.append((starts + lo_rank)[some])
            next_hi.append((starts + hi_rank)[some])
        lo, hi = np.concatenate(next_lo), np.concatenate(next_hi)
        fresh = np.flatnonzero(~marked[hi])
        if len(fresh):
            hi, first = np.unique(hi[fresh], return_index=True)
            lo = lo[fresh[first]]
            marked[hi] = True
        else:
            lo = hi = np.zeros(0, np.int64)
    return ~marked[:n]


def _all_ranks(sampled: np.ndarray, before: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    out = sampled[at // step].astype(np.int64)
    for j in range(step - 1):
        more = np.flatnonzero(at % step > j)
        out[more, before[at[more] // step * step + j]] += 1
    return out


def repeated_windows(texts: list[bytes], weights: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each text the starts of its windows that occur again in any of them.

    weights[i][p] is the number of places at which the window of text i from p stands (1 where not given): a window of
    two places is repeated by itself.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    x = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes) - 1
    x[ends] = 1
    x[-1] = 0  # the one smallest symbol, so that the text can be taken as a ring
    order = suffixes(x, LENGTH)
    mark = shared_prefixes(x, order, LENGTH)
    weight = np.ones(len(x), np.int64)
    for e, t, w in zip(ends, texts, weights or (), strict=False):
        weight[e - len(t) : e - len(t) + len(w)] = w
    # What is left of the intervals: runs of suffixes that share LENGTH symbols with their neighbours.
    begin = np.flatnonzero(~mark)
    many = np.add.reduceat(weight[order], begin) > 1
    hit = np.zeros(len(x), bool)
    hit[order] = np.repeat(many, np.diff(np.append(begin, len(x))))
    return [np.flatnonzero(hit[e - len(t) : max(e - len(t), e - LENGTH + 1)]) for e, t in zip(ends.tolist(), texts, strict=True)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(start, windows) of the runs of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(r[0]), len(r)) for r in np.split(starts, cut)]


def _packed(start: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """A segment's place in one number; windows and lead are below 256."""
    return (start.astype(np.int64) << 16) | (windows.astype(np.int64) << 8) | lead.astype(np.int64)


def _places(docs: DataFrame) -> DataFrame:
    """A row for each segment of each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            doc, anchor, content, start, windows, lead = segments(data, off)
            cols = [b.column(0).take(pa.array(doc)), pa.array(anchor), pa.array(content), pa.array(_packed(start, windows, lead))]
            yield pa.RecordBatch.from_arrays(cols, ["row_key", "anchor", "content", "at"])

    rows = docs.select("row_key", "text").mapInArrow(task, "row_key long, anchor long, content long, at long")
    return rows.filter("anchor is not null and content is not null and row_key is not null")  # so that all uses share one exchange


def _lists(wanted: DataFrame, *more: str) -> DataFrame:
    """The wanted segments of each text."""
    return wanted.groupBy(F.col("row_key").alias("key")).agg(F.collect_list(F.struct("at", "anchor", "content", "n", *more)).alias("cuts"))


def _cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, cells, bytes): the bytes of the wanted segments. A text meets the list of its own segments.

    cells are five numbers for each segment in bytes: anchor, content, its first byte, windows, occurrences (2 for more).
    Neighbouring segments that are alone with their anchors stay together.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            anchors: list[int] = []
            cells: list[bytes] = []
            cut: list[bytes] = []
            done = set()
            for d, (key, cuts) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if key in done:  # a copy of a row
                    continue
                done.add(key)
                text = data[off[d] : off[d + 1]]
                parts: list[list[tuple]] = []
                follows = -1
                for c in sorted(cuts, key=lambda c: c["at"]):
                    start, windows = c["at"] >> 16, c["at"] >> 8 & 255
                    cell = (c["anchor"], c["content"], start, windows, min(c["n"], 2))
                    if c["alone"] and start == follows and start + windows - parts[-1][0][2] < BLOCK_BYTES:
                        parts[-1].append(cell)
                    else:
                        parts.append([cell])
                    follows = start + windows if c["alone"] else -1
                for p in parts:
                    own = np.array(p, np.int64)
                    first, last = int(own[0, 2]), int(own[-1, 2] + own[-1, 3]) + LENGTH - 1
                    own[:, 2] -= first
                    anchors.append(p[0][0])
                    cells.append(own.tobytes())
                    cut.append(text[first:last].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(cells, pa.binary()), pa.array(cut, pa.binary())], ["anchor", "cells", "bytes"])

    # Copies of a row have the same key and text: if several batches cut them, the first stands for all.
    cut = texts.join(_lists(wanted, "alone"), F.col("row_key") == F.col("key")).select("row_key", "doc_id", "text", "cuts")
    return cut.mapInArrow(task, "anchor long, cells binary, bytes binary")


def _expand(cut: DataFrame) -> DataFrame:
    """(anchor, content, first, windows): runs of repeated windows in segments, by blocks of whole anchors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bytes, bytes] = {}
        size, last = 0, None

        def done() -> pa.RecordBatch:
            cells = [np.frombuffer(c, np.int64).reshape(-1, 5) for c in waiting]
            weights = [np.repeat(c[:, 4], c[:, 3]) for c in cells]
            found: list[tuple[int, int, int, int]] = []
            for own, hits in zip(cells, repeated_windows(list(waiting.values()), weights), strict=True):
                for anchor, content, first, windows, _ in own.tolist():
                    lo, hi = np.searchsorted(hits, [first, first + windows])
                    found += [(anchor, content, s - first, w) for s, w in _runs(hits[lo:hi])]
            cols = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "content", "first", "windows"])

        for b in batches:
            for anchor, cells, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting and anchor != last and size + len(data) > BLOCK_BYTES:
                    yield done()
                    waiting, size = {}, 0
                if cells not in waiting:
                    waiting[cells] = data
                    size += len(data)
                last = anchor
        if waiting:
            yield done()

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(task, "anchor long, content long, first int, windows int")


def _folded(places: DataFrame, n: Column) -> DataFrame:
    """One place of each different segment, with the number of its places; both are combined before the shuffle."""
    return places.groupBy("anchor", "content").agg(F.sum(n).alias("n"), F.min("row_key").alias("row_key"), F.min_by("at", "row_key").alias("at"))


def _parts(texts: DataFrame, crowded: DataFrame) -> DataFrame:
    """The segments of crowded anchors in parts of a few windows, as places under a key of more context.

    The windows of a part have their anchor 2 bytes apart at most; the key is a hash of the bytes that all windows of
    such a part have in common, so its segments differ by a few bytes at their ends, and one key's different segments
    are few however many texts share the anchor.
    """
    group = np.arange(WINDOW) * PARTS // WINDOW
    low = np.searchsorted(group, np.arange(PARTS))  # least and greatest lead of each part
    high = np.append(low[1:], WINDOW) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            found: list[np.ndarray] = []
            for d, (key, cuts) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                text = data[off[d] : off[d + 1]]
                for c in cuts:
                    start, windows, lead = c["at"] >> 16, c["at"] >> 8 & 255, c["at"] & 255
                    own = text[start : start + windows + LENGTH - 1]
                    h, g = prefix_hash(own), prefix_hash(own, OTHER_BASE)
                    p = np.arange(group[lead - windows + 1], group[lead] + 1)
                    # The window i of a segment has its anchor lead - i bytes behind its start.
                    first, last = np.maximum(lead - high[p], 0), np.minimum(lead - low[p], windows - 1)
                    shared = span_hash(h, lead - low[p], lead + LENGTH - high[p]) ^ mix(p.astype(U64))
                    content = span_hash(g, first, last + LENGTH, OTHER_BASE) ^ mix((lead - first).astype(U64))
                    rows = np.empty((len(p), 8), np.int64)
                    rows[:, 0] = key
                    rows[:, 1], rows[:, 2] = shared.view(np.int64), content.view(np.int64)
                    rows[:, 3] = _packed(start + first, last - first + 1, lead - first)
                    rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7] = c["n"], c["anchor"], c["content"], first
                    found.append(rows)
            cols = np.concatenate(found).T if found else np.zeros((8, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["row_key", "anchor", "content", "at", "n", "whole_anchor", "whole", "skip"])

    cut = texts.join(_lists(crowded), F.col("row_key") == F.col("key")).select("row_key", "doc_id", "text", "cuts")
    rows = cut.mapInArrow(task, "row_key long, anchor long, content long, at long, n long, whole_anchor long, whole long, skip long")
    return rows.dropDuplicates(["whole_anchor", "whole", "skip"])  # copies of a row were cut alike


def removed_ranges(texts: DataFrame) -> DataFrame:
    """(row_key, range): runs of repeated windows, start * 256 + windows. texts has row_key, doc_id and text, and is
    dealt by row_key."""
    several = F.col("n") > 1
    places = _places(texts.select("row_key", "text"))
    again = places.groupBy("anchor").agg(F.count("*").alias("n")).filter(several).select("anchor")
    met = places.join(again, "anchor")
    kinds = _folded(met, F.lit(1))
    size = F.sum(F.shiftright("at", 8).bitwiseAND(F.lit(255)) + F.lit(LENGTH - 1))
    by_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), size.alias("size"))
    wanted = kinds.join(by_anchor.select("anchor", (F.col("kinds") == 1).alias("alone"), (F.col("size") > CROWD_BYTES).alias("crowded")), "anchor")
    hits = _expand(_cut_out(texts, wanted.filter("not crowded")))

    parts = _parts(texts, wanted.filter("crowded"))
    folded = _folded(parts, F.col("n"))
    meet = folded.groupBy("anchor").agg(F.sum("n").alias("n")).filter(several).select("anchor")
    fine = _expand(_cut_out(texts, folded.join(meet, "anchor").withColumn("alone", F.lit(False))))
    fine = parts.select("anchor", "content", "whole_anchor", "whole", "skip").join(fine, ["anchor", "content"])
    fine = fine.select(F.col("whole_anchor").alias("anchor"), F.col("whole").alias("content"), (F.col("skip") + F.col("first")).cast("int").alias("first"), "windows")

    found = met.join(hits.unionByName(fine), ["anchor", "content"])
    return found.select("row_key", ((F.shiftright("at", 16) + F.col("first")) * 256 + F.col("windows")).alias("range"))


def repeated_strings_removed(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; null without with_bytes) and kept_sha256 of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows equal in doc_id and text share a key; places count them as two.
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    ranges = removed_ranges(keyed).groupBy(F.col("row_key").alias("key")).agg(F.collect_set("range").alias("ranges"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            cols: list[list] = [[] for _ in range(5)]
            for d, ranges in enumerate(b.column(3).to_pylist()):
                text = data[off[d] : off[d + 1]]
                depth = np.zeros(len(text) + 1, np.int64)
                if ranges:
                    r = np.array(ranges, np.int64)
                    np.add.at(depth, r >> 8, 1)
                    np.add.at(depth, (r >> 8) + (r & 255) + LENGTH - 1, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = text[~gone].tobytes()
                row = (len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept if with_bytes else None, hashlib.sha256(kept).hexdigest())
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    full = keyed.join(ranges, F.col("row_key") == F.col("key"), "left").select("row_key", "doc_id", "text", "ranges")
    return full.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
