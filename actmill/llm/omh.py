"""Operator 1: near-duplicate classes by Order MinHash, with banded alignment of the candidates.

Each text becomes the sequence of its five-word shingles (words are runs without white space, in lower case). A shingle
is labelled with its occurrence number. A sketch entry takes the TUPLE smallest labelled shingles under one hash
function and keeps their order in the text; texts collide in an entry with a chance that falls with their edit
distance, not only with their sets. Colliding texts are candidates at three depths: one entry, two and three
neighbouring entries. In each bucket every text is first a candidate of the bucket's smallest one, so a bucket of n
texts gives n - 1 pairs, and the deeper buckets give a text nearer partners than the first one of a crowd. Where texts
of several classes then still share an entry, all pairs of different classes are judged, block by block of a bucket, in
the task where the blocks meet: counts of shingles in about as many bins as shingles bound the likeness from above, and
the pairs whose bound allows it are aligned in order of their bounds, unless their classes have met by then. So any two
texts that share an entry have been judged or are in one class already; deeper buckets hold no other pairs.

A candidate pair is linked if banded alignment finds a common subsequence of c shingles, in order, with
c / (m + n - c) >= 0.8 for sequences of m and n shingles. At that likeness the texts differ by at most (m + n) / 9
insertions and deletions, so an alignment inside that band is exact for the decision.

Classes are the connected components of the links and of equal texts.

Defined results: a null text counts as empty; texts without words are equal to each other only if they are the same
text; a text of one to four words is one shingle; a row with a null doc_id is classed like any other, with class_id the
smallest id of its class (null if all are null); repeated rows fall in one class and each keeps its row. Other columns
of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import BASE, OTHER_BASE, U64, checkpointed, lowered, mix, shingle_hashes, slices, small_batches, utf8, word_hashes

SHINGLE_WORDS, LIKENESS = 5, 0.8
ENTRIES, TUPLE, DEPTHS = 16, 3, 3
#: Fewest and most bins of a text's shingle counts; texts, and shingles, of a block where all pairs of a bucket are compared.
FEWEST_BINS, MOST_BINS, BLOCK, BLOCK_SHINGLES = 512, 2048, 256, 1 << 18
#: Rows of a partition where components are sought.
ROUND_ROWS = 1 << 16
_ODD = mix(np.arange(1, ENTRIES + 1, dtype=U64)) | U64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's hash with its occurrence number mixed in."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(shingles)
    out[order] = mix(s + occurrence.astype(U64) * U64(BASE))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """ENTRIES hashes, each of the TUPLE smallest labelled shingles in text order."""
    marked = labelled(shingles)
    n = min(TUPLE, len(marked))
    chosen = np.empty((ENTRIES, n), np.int64)
    for i, odd in enumerate(_ODD):
        h = marked * odd
        h ^= h >> U64(32)
        h *= U64(BASE)
        chosen[i] = np.argpartition(h, n - 1)[:n] if n < len(h) else np.arange(n)
    chosen.sort(axis=1)
    acc = np.arange(1, ENTRIES + 1, dtype=U64)
    for j in range(n):
        acc = acc * U64(OTHER_BASE) + marked[chosen[:, j]]
    return mix(acc)


def buckets(entries: np.ndarray) -> np.ndarray:
    """The keys of all depths: entry i alone, with its follower, with its two followers. No key fits two places."""
    keys, acc = [entries], entries  # an entry's number is part of its hash
    for d in range(1, DEPTHS):
        acc = mix(acc * U64(BASE) + np.roll(entries, -d) + U64(d))
        keys.append(acc)
    return np.concatenate(keys)


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within band of the diagonal.

    Bit-parallel: the bits of a window of 2 * band + 1 columns are the row's zero differences, and the window moves one
    column a row, so that memory depends on the band alone.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    v, common = full, 0
    for i, x in enumerate(a.tolist()):
        low = i - band
        hits = places.get(x)
        if hits:
            m = 0
            for j in hits:
                if 0 <= j - low < width:
                    m |= 1 << (j - low)
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & full
        if not v & 1:
            common += 1
        v = v >> 1 | top
    return common + width - v.bit_count()


def alike(a: np.ndarray, b: np.ndarray, least: float = LIKENESS) -> float:
    """Common shingles in order over all shingles; 0 where it cannot reach least."""
    m, n = len(a), len(b)
    if not m or not n or min(m, n) < least * max(m, n):
        return 0.0
    same = min(m, n)
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    rest = same - head
    differ = np.flatnonzero(a[m - rest :][::-1] != b[n - rest :][::-1]) if rest else np.zeros(0, np.int64)
    tail = int(differ[0]) if len(differ) else rest
    x, y = a[head : m - tail], b[head : n - tail]
    edits = int((m + n) * (1 - least) / (1 + least) + 1e-9)
    if len(x) and len(y):
        inner, counts = np.unique(np.concatenate([np.unique(x), np.unique(y)]), return_counts=True)
        if len(x) + len(y) - 2 * min(len(x), len(y), _shared(x, y, inner[counts > 1])) > edits:
            return 0.0
        c = head + tail + banded_common(x, y, edits)
    else:
        c = head + tail
    return c / (m + n - c)


def _shared(x: np.ndarray, y: np.ndarray, both: np.ndarray) -> int:
    """Size of the multiset intersection: no alignment has more matches."""
    if not len(both):
        return 0
    nx, ny = (np.bincount(np.searchsorted(both, z[np.isin(z, both)]), minlength=len(both)) for z in (x, y))
    return int(np.minimum(nx, ny).sum())


def binned(shingles: np.ndarray) -> bytes:
    """The number of shingles (of 32 bits) in each bin, in a byte; nothing for a text in which a bin overflows, which bounds no pair.

    The bins are a power of two, not fewer than the shingles within the limits, so that the bound of long texts is as
    tight as that of short ones.
    """
    bins = min(max(1 << (len(shingles) - 1).bit_length(), FEWEST_BINS), MOST_BINS)
    counts = np.bincount(shingles // ((1 << 32) // bins), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """The same counts in fewer bins."""
    return counts if counts.shape[-1] == bins else counts.reshape(*counts.shape[:-1], bins, -1).sum(axis=-1, dtype=np.uint16)


def bounds(sizes: np.ndarray, bins: list[bytes], its_sizes: np.ndarray, its_bins: list[bytes], wanted: np.ndarray | None = None) -> np.ndarray:
    """The most that the likeness of each pair of two blocks can be: a matrix, 0 where that is below LIKENESS or not wanted.

    A pair has no more common shingles than its sizes and its bins allow.
    """
    short, long = np.minimum.outer(sizes, its_sizes), np.maximum.outer(sizes, its_sizes)
    out = np.where((short >= LIKENESS * long) & (True if wanted is None else wanted), short / long, 0.0)
    held = np.array([len(x) for x in its_bins])
    groups = {n: np.flatnonzero(held == n) for n in np.unique(held[held > 0]).tolist()}
    theirs = {n: np.stack([np.frombuffer(its_bins[j], np.uint8) for j in at]) for n, at in groups.items()}
    for i, x in enumerate(bins):
        for n, at in groups.items() if x else ():
            fit = out[i, at] > 0
            if fit.any():
                fewer = min(n, len(x))
                common = np.minimum(folded(np.frombuffer(x, np.uint8), fewer), folded(theirs[n][fit], fewer)).sum(axis=1, dtype=np.int64)
                most = common / (sizes[i] + its_sizes[at[fit]] - common)
                out[i, at[fit]] = np.where(most >= LIKENESS, most, 0.0)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(key, size, entries) of each row whose text has words; size is its number of shingles."""
    src = lowered(docs.select(F.col("text")).withColumn("key", text_key(F.col("text"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out, which, sizes = b.column(1), [], [], []
            data, off = utf8(b.column(0))
            for lo, hi in slices(off):
                words, counts = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sh, n = shingle_hashes(words, counts, SHINGLE_WORDS)
                ends = np.cumsum(n)
                for d in np.flatnonzero(n):
                    out.append(buckets(sketch(sh[ends[d] - n[d] : ends[d]])).view(np.int64))
                    which.append(lo + int(d))
                    sizes.append(int(n[d]))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * ENTRIES * DEPTHS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(which, pa.int64())), pa.array(sizes, pa.int64()), lists], ["key", "size", "entries"])

    return src.mapInArrow(task, "key long, size long, entries array<long>")


def text_key(text: Column) -> Column:
    """64-bit hash: equal texts, equal keys. Of n different texts, some n * n / 2**65 pairs meet: 3 among 10 billion."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def candidates(sketches: DataFrame) -> DataFrame:
    """Distinct pairs (hub, key), hub < key: in each bucket, every text with the bucket's smallest key.

    The bucket's smallest key comes from an aggregate that combines before the shuffle, so a bucket of any size is never
    gathered; the join that gives it back to the members splits hot buckets.
    """
    members = sketches.select("key", F.explode("entries").alias("value"))
    hubs = members.groupBy("value").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub <> last").drop("last")
    return members.join(hubs, "value").filter("key <> hub").select("hub", "key").distinct()


def unsettled(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(value, parts, key, label): the members of the one-entry buckets in which texts of several classes meet.

    A pair that shares a deeper bucket shares its entries, so these buckets hold all pairs. parts is how many blocks the
    bucket makes, by its members and by their shingles.
    """
    labels = sketches.join(classes, "key", "left").withColumn("label", F.coalesce("class_key", "key"))
    members = labels.select("key", "size", "label", F.explode(F.slice("entries", 1, ENTRIES)).alias("value"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("parts")
    mixed = members.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), parts).filter("low <> high").select("value", "parts")
    return members.join(mixed, "value").drop("size")


class Merged:
    """Union-find over class labels, inside one pair of blocks."""

    def __init__(self) -> None:
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.of.get(root, root)) != root:
            root = up
        while (up := self.of.get(x, x)) != root:
            self.of[x], x = root, up
        return root

    def union(self, x: int, y: int) -> None:
        self.of[self.find(x)] = self.find(y)


def judged(value: int, own: tuple, its: tuple, same: bool) -> Iterator[tuple[int, int, float]]:
    """The links (hub, key, likeness) between two blocks of a bucket that join classes; own and its are the same block if same.

    own and its are keys, labels, entries (a line for each text) and shingles. The pairs of texts of different classes that
    can be alike are taken in order of their bounds; those whose classes have been joined on the way need no alignment. A
    pair that shares an earlier entry as well is judged in that entry's bucket.
    """
    (k, c, e, x), (its_k, its_c, its_e, its_x) = own, its
    n, its_n = (np.array([len(s) for s in y]) for y in (x, its_x))
    wanted = np.not_equal.outer(c, its_c)
    if same:
        wanted &= np.less.outer(k, its_k)
    if not wanted.any():
        return
    most = bounds(n, [binned(s) for s in x], its_n, [binned(s) for s in its_x], wanted)
    i, j = np.nonzero(most)
    if not len(i):
        return
    here = e[i, (e[i] == its_e[j]).argmax(axis=1)] == value
    i, j = i[here], j[here]
    merged = Merged()
    for at in np.argsort(-most[i, j], kind="stable").tolist():
        a, b = i[at], j[at]
        one, two = merged.find(int(c[a])), merged.find(int(its_c[b]))
        if one != two and (score := alike(x[a], its_x[b])) >= LIKENESS:
            merged.union(one, two)
            yield min(int(k[a]), int(its_k[b])), max(int(k[a]), int(its_k[b])), score


def judged_links(members: DataFrame, sketches: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links between the classes of members: all pairs of a bucket, block by block, bounded and aligned in one place.

    Sequences travel with the blocks, once for each bucket and side, and not with pairs; what comes out are links. Blocks
    of a bucket meet in a plain join, which the adaptive plan can split; a bucket of one block needs none.
    """
    facts = seqs.join(sketches.select("key", F.slice("entries", 1, ENTRIES).alias("entries")), "key")
    dealt = members.join(facts, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")))
    gathered = lambda rows: rows.groupBy("value", "block").agg(F.collect_list(F.struct("key", "label", "entries", "shingles")).alias("own"))
    none = F.array().cast("array<struct<key: bigint, label: bigint, entries: array<bigint>, shingles: binary>>")
    alone = gathered(dealt.filter("parts = 1")).select("value", "own", none.alias("its"))
    blocks = gathered(dealt.filter("parts > 1"))
    others = blocks.select("value", F.col("block").alias("its_block"), F.col("own").alias("its"))
    # A block meets itself as an empty other side.
    met = blocks.join(others, "value").filter("block <= its_block").select("value", "own", F.when(F.col("block") < F.col("its_block"), F.col("its")).otherwise(none).alias("its"))

    def side(rows: pa.StructArray) -> tuple:
        keys, labels, entries, shingles = (rows.field(f) for f in range(4))
        return keys.to_numpy(), labels.to_numpy(), entries.flatten().to_numpy().reshape(len(keys), -1), [np.frombuffer(s, "<u4") for s in shingles.to_pylist()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in range(b.num_rows):
                own = side(b.column(1)[row].values)
                alone = not len(b.column(2)[row].values)
                found += judged(b.column(0)[row].as_py(), own, own if alone else side(b.column(2)[row].values), alone)
            hub, key, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(key, pa.int64()), pa.array(score, pa.float64())], ["hub", "key", "likeness"])

    return alone.unionByName(met).mapInArrow(judge, "hub long, key long, likeness double")


def degrees(links: DataFrame) -> DataFrame:
    return links.select("key").unionByName(links.select(F.col("hub").alias("key"))).groupBy("key").agg(F.count("*").alias("n_links"))


def sequences(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, shingles) of the texts of the pairs."""
    reps = docs.select(text_key(F.col("text")).alias("key"), F.col("text"))
    wanted = pairs.select("key").unionByName(pairs.select(F.col("hub").alias("key"))).distinct()
    src = lowered(reps.join(wanted, "key", "left_semi"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for lo, hi in slices(off):
                words, counts = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sh, n = shingle_hashes(words, counts, SHINGLE_WORDS)
                # 32 bits of each shingle are enough to compare two texts: a chance match has odds of n / 2**32.
                ends, short = np.cumsum(n), (sh >> U64(32)).astype("<u4")
                blobs = [short[e - c : e].tobytes() for e, c in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["key", "shingles"])

    # Copies of a text give equal rows; one is kept, and rows are combined before the shuffle.
    return src.mapInArrow(shingled, "key long, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def verified(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts align well enough, with their likeness."""
    both = pairs.join(seqs, "key").join(seqs.select(F.col("key").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
            score = [alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["hub", "key", "likeness"])

    return both.select("hub", "key", "shingles", "hub_shingles").mapInArrow(align, "hub long, key long, likeness double").filter(F.col("likeness") >= LIKENESS)


def components(links: DataFrame) -> DataFrame:
    """(key, class_key) of every linked key: smallest key of its connected component.

    Rounds of neighbour minima with pointer jumping over the links alone; every round is cut by checkpoint(). All steps of
    a round are in as many partitions as their rows need, since many rounds over few rows else make many empty tasks and
    files, each of which the driver has to book. links should be written tables: they are read twice.
    """
    few = 1 + 2 * links.count() // ROUND_ROWS
    beside = F.broadcast if few == 1 else lambda df: df  # rows of one partition go to the other side without a shuffle
    links = links.coalesce(few)
    edges = checkpointed(links.select(F.col("hub").alias("u"), F.col("key").alias("v")).unionByName(links.select(F.col("key").alias("u"), F.col("hub").alias("v")))).coalesce(few)
    labels = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("key"), F.least("u", "m").alias("label")).coalesce(few))
    while True:
        seen = edges.join(beside(labels), edges.v == labels.key).coalesce(few).groupBy("u").agg(F.min("label").alias("near")).coalesce(few)
        closer = labels.join(beside(seen), labels.key == seen.u).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label")).coalesce(few)
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        new = checkpointed(closer.join(beside(jump), "label").select("key", "old", F.least("label", "further").alias("label")).coalesce(few))
        labels = new.select("key", "label")
        if new.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "class_key")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, n_links, row_key, keeps.

    n_links counts the links found of its text to other texts; texts already in one class are not compared further.
    row_key is xxhash64(doc_id, text). keeps marks one document of each class: the one of smallest doc_id, on ties of
    smallest text key; rows equal in doc_id and text are marked alike.
    """
    small_batches(docs.sparkSession)
    sketches = checkpointed(sketched(docs).groupBy("key").agg(F.first("size").alias("size"), F.first("entries").alias("entries")))
    tried = checkpointed(candidates(sketches))
    seqs = checkpointed(sequences(docs, tried))  # of all texts that share a bucket, hence of all later pairs
    links = checkpointed(verified(seqs, tried))
    classes = components(links)
    found = checkpointed(judged_links(unsettled(sketches, classes), sketches, seqs).distinct())
    if not found.isEmpty():
        links = links.unionByName(found)
        classes = components(links)
    degree = degrees(links)
    texts = docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    named = texts.join(classes, "key", "left").join(degree, "key", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    # A class's size and first document: one row for each text, combined before the shuffle, and joined back.
    first = F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "key")).alias("first")
    sizes = named.groupBy("class_key").agg(first, F.sum("copies").alias("class_size"))
    known = named.join(sizes, "class_key").select("key", "first_id", F.col("first.first_id").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("first.key") == F.col("key")).alias("leads"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.xxhash64("doc_id", "text").alias("row_key"))
    keeps = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return rows.join(known, "key").select("doc_id", "class_id", "class_size", "n_links", "row_key", keeps.alias("keeps"))
