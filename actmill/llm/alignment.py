"""Operator 13: how two tokenizers cut the same text, aligned token by token, and which tokens of both belong together.

A is a byte-level BPE over a space and the text, B a sentencepiece model over the text (it adds that space itself). Both
cut the same bytes. Tokens whose byte ranges overlap are linked; the graph of the links has tokens of A on one side and
tokens of B on the other, and its connected components are exactly the smallest groups that both tokenizers cut alike.

Work goes by blocks of texts of about BLOCK_BYTES (a longer text is a block alone), inside tasks:

* Links are the pieces between neighbouring ends of either tokenizer: each lies in one token of A and one of B.
* Union-find over all tokens of a block at once: the first link of each token of B hooks it to a token of A; its further
  links hook later tokens of A to that one, each at most once, so all hooks point left; pointer jumping then finds the
  root of each component, its leftmost token, in as many rounds as the logarithm of the longest chain.
* Equal groups (the same ids on both sides) are folded: a block keeps each distinct group once, and each text as a
  sequence of group numbers. Links are expanded from the members of distinct groups, weighted by how often they occur.

Counts of linked id pairs are then summed over all blocks by Spark, and each block gets back the counts of its own pairs
only (a join by pair, then a cogroup by block), so nothing of the size of the corpus meets in one place.

Equal groups are recognised by a 64-bit hash of their ids: of n distinct groups in a block some n * n / 2**65 pairs meet.

Defined results: a null or empty text, or one whose joined token bytes of A or B are not a space and the text, has no
tokens: zeros and an empty groups_sha256. Repeated rows each count, so their links count twice. Rows with a null doc_id
are rows like any other. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import BASE, OTHER_BASE, U64, checkpointed, mix, powers, small_batches

BLOCK_BYTES = 1 << 21
#: Fixed value: how a byte-level BPE of this family splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """Bytes of a vocabulary's entries, by id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.length = np.array([len(e) for e in entries], np.int32)
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.text = [str(i) for i in range(len(entries))]
        self.mark = mix(np.arange(1, len(entries) + 1, dtype=U64) * U64(OTHER_BASE))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        n = self.length[ids]
        ends = np.cumsum(n, dtype=np.int64)
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def byte_level(path: str) -> tuple[object, Pieces]:
    """Encoder and pieces of a byte-level BPE in JSON. Its merges must make its ids in order: then ranks say the same."""
    import tiktoken

    letters = byte_letters()
    model = json.load(open(path, encoding="utf-8"))["model"]
    entries = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if all(c in letters for c in token)}
    ranks = {e: i for i, e in entries.items() if i < 256 + len(model["merges"])}
    for i, m in enumerate(model["merges"]):
        left, right = m.split(" ") if isinstance(m, str) else m
        if model["vocab"][left + right] != 256 + i:
            raise ValueError("merges do not make ids in order")
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), Pieces([entries.get(i, b"") for i in range(max(entries) + 1)])


@lru_cache(maxsize=1)
def piece_model(path: str) -> tuple[object, Pieces]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entry = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, Pieces([entry(i) for i in range(model.vocab_size())])


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all overlapping pairs of two divisions of the same bytes, in order; ends ascend and end alike."""
    size = int(ends_a[-1]) + 1 if len(ends_a) else 0
    of = np.zeros(size, np.uint8)
    of[ends_a] = 1
    of[ends_b] |= 2
    cut = of[np.flatnonzero(of)]
    in_a, in_b = cut & 1, cut >> 1
    return np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b


def components(a: np.ndarray, b: np.ndarray, n_a: int) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links: the root of each token of A, and of each token of B, as an index into A."""
    root = np.arange(n_a)
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    hook = a[first]  # of each token of B
    later = ~first
    root[a[later]] = hook[b[later]]
    moving = np.flatnonzero(root != np.arange(n_a))
    while len(moving):
        now = root[moving]
        further = root[now]
        root[moving] = further
        moving = moving[further != now]
    return root, root[hook]


def _split(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges (start, size) one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def grouped(ids_a: np.ndarray, ids_b: np.ndarray, pieces_a: Pieces, pieces_b: Pieces) -> dict[str, np.ndarray]:
    """Groups of two token sequences over the same bytes, and their distinct kinds.

    of_a, of_b: the group of each token. kind: the kind of each group; start_a, size_a, start_b, size_b: a group of each
    kind; pair, pair_kind: the links of the kinds as id pairs.
    """
    a, b = links_of(np.cumsum(pieces_a.length[ids_a], dtype=np.int64), np.cumsum(pieces_b.length[ids_b], dtype=np.int64))
    root, root_b = components(a, b, len(ids_a))
    leads = root == np.arange(len(root))
    number = np.cumsum(leads) - 1
    of_a, of_b = number[root], number[root_b]
    start_a, start_b = np.flatnonzero(leads), np.flatnonzero(np.diff(of_b, prepend=-1))
    size_a, size_b = np.diff(start_a, append=len(ids_a)), np.diff(start_b, append=len(ids_b))
    with np.errstate(over="ignore"):
        in_a = pieces_a.mark[ids_a] * powers(int(size_a.max(initial=0)))[0][np.arange(len(ids_a)) - start_a[of_a]]
        in_b = pieces_b.mark[ids_b] * powers(int(size_b.max(initial=0)), OTHER_BASE)[0][np.arange(len(ids_b)) - start_b[of_b]]
        mark = mix(np.add.reduceat(in_a, start_a)) * U64(BASE) + mix(np.add.reduceat(in_b, start_b)) if len(start_a) else np.zeros(0, U64)
    _, one, kind = np.unique(mark, return_index=True, return_inverse=True)
    n_links = size_a + size_b - 1
    start_link = np.cumsum(n_links) - n_links
    at = _split(a, start_link[one], n_links[one])
    pair = (ids_a[a[at]].astype(np.int64) << _SHIFT) | ids_b[b[at]]
    return {"of_a": of_a, "of_b": of_b, "kind": kind, "start_a": start_a[one], "size_a": size_a[one], "start_b": start_b[one], "size_b": size_b[one], "pair": pair, "pair_kind": np.repeat(np.arange(len(one)), n_links[one])}


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in two or four bytes each, the first byte says which."""
    wide = int(x.max(initial=0)) >> 16 > 0
    return zlib.compress((b"4" if wide else b"2") + x.astype("<u4" if wide else "<u2").tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    return np.frombuffer(raw, "<u4" if raw[:1] == b"4" else "<u2", offset=1).astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def tokenized(texts: list[str | None], byte_path: str, piece_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of A, tokens of A for each text, ids of B, tokens of B), without the tokens of texts that both do not cut whole."""
    (enc, pieces_a), (model, pieces_b) = byte_level(byte_path), piece_model(piece_path)
    all_a, all_b, n_a, n_b = [], [], [], []
    for t in texts:
        a = b = np.zeros(0, np.int64)
        if t:
            whole = f" {t}"
            x, y = enc.encode_to_numpy(whole).astype(np.int64), np.array(model.encode(t, num_threads=1), np.int64)
            raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
            if all(int(p.length[z].sum()) == len(raw) and np.array_equal(p.joined(z), raw) for p, z in ((pieces_a, x), (pieces_b, y))):
                a, b = x, y
        all_a.append(a)
        all_b.append(b)
        n_a.append(len(a))
        n_b.append(len(b))
    return np.concatenate(all_a), np.array(n_a), np.concatenate(all_b), np.array(n_b)


def groups_text(g: dict[str, np.ndarray], ids_a: np.ndarray, ids_b: np.ndarray, pieces_a: Pieces, pieces_b: Pieces) -> list[str]:
    """Each kind of group as `a1,a2|b1`."""
    say = lambda ids, start, size, text: [",".join([text[i] for i in ids[s : s + n].tolist()]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
    left, right = say(ids_a, g["start_a"], g["size_a"], pieces_a.text), say(ids_b, g["start_b"], g["size_b"], pieces_b.text)
    return [f"{x}|{y}" for x, y in zip(left, right, strict=True)]


_BLOCK = "block long, doc_ids array<long>, n_a binary, n_b binary, n_groups binary, digests array<string>, kinds binary, kind_links binary, kind_pairs binary, pairs array<long>, counts array<long>"


def _block(number: int, ids: list, texts: list[str | None], byte_path: str, piece_path: str) -> dict[str, list]:
    a, n_a, b, n_b = tokenized(texts, byte_path, piece_path)
    pieces_a, pieces_b = byte_level(byte_path)[1], piece_model(piece_path)[1]
    g = grouped(a, b, pieces_a, pieces_b)
    text_of = np.repeat(np.arange(len(texts)), n_a)
    new = np.diff(g["of_a"], prepend=-1) > 0
    n_groups = np.bincount(text_of[new], minlength=len(texts))
    said, kind = groups_text(g, a, b, pieces_a, pieces_b), g["kind"].tolist()
    digests, at = [], 0
    for n in n_groups.tolist():
        digests.append(hashlib.sha256(";".join([said[k] for k in kind[at : at + n]]).encode()).hexdigest() if n else "")
        at += n
    pairs, which = np.unique(g["pair"], return_inverse=True)
    often = np.bincount(g["kind"], minlength=len(said))[g["pair_kind"]]
    counts = np.bincount(which, often, len(pairs)).astype(np.int64)
    links = np.bincount(g["pair_kind"], minlength=len(said))
    return {
        "block": [number], "doc_ids": [ids], "n_a": [_packed(n_a)], "n_b": [_packed(n_b)], "n_groups": [_packed(n_groups)], "digests": [digests], "kinds": [_packed(g["kind"])],
        "kind_links": [_packed(links)], "kind_pairs": [_packed(which)], "pairs": [pairs], "counts": [counts],
    }


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of texts: its documents, their groups by kind, and its id pairs with their counts."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            row = _block(number, ids, texts, byte_path, piece_path)
            return pa.RecordBatch.from_arrays([pa.array(row[n], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and held + len(t or "") > block_bytes:
                    yield done()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t or "")
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all texts, and whether that is the most of its token of B."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    each = checkpointed(each.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))))
    # A row for each id of B's vocabulary at most.
    most = F.broadcast(each.groupBy("b").agg(F.max("n").alias("most")))
    return each.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    blocks = checkpointed(aligned_blocks(docs, byte_path, piece_path, block_bytes))
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(blocks), "pair").select("of", "pair", "n", "best")
    names = [f.split()[0] for f in _REPORT.split(", ")]

    def report(block: pa.Table, facts: pa.Table) -> pa.Table:
        order = np.argsort(facts.column("pair").to_numpy())  # as the block has its pairs
        n, best = facts.column("n").to_numpy()[order], facts.column("best").to_numpy().astype(np.int64)[order]
        row = {c: block.column(c)[0] for c in block.column_names}
        n_a, n_b, n_groups, kind, links, which = (_unpacked(row[c].as_py()) for c in ("n_a", "n_b", "n_groups", "kinds", "kind_links", "kind_pairs"))
        per = [_sums(_sums(x[which], links)[kind], n_groups) for x in (best, n)]
        columns = [row["doc_ids"].values, n_a, n_b, n_groups, n_a + n_b - n_groups, *per, row["digests"].values]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    return blocks.drop("pairs", "counts").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(report, _REPORT)
