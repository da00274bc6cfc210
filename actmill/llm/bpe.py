"""Operator 9: BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The tokenizer file (normaliser NFC, white space to blanks, lower case; words by a fixed pattern; bytes as characters; word
ends marked) is read on the driver and sent to the tasks; its size is fixed by the vocabulary. All words of the table are
counted; those frequent enough to be among the LEXICON most frequent are merged once and compiled into a minimal acyclic
automaton: words with common suffixes share states, and each edge has the number of words that precede its subtree, so
that a walk yields the word's place in an array of ids. The automaton is one flat byte string, which each task maps from
an unnamed temporary file. Words that it doesn't hold are merged exactly, by a heap over neighbouring pairs.

Special tokens in a text are recognised as the library does by default: before normalisation, as their ids. Decoding
joins the tokens of the ids by blanks, as the library does for a file without a decoder.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated rows get
equal results; a null doc_id is a row like any other.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import re
import string
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed, extended, small_batches

LEXICON, LONGEST_WORD = 100_000, 64
KNOWN_WORDS = 300_000
SPAN, NEVER = 1 << 20, 1 << 62
#: Fixed values of the tokenizer file: white space, and the pattern of words once white space is blanks.
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ASCII_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
MARKS = re.compile("[\x1c-\x1f]")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")


def words_of(chunk: str) -> list[str]:
    """The words of a lower-cased piece without white space."""
    core = chunk.rstrip(string.punctuation)
    if core.isalpha():  # a word and the marks behind it: no other split is possible
        return [core, chunk[len(core) :]] if len(core) < len(chunk) else [core]
    return (ASCII_WORD if chunk.isascii() else WORD).findall(chunk)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Ids and merges of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By the ids of two neighbours: the rank of their merge, and the id it gives, in one number.
        self.merges = {self.ids[a] * SPAN + self.ids[b]: i * SPAN + self.ids[a + b] for i, (a, b) in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.names = {i: str(i) for i in self.tokens}
        characters = byte_characters()
        self.inner = [self.ids.get(c, -1) for c in characters]
        self.last = [self.ids.get(c + self.end, -1) for c in characters]
        self.complete = -1 not in self.inner and -1 not in self.last  # each byte has a token
        self.inner_array, self.last_array = np.array(self.inner), np.array(self.last)
        order = sorted(self.merges)
        self.pairs, self.values = np.array(order, np.int64), np.array([self.merges[k] for k in order], np.int64)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def chunks(self, text: str) -> list[str]:
        """The pieces between blanks of a normalised text without special tokens; words lie within them."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased character by character: no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        # Python's white space is the library's, and four separators that the library takes for marks.
        return SPACE.split(text) if MARKS.search(text) else text.split()

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text, and whether each is a special token."""
        if self.split is None or "<|" not in text:
            yield text, False
            return
        at = 0
        for m in self.split.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the neighbouring pair of lowest rank is joined, the leftmost first, until none is known."""
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[c] for c in data]
        ids[-1] = self.last[data[-1]]
        if -1 in ids:  # a byte without a token
            ids = [i for i in ids if i >= 0]
        return self._merge_long(ids) if len(ids) > 64 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        known = [get(a * SPAN + b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while known:
            best = min(known)
            if best == NEVER:
                break
            i = known.index(best)
            ids[i : i + 2] = [best % SPAN]
            del known[i]
            if i:
                known[i - 1] = get(ids[i - 1] * SPAN + ids[i], NEVER)
            if i < len(known):
                known[i] = get(ids[i] * SPAN + ids[i + 1], NEVER)
        return ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The same for many short words at once: in each round every word joins its pair of lowest rank."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        width = int(size.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        row, ends = np.repeat(np.arange(len(words)), size), np.cumsum(size)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[row, np.arange(len(flat)) - np.repeat(ends - size, size)] = self.inner_array[flat]
        ids[np.arange(len(words)), size - 1] = self.last_array[flat[ends - 1]]

        def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = np.where((a >= 0) & (b >= 0), a * SPAN + b, -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            return np.where(self.pairs[at] == key, self.values[at], NEVER)

        out = ids.copy()
        left, known = np.arange(len(words)), value(ids[:, :-1], ids[:, 1:])
        column = np.arange(width + 1)
        while len(left):
            i = known.argmin(axis=1)
            rows = np.arange(len(left))
            best = known[rows, i]
            go = best < NEVER
            out[left[~go]] = ids[~go]
            left, ids, known, i, best = left[go], ids[go], known[go], i[go], best[go]
            rows = rows[: len(left)]
            after = column[None, :] > i[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[rows, i] = best % SPAN
            known[:, :-1] = np.where(after[:, :-2], known[:, 1:], known[:, :-1])
            known[:, -1] = NEVER
            known[rows, i] = value(ids[rows, i], ids[rows, i + 1])
            some = np.flatnonzero(i > 0)
            known[some, i[some] - 1] = value(ids[some, i[some] - 1], ids[some, i[some]])
        return [x[: n].tolist() for x, n in zip(out, (out >= 0).sum(axis=1), strict=True)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i) for i in range(n - 1) if (m := self.merges.get(ids[i] * SPAN + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or self.merges.get(ids[i] * SPAN + ids[j]) != m:
                continue
            ids[i] = m % SPAN
            alive[j] = False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (m := self.merges.get(ids[k] * SPAN + ids[right[k]])) is not None:
                    heapq.heappush(heap, (m, k))
        return [i for i, on in zip(ids, alive, strict=True) if on]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of sorted words, built by freezing each state once its last word is past, and their ids.

    Layout, little-endian uint32: number of states, edges, words, ids; first edge of each state (and the end), whether it
    ends a word; label, target and words before of each edge; first id of each word (and the end); ids.
    """
    registry: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]], int]] = []  # final, edges, words below

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in registry:
            registry[key] = len(frozen)
            frozen.append((final, edges, final + sum(frozen[t][2] for _, t in edges)))
        return registry[key]

    path: list[list] = [[False, []]]  # states of the last word, from the root
    last = b""
    ordered = sorted(words)
    for w in ordered:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(*state)))
        path.extend([False, []] for _ in range(len(w) - common))
        path[-1][0] = True
        last = w
    while len(path) > 1:
        state = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(*state)))
    root = freeze(*path[0])
    assert root == len(frozen) - 1
    first = np.cumsum([0, *(len(e) for _, e, _ in frozen)])
    labels, targets, before = [], [], []
    for final, edges, _ in frozen:
        count = int(final)
        for c, t in edges:
            labels.append(c)
            targets.append(t)
            before.append(count)
            count += frozen[t][2]
    ids = [words[w] for w in ordered]
    parts = [[len(frozen), len(labels), len(ordered), sum(map(len, ids))], first, [f for f, _, _ in frozen], labels, targets, before, np.cumsum([0, *map(len, ids)]), [i for x in ids for i in x]]
    return b"".join(np.asarray(p, "<u4").tobytes() for p in parts)


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, compiled: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(compiled)
        self.file.flush()
        flat = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), "<u4")
        states, edges, words, _ = flat[:4].tolist()
        cut = np.cumsum([4, states + 1, states, edges, edges, edges, words + 1])
        self.first, self.final, self.label, self.target, self.before, self.start = (memoryview(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False))
        self.ids = flat[cut[-1] :]
        self.root = states - 1

    def get(self, word: bytes) -> list[int] | None:
        state, place = self.root, 0
        for c in word:
            lo, hi = self.first[state], self.first[state + 1]
            while lo < hi:
                mid = (lo + hi) // 2
                if self.label[mid] < c:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == self.first[state + 1] or self.label[lo] != c:
                return None
            place += self.before[lo]
            state = self.target[lo]
        if not self.final[state]:
            return None
        return self.ids[self.start[place] : self.start[place + 1]].tolist()


#: Number of ids, the ids as text, the tokens as text. Without lists in it, the garbage collector passes it over.
Piece = tuple[int, str, str]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        #: Words of the lexicon; other words, and pieces between blanks, met lately.
        self.frequent: dict[str, Piece] = {}
        self.words: dict[str, Piece] = {}
        self.chunks: dict[str, Piece] = {}

    def learn(self, words: list[str]) -> None:
        """Look words up in the lexicon; those it does not have are merged together."""
        rest = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            ids = self.lexicon.get(data) if len(data) <= LONGEST_WORD else None
            if ids is not None:
                self.frequent[w] = self.piece(ids)
            elif len(data) <= LONGEST_WORD and self.vocabulary.complete:
                rest.append((w, data))
        if len(self.words) + len(rest) > KNOWN_WORDS:
            self.words.clear()
        rest.sort(key=lambda x: len(x[1]))
        for k in range(0, len(rest), 4096):  # of similar lengths
            part = rest[k : k + 4096]
            for (w, _), ids in zip(part, self.vocabulary.merge_all([d for _, d in part]), strict=True):
                self.words[w] = self.piece(ids)

    def piece(self, ids: list[int]) -> Piece:
        return (len(ids), " ".join([self.vocabulary.names[i] for i in ids]), self.decode(ids))

    def word(self, word: str) -> Piece:
        return self.frequent.get(word) or self.words.get(word) or self.piece(self.vocabulary.merge(word))

    def chunk(self, chunk: str) -> Piece:
        pieces = [x for w in words_of(chunk) if (x := self.word(w))[0]]
        found = pieces[0] if len(pieces) == 1 else (sum([x[0] for x in pieces]), " ".join([x[1] for x in pieces]), " ".join([x[2] for x in pieces]))
        if len(chunk) <= LONGEST_WORD:
            self.chunks[chunk] = found
        return found

    def encode_all(self, texts: list[str]) -> Iterator[list[Piece]]:
        """For each text its pieces and special tokens that have ids. New words of all texts are learnt together."""
        split = [[(part if special else self.vocabulary.chunks(part), special) for part, special in self.vocabulary.parts(t)] for t in texts]
        if len(self.chunks) >= KNOWN_WORDS:
            self.chunks.clear()
        new = {c for parts in split for part, special in parts if not special for c in part if c not in self.chunks}
        words = {w for c in new for w in words_of(c)}
        self.learn([w for w in words if w not in self.frequent and w not in self.words])
        known, make = self.chunks, self.chunk
        for parts in split:
            out = []
            for part, special in parts:
                out += [(1, str(self.vocabulary.special[part]), part)] if special else [known.get(c) or make(c) for c in part]
            yield [x for x in out if x[0]]

    def decode(self, ids: list[int]) -> str:
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids])


def word_counts(docs: DataFrame, content: str) -> DataFrame:
    """(word, n) over all texts, special tokens left out."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(sent.value), Counter()

        def rows() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in counts.items():
                for w in words_of(chunk):
                    words[w] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for part, special in vocabulary.parts(text or ""):
                    if not special:
                        counts.update(vocabulary.chunks(part))
                if len(counts) > 4 * KNOWN_WORDS:  # what a task holds is bounded
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> list[str]:
    """Words of at most LONGEST_WORD bytes, LEXICON of them at most: all above a count taken from a histogram of counts."""
    short = counts.filter(F.octet_length("word") <= LONGEST_WORD)
    size = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 16))
    bins = short.groupBy(size.alias("size")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r["size"]):
        total += r["kinds"]
        if total > LEXICON:
            break
        least = r["least"]
    return [] if least is None else [bytes(r[0]).decode("utf-8", "surrogatepass") for r in short.filter(F.col("n") >= least).select("word").collect()]


def lexicon_of(docs: DataFrame, content: str) -> bytes:
    vocabulary = Vocabulary(content)
    words = frequent_words(checkpointed(word_counts(docs, content)))
    return compile_lexicon({w.encode("utf-8", "surrogatepass"): vocabulary.merge(w) for w in words})


def with_tokens(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """docs without its text, with n_tokens, and ids (array of int) and decoded (string), or the SHA-256 of both as text.

    Columns of the names of the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        content = f.read()
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"n_tokens": "long", "ids": "array<int>", "decoded": "string"}
    docs = docs.drop(*kinds)
    at = docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]
    schema = extended(docs.drop("text").schema, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    sent = docs.sparkSession.sparkContext.broadcast((content, lexicon_of(docs, content)))

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(sent.value[0]), Lexicon(sent.value[1]))
        gc.freeze()  # the vocabulary stays; collections pass it over
        for b in batches:
            n, first, second = [], [], []
            for words in encoder.encode_all([t or "" for t in b.column(at).to_pylist()]):
                n.append(sum([w[0] for w in words]))
                decoded = " ".join([w[2] for w in words])
                ids = " ".join([w[1] for w in words])
                first.append(digest(ids) if digests else [int(i) for i in ids.split()])
                second.append(digest(decoded) if digests else decoded)
            cols = [pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *cols], [*(b.schema.names[i] for i in keep), *kinds])

    return docs.mapInArrow(task, schema)
