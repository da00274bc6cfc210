"""Operator 6: language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; each run of other characters than letters becomes one blank. For each language the model is an
interpolated Kneser-Ney model of order ORDER over characters. Counts of n-grams, continuation counts below the top order,
totals of contexts and the absolute discounts D = n1 / (n1 + 2 * n2) of each order are Spark aggregates over all n-grams
of all training documents; none is dropped, and the model grows with the corpus.

Scoring is a sum of independent lookups. With b the log2 weight that a context hands down, and
d(w) = log2 p(w) - b(context of w) - log2 p(w without its first character) for each n-gram seen, the log probability of a
text in a language is the sum of b over its contexts and of d over its n-grams of all orders, with 0 for what that
language has not seen, plus a constant for each character. So the sorted arrays can be cut into blocks of BLOCK_ROWS
entries by hash: each block is broadcast by itself (about 14 bytes an entry) and adds its share to a text's sums, and
however many entries there are, only the number of blocks grows.

A text's language is the one of lowest cross-entropy in bits a character. The score is a softmax of the cross-entropies,
sharpened by the number of characters up to LONG, times the plausibility that the text is in that language at all. Both
are calibrated on all training texts, each different one counted once: they are scored in the tasks, and Spark sums and
counts their numbers, so that a few facts for each language reach the driver. A text is rejected if it has no letter, or
if its distance from that language's mean entropy, on a scale where 1 is the entropy of a uniform code over the alphabet,
exceeds the language's limit: the 99 % quantile of the training texts with a margin, LEAST_LIMIT at least and 1 at most.
Short texts get an allowance.

Defined results: a null text or one without a letter gets 'und', score 0 and is rejected; ties go to the first language
in alphabetical order; without any training document each text is 'und' with score 0; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.llm.arrays import U64, checkpointed, extended, slices, small_batches, utf8

ORDER = 4
#: Different n-grams that a counting task holds before it passes them on.
HELD_GRAMS = 400_000
BLOCK_ROWS = 4_000_000
LONG = 200
LEAST_LIMIT, MARGIN = 0.8, 1.5
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Parts of 1 to which a quantile is exact; bits of it found in a round; rows of a partition of n-grams or calibration numbers.
FINE, ROUND_BITS, ROUND_ROWS = 1 << 16, 13, 1 << 16
_BITS = 16
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the cleaned texts, each after a blank, and the number of each text's code points.

    Letters outside the first plane share one placeholder.
    """
    joined = "\x00" + "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    border = cp == 0
    if border.sum() != len(texts) + 1:  # a text holds the separator itself
        return characters([t.replace("\x00", " ") for t in texts])
    keep = is_letter | border
    keep[1:] |= is_letter[:-1]  # the first of a run of other characters that follows a letter
    clean = np.where(is_letter, np.minimum(cp, 0xFFFD), 32)[keep]
    border = border[keep]
    last = np.zeros(len(clean), bool)  # a run at a text's end: the next border stands for it
    last[:-1] = (clean[:-1] == 32) & border[1:] & ~border[:-1]
    clean, border = clean[~last], border[~last]
    counts = np.diff(np.flatnonzero(border))
    return clean[: counts.sum()].astype(np.uint32), counts


def codes(cp: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order ORDER, 16 bits a character, and their number for each text; they don't cross texts."""
    n = np.maximum(counts - ORDER + 1, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(counts) - counts, n)
    x = cp.astype(U64)
    out = np.zeros(len(at), U64)
    for j in range(ORDER):
        out = (out << U64(_BITS)) | x[at + j]
    return out, n


#: Tables of a block: d of the n-grams of orders 1 to ORDER, then b of the contexts of 1 to ORDER - 1 characters.
KINDS = 2 * ORDER - 1


@dataclass
class Block:
    """For each kind: sorted keys, and from where to where their languages and values stand."""

    keys: list[np.ndarray]
    start: list[np.ndarray]
    language: list[np.ndarray]
    value: list[np.ndarray]

    @staticmethod
    def of(kind: np.ndarray, gram: np.ndarray, language: np.ndarray, value: np.ndarray) -> Block:
        block = Block([], [], [], [])
        for k in range(KINDS):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.lexsort((language[mine], gram[mine].view(U64)))]
            g = gram[mine].view(U64)
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            block.keys.append(g[first])
            block.start.append(np.append(first, len(g)))
            block.language.append(language[mine].astype(np.int16))
            block.value.append(value[mine].astype(np.float32))
        return block

    def add(self, kind: int, grams: np.ndarray, out: np.ndarray) -> None:
        """Add the values of these n-grams to the rows of out, a column for each language."""
        keys, start = self.keys[kind], self.start[kind]
        if not len(keys):
            return
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        row = np.flatnonzero(keys[at] == grams)
        lo, n = start[at[row]], np.diff(start)[at[row]]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        cell = np.repeat(row, n) * out.shape[1] + self.language[kind][entry]
        out += np.bincount(cell, self.value[kind][entry], out.size).reshape(out.shape)

    def sums(self, cp: np.ndarray, counts: np.ndarray, languages: int) -> np.ndarray:
        """This block's share of each text's log2 probability, (texts, languages)."""
        out = np.zeros((len(counts), languages))
        top, n = codes(cp, counts)
        distinct, inverse = np.unique(top, return_inverse=True)
        value = np.zeros((len(distinct), languages))
        for o in range(1, ORDER + 1):
            self.add(o - 1, distinct & U64((1 << (_BITS * o)) - 1), value)
            if o < ORDER:
                self.add(ORDER + o - 1, (distinct >> U64(_BITS)) & U64((1 << (_BITS * o)) - 1), value)
        text_of = np.repeat(np.arange(len(counts)), n)
        for k in range(languages):
            out[:, k] = np.bincount(text_of, value[inverse, k], len(counts))
        # Texts shorter than the order have no full n-gram: they are scored by single characters.
        short = np.repeat((n == 0) & (counts > 0), counts)
        if short.any():
            chars = cp[short].astype(U64)
            value = np.zeros((len(chars), languages))
            self.add(0, chars, value)
            which = np.repeat(np.arange(len(counts)), counts)[short]
            for k in range(languages):
                out[:, k] += np.bincount(which, value[:, k], len(counts))
        return out


@dataclass
class Model:
    """unseen: log2 probability of a character that a language has not seen, after contexts it has not seen.

    uniform is the entropy of a uniform code over all characters; blocks hold the rest.
    """

    languages: list[str]
    unseen: np.ndarray
    uniform: float
    blocks: list[Block] = field(default_factory=list)
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | None = None

    def lengths(self, cp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The number of scored characters of each text, 0 where there is no letter."""
        has = np.bincount(np.repeat(np.arange(len(counts)), counts), cp != 32, len(counts)) > 0
        n = np.maximum(counts - ORDER + 1, 0)
        return np.where(has, np.where(n > 0, n, counts), 0)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character in each language by all blocks, and the number of scored characters."""
        cp, counts = characters(texts)
        total = sum((b.sums(cp, counts, len(self.languages)) for b in self.blocks), np.zeros((len(texts), len(self.languages))))
        n = self.lengths(cp, counts)
        return -total / np.maximum(n, 1)[:, None] - self.unseen, n

    def far(self, low: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Distance from a language's mean: 0 and less is usual, 1 is no better than a uniform code."""
        allowance = 3 * self.spread[best] / np.sqrt(np.clip(n, 1, LONG))
        return (low - self.mean[best] - allowance) / np.maximum(self.uniform - self.mean[best], 0.5)

    def decide(self, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of texts with these entropies and numbers of characters."""
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(axis=1)
        low = h[np.arange(len(n)), best]
        sharp = np.minimum(n, LONG)[:, None] * self.temperature
        share = 1 / np.exp2(-np.minimum(sharp * (h - low[:, None]), 1000)).sum(axis=1)
        over = self.far(low, best, n) / self.limit[best] - 1
        plausible = 1 / (1 + np.exp(np.clip(10 * over, -50, 50)))
        return ["und" if not c else self.languages[b] for b, c in zip(best, n, strict=True)], np.where(n > 0, share * plausible, 0.0), (n == 0) | (over > 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        return self.decide(*self.entropies(texts))


def _counted(train: DataFrame) -> DataFrame:
    """(lang, gram, n): occurrences of the n-grams of ORDER characters in all training texts."""

    def row(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = np.asarray(b.column(1).to_pylist(), dtype=object)
            _, off = utf8(b.column(0))
            for lo, hi in slices(off):
                texts, own = b.column(0).slice(lo, hi - lo).to_pylist(), langs[lo:hi]
                for lang in sorted(set(own)):
                    keys, n = np.unique(codes(*characters([t for t, x in zip(texts, own, strict=True) if x == lang]))[0], return_counts=True)
                    if lang in sums:
                        keys, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
                    sums[lang] = (keys, n)
                    if len(keys) > HELD_GRAMS:  # what a task holds is bounded
                        yield row(lang, *sums.pop(lang))
        for lang, (keys, n) in sums.items():
            yield row(lang, keys, n)

    return train.select("text", "lang").mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (_BITS * order)) - 1))


def model_rows(counts: DataFrame) -> tuple[DataFrame, dict[str, float], int]:
    """(kind, gram, lang, value): all entries of the models; each language's unseen value; the size of the alphabet.

    counts has the n-grams of order ORDER, as written. Only four discounts for each language and the alphabet's size are
    collected. Each step gives as many partitions as its n-grams need, since there are many steps and few n-grams. Each is
    cut by checkpoint(): else the last plan would hold all steps many times over, and the driver would plan and report it
    anew after each of its stages.
    """
    few = 1 + counts.count() // ROUND_ROWS
    levels = {ORDER: counts.coalesce(few)}
    for o in range(ORDER - 1, 0, -1):  # below, the number of different characters seen in front
        levels[o] = checkpointed(levels[o + 1].groupBy("lang", _suffix(o).alias("gram")).agg(F.count("*").alias("n")).coalesce(few))
    every = reduce(DataFrame.unionByName, (levels[o].select(F.lit(o).alias("o"), "lang", "n") for o in levels))
    facts = every.groupBy("o", "lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.sum("n").alias("total"), F.count("*").alias("kinds")).coalesce(few).collect()
    if not facts:
        return counts.select(F.lit(0).alias("kind"), "gram", "lang", F.lit(0.0).alias("value")), {}, 1
    symbols = levels[1].select("gram").distinct().count() + 1
    discount: dict[int, list[Column]] = {o: [] for o in levels}
    unseen: dict[str, float] = {}
    for r in facts:
        d = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5
        discount[r["o"]] += [F.lit(r["lang"]), F.lit(d)]
        if r["o"] == 1:
            unseen[r["lang"]] = float(np.log2(d * r["kinds"] / r["total"] / symbols))
    out: list[DataFrame] = []
    below: DataFrame | None = None
    for o in range(1, ORDER + 1):
        context = F.shiftrightunsigned("gram", _BITS) if o > 1 else F.lit(0)
        own = levels[o].withColumn("context", context).withColumn("d", F.create_map(*discount[o])[F.col("lang")])
        # A context has at most as many rows as there are characters.
        by = Window.partitionBy("lang", "context")
        own = own.withColumn("total", F.sum("n").over(by)).withColumn("kinds", F.count("*").over(by)).withColumn("back", F.col("d") * F.col("kinds") / F.col("total")).coalesce(few)
        top = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if below is None:
            probs = own.select("lang", "gram", "context", "back", (top + F.col("back") / symbols).alias("p"), F.log2(F.lit(1.0) + top * symbols / F.col("back")).alias("value"))
        else:
            low = below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("low"))
            joined = own.withColumn("rest", _suffix(o - 1)).join(low, ["lang", "rest"]).coalesce(few)
            probs = joined.select("lang", "gram", "context", "back", (top + F.col("back") * F.col("low")).alias("p"), F.log2(F.lit(1.0) + top / (F.col("back") * F.col("low"))).alias("value"))
        below = checkpointed(probs)
        out.append(below.select(F.lit(o - 1).alias("kind"), "gram", "lang", "value"))
        if o > 1:
            weights = below.groupBy("lang", F.col("context").alias("gram")).agg(F.first("back").alias("back")).coalesce(few)
            out.append(weights.select(F.lit(ORDER + o - 2).alias("kind"), "gram", "lang", F.log2("back").alias("value")))
    return reduce(DataFrame.unionByName, out), unseen, symbols


def fit(train: DataFrame) -> Model:
    """Models of all languages in train(text, lang), calibrated on all of it."""
    train = train.filter("text is not null and lang is not null")
    counts = checkpointed(_counted(train))
    rows, unseen, symbols = model_rows(counts)
    if not unseen:
        return Model([], np.zeros(0), 0.0)
    languages = sorted(unseen)
    model = Model(languages, np.array([unseen[x] for x in languages]), float(np.log2(symbols)))
    rows = checkpointed(rows)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    place = {x: i for i, x in enumerate(languages)}
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("kind", "gram"), F.lit(blocks)) == b).toArrow()
        lang = got.column("lang").combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        ids = np.array([place[x] for x in lang.dictionary.to_pylist()] or [0], np.int64)[lang.indices.to_numpy(zero_copy_only=False)]
        model.blocks.append(Block.of(got.column("kind").to_numpy(), got.column("gram").to_numpy(), ids, got.column("value").to_numpy()))
    return _calibrated(model, train)


def _with_sums(docs: DataFrame, model: Model, text: str, finish, new: str) -> DataFrame:
    """docs with further columns, which finish makes from a batch, its entropies and numbers of characters; one pass for each block."""
    sc, k = docs.sparkSession.sparkContext, len(model.languages)
    sent = [sc.broadcast(b) for b in model.blocks]
    bare = Model(model.languages, model.unseen, model.uniform, [], model.temperature, model.mean, model.spread, model.limit)
    at, schema, last = docs.columns.index(text), docs.schema, len(sent) - 1
    own_names, names = docs.columns, extended(schema, new).names

    def one(i: int, df: DataFrame) -> DataFrame:
        block = sent[i] if sent else None

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, off = utf8(b.column(at))
                sums, lengths = [np.zeros((0, k))], [np.zeros(0, np.int64)]
                for lo, hi in slices(off, 1 << 20):
                    cp, counts = characters([t or "" for t in b.column(at).slice(lo, hi - lo).to_pylist()])
                    sums.append(block.value.sums(cp, counts, k) if block else np.zeros((hi - lo, k)))
                    lengths.append(bare.lengths(cp, counts))
                total, n = np.concatenate(sums), np.concatenate(lengths)
                own = list(b.columns)
                if i:
                    total = total + np.array([np.frombuffer(x, np.float64) for x in own.pop().to_pylist()]).reshape(-1, k)
                if i < last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in total], pa.binary())], [*own_names, "_sums"])
                else:
                    cols = finish(bare, b, -total / np.maximum(n, 1)[:, None] - bare.unseen, n)
                    yield pa.RecordBatch.from_arrays([*own, *cols], names)

        return df.mapInArrow(task, extended(schema, new if i >= last else "_sums binary"))

    df = docs
    for i in range(max(len(sent), 1)):
        df = one(i, df)
    return df


def _losses(h: np.ndarray, n: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Log loss of each text's own language at each of TEMPERATURES, (texts, temperatures)."""
    gap, at = h - h.min(axis=1, keepdims=True), np.arange(len(h))
    out = np.zeros((len(h), len(TEMPERATURES)))
    for i, t in enumerate(TEMPERATURES):
        logit = -np.minimum(n, LONG)[:, None] * t * np.log(2) * gap
        out[:, i] = np.log(np.exp(logit).sum(axis=1)) - logit[at, langs]
    return out


def _of_lang(values: dict[str, float]) -> Column:
    """The value of a row's language."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]


def _quantile(rows: DataFrame, value: Column, share: float, texts: dict[str, int], low: dict[str, float], high: dict[str, float]) -> dict[str, float]:
    """For each language the smallest value, in steps of 1 / FINE, that at least that share of its rows do not exceed.

    texts is the number of a language's rows; its values lie from low to high. A round counts the rows in each part of
    the range that holds the wanted one, which becomes the next range, so no rows are gathered or put in order.
    """
    start = {x: int(np.floor(low[x] * FINE)) - 1 for x in texts}
    left = {x: max(1, int(np.ceil(share * n))) for x, n in texts.items()}  # the wanted row's place in the range, from 1
    bits = max(int(np.ceil(high[x] * FINE) + 1 - start[x]).bit_length() for x in texts)
    exact = rows.select("lang", F.floor(value * FINE).alias("v"))
    while bits > 0:
        bits = max(bits - ROUND_BITS, 0)
        part = F.shiftright(F.col("v") - _of_lang(start), bits)
        counts = exact.select("lang", part.alias("part")).filter(F.col("part").between(0, (1 << ROUND_BITS) - 1)).groupBy("lang", "part").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("part")))
        hits = upto.filter(F.col("upto") >= _of_lang(left)).groupBy("lang").agg(F.min(F.struct("part", "upto", "n")).alias("hit")).collect()
        for r in hits:
            start[r["lang"]] += r["hit"]["part"] << bits
            left[r["lang"]] -= r["hit"]["upto"] - r["hit"]["n"]
    return {x: v / FINE for x, v in start.items()}


def _calibrated(model: Model, train: DataFrame) -> Model:
    """Temperature, means, spreads and limits from all training texts; texts that repeat count once.

    What is kept of a text are the entropy in its own language, its length and its losses. Sums are decimal, so that they
    do not depend on the order of rows.
    """
    place = {x: i for i, x in enumerate(model.languages)}
    losses = [f"loss_{i}" for i in range(len(TEMPERATURES))]

    def finish(bare: Model, batch: pa.RecordBatch, entropies: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
        own = entropies[np.arange(len(n)), langs]
        return [pa.array(own), pa.array(n.astype(np.int64)), *map(pa.array, _losses(entropies, n, langs).T)]

    scored = _with_sums(train.select("text", "lang", F.xxhash64("text", "lang").alias("h")), model, "text", finish, "own double, n long, " + ", ".join(f"{x} double" for x in losses))
    rows = checkpointed(scored.drop("text").filter("n > 0").dropDuplicates(["h", "lang"]))
    rows = rows.coalesce(1 + rows.count() // ROUND_ROWS)  # few numbers a text: small tables need few tasks
    root = F.sqrt(F.least("n", F.lit(LONG)))
    total = lambda x, name: F.sum(x.cast("decimal(20,9)")).alias(name)
    sums = [total(F.col("own") * root, "weighted"), total(root, "weight"), *(total(F.col(x), x) for x in losses)]
    facts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("texts"), F.min("own").alias("low"), F.max("own").alias("high"), *sums).collect()}
    k = len(model.languages)
    model.mean, model.spread, model.limit = np.full(k, model.uniform / 2), np.ones(k), np.full(k, LEAST_LIMIT)
    if not facts:
        model.temperature = TEMPERATURES[0]
        return model
    texts = {x: r["texts"] for x, r in facts.items()}
    low, high = ({x: r[side] for x, r in facts.items()} for side in ("low", "high"))
    mean = {x: float(r["weighted"] / r["weight"]) for x, r in facts.items()}
    most = {x: max(mean[x] - low[x], high[x] - mean[x], 0.0) * LONG**0.5 for x in facts}
    middle = _quantile(rows, F.abs(F.col("own") - _of_lang(mean)) * root, 0.5, texts, dict.fromkeys(facts, 0.0), most)
    spread = {x: max(v * 1.5, 0.5) for x, v in middle.items()}
    # As Model.far has it.
    scale = {x: max(model.uniform - v, 0.5) for x, v in mean.items()}
    far = (F.col("own") - _of_lang(mean) - 3 * _of_lang(spread) / root) / _of_lang(scale)
    farthest = _quantile(rows, far, 0.99, texts, {x: (low[x] - mean[x] - 3 * spread[x]) / scale[x] for x in facts}, {x: (high[x] - mean[x]) / scale[x] for x in facts})
    for x, i in place.items():
        if x in facts:
            model.mean[i], model.spread[i] = mean[x], spread[x]
            model.limit[i] = float(np.clip(MARGIN * farthest[x], LEAST_LIMIT, 1.0))
    model.temperature = min((sum(r[x] for r in facts.values()), t) for x, t in zip(losses, TEMPERATURES, strict=True))[1]
    return model


def with_language(docs: DataFrame, model: Model, predicted: str = "lang_pred") -> DataFrame:
    """docs with the columns lang_pred, score and rejected; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    new = [predicted, "score", "rejected"]

    def finish(bare: Model, batch: pa.RecordBatch, entropies: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(bare.decide(entropies, n), (pa.string(), pa.float64(), pa.bool_()), strict=True)]

    return _with_sums(docs.drop(*new), model, "text", finish, f"{predicted} string, score double, rejected boolean")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row; learnt from the rows whose fold of 4 is not 2."""
    small_batches(docs.sparkSession)
    held = fold(4) == 2
    model = fit(docs.filter(~held).select("text", "lang"))
    return with_language(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
