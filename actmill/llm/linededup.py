"""Operator 8: deletion of repeated runs of lines, by winnowing over line hashes. DataFrame functions only.

A text is its lines (pieces between newlines). A run counts as a repeat if it has RUN lines or more, or WORDS words or
more (a long passage may be one line). The least such runs are windows: any RUN lines, two neighbouring lines of WORDS
words together, one line of WORDS words.

1. Winnowing. Each window selects its line of smallest hash, the rightmost on ties; only selected lines are emitted, as
   fingerprints with their places. Every repeated run thus has fingerprints in common with its earlier occurrence.
2. Joining. Places meet the fingerprints that occur more than once.
3. Extension. From its fingerprint a match is extended both ways over the neighbouring lines to the windows that selected
   it; windows of equal lines (by 128 bits of hashes) match their first occurrence, in the order of doc_id, then of the
   text's hash, then of position.
4. Deletion. The lines of all windows with an earlier occurrence go; windows that touch or overlap merge into the longer
   run that repeats.

Both joins deal the rows of one key over SALTS tasks and repeat the few facts about a key, so that a very frequent line
does not meet in one task.

Defined results: a null text stays null, has no lines and loses none; an empty text is one empty line; within a text the
first of overlapping repeats stays; a row with a null doc_id comes after all others; rows equal in doc_id and text count
as one document and get the same result. A document all of whose lines are deleted keeps an empty text. Whether a line
occurred earlier is judged on the input. Other columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actmill.llm.ordering import apart

RUN, WORDS, SALTS = 3, 50, 8


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _fingerprints(first: Column, second: Column, words: Column) -> Column:
    """line, fingerprint and windows (start, n, high, low) of each selected line, from two hashes and the words of each."""

    def at(i: Column) -> Column:
        def window(start: Column, n: int, fits: Column | None = None) -> Column:
            """The window if it selects line i, else null; it is null too where it reaches over an end."""
            own = F.get(first, i)
            here = reduce(lambda rest, k: rest & F.when(start + k < i, own <= F.get(first, start + k)).when(start + k > i, own < F.get(first, start + k)).otherwise(True), range(n), start >= 0)
            keys = [F.xxhash64(F.lit(n), *(F.get(h, start + k) for k in range(n))) for h in (first, second)]
            inside = F.get(first, start).isNotNull() & F.get(first, start + n - 1).isNotNull()
            return F.when(inside & here & (fits if fits is not None else F.lit(True)), F.struct(start.alias("start"), F.lit(n).alias("n"), keys[0].alias("high"), keys[1].alias("low")))

        def pair(start: Column) -> Column:
            a, b = F.get(words, start), F.get(words, start + 1)
            return window(start, 2, (a < WORDS) & (b < WORDS) & (a + b >= WORDS))

        found = [window(i - k, RUN) for k in range(RUN)] + [pair(i - 1), pair(i), window(i, 1, F.get(words, i) >= WORDS)]
        return F.struct(i.alias("line"), F.get(first, i).alias("fingerprint"), F.filter(F.array(*found), lambda w: w.isNotNull()).alias("windows"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(first) - 1), at), lambda x: F.size(x["windows"]) > 0)


def _salted(facts: DataFrame) -> DataFrame:
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_lines(docs: DataFrame, row_key: str) -> DataFrame:
    """(row_key, deleted): the sorted numbers of the lines to delete, from 0, for each row that loses any."""
    hashed = docs.filter("text is not null").select(
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row_key).alias("key")).alias("doc"),
        F.transform(lines(F.col("text")), lambda x: F.xxhash64(x)).alias("first"),
        F.transform(lines(F.col("text")), lambda x: F.xxhash64(F.lit("second"), x)).alias("second"),
        F.transform(lines(F.col("text")), lambda x: F.regexp_count(x, F.lit("[^ \t\r\f\x0b]+"))).alias("words"),
    )
    selected = hashed.select("doc", F.explode(_fingerprints(F.col("first"), F.col("second"), F.col("words"))).alias("w")).select("doc", "w.*")
    common = selected.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    near = selected.withColumn("salt", F.pmod(F.xxhash64("doc", "line"), F.lit(SALTS)).cast("int")).join(_salted(common), ["fingerprint", "salt"])
    # A window has one selected line, so it is extended to once.
    windows = near.select("doc", F.explode("windows").alias("w")).select("doc", "w.*")
    place = F.struct("doc", "start")
    first = windows.groupBy("high", "low", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("high", "low", "n", "first")
    spread = windows.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int"))
    later = spread.join(_salted(first), ["high", "low", "n", "salt"]).filter(place > F.col("first"))
    gone = later.select(F.col("doc.key").alias(row_key), F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))
    return gone.groupBy(row_key).agg(F.sort_array(F.collect_set("line")).alias("deleted"))


def lines_deduplicated(docs: DataFrame) -> DataFrame:
    """docs with its text shortened, and n_lines and n_deleted; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_deleted")
    key, own, gone = (apart(docs, x) for x in ("row_key", "lines", "deleted"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    deleted = repeated_lines(keyed.select("doc_id", "text", key), key).withColumnRenamed("deleted", gone)
    # Texts are split below the join and rebuilt above it, so that they are split once however many lines stay.
    cut = keyed.select(*(lines(F.col("text")).alias(own) if c == "text" else F.col(f"`{c}`") for c in docs.columns), key)
    kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone))
    short = F.when(F.col(gone).isNull(), F.col(own)).otherwise(F.transform(kept, lambda i: F.get(F.col(own), i)))
    out = cut.join(deleted, key, "left")
    return out.select(
        *(F.array_join(short, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col(own).isNull(), 0).otherwise(F.size(own)).alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias("n_deleted"),
    )
