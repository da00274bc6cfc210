"""Nearest vectors, exactly.

Vectors are packed into blocks: a row of a block table holds the ids and the vectors of some rows as one matrix. A search
of a question table over a corpus is then a join of block rows, not of vectors: each pair of blocks is one matrix product
inside a task, of which only the k best of each question go on. Neither side passes the driver; Spark ships the smaller
block table to all tasks if it is small enough for that, and else reads both sides block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actmill.operators.lexical import with_laws

#: Bytes of a block's matrix, about.
BLOCK_BYTES = 1 << 20


def packed(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """rows(vector, *fields) as blocks: a matrix of doubles, its width, and a list of each field. No shuffle."""
    kinds = dict(rows.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64)
            width = len(flat) // b.num_rows
            if len(flat) != b.num_rows * width or b.column(0).value_lengths().to_numpy().max() != width:
                raise ValueError("vectors differ in length")
            step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns[1:]]
                matrix = pa.array([flat[at * width : (at + part.num_rows) * width].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([matrix, pa.array([width], pa.int32()), *lists], [name, f"{name}_width", *fields])

    ddl = ", ".join([f"{name} binary", f"{name}_width int", *(f"{f} array<{kinds[f]}>" for f in fields)])
    return rows.filter(F.col("vector").isNotNull()).select("vector", *fields).mapInArrow(task, ddl)


def places(values: pa.Array) -> np.ndarray:
    """The rank of each value in its order; structs by their fields."""
    columns = values.flatten() if pa.types.is_struct(values.type) else [values]
    table = pa.table(columns, [str(i) for i in range(len(columns))])
    order = pc.sort_indices(table, [(n, "ascending") for n in table.column_names]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def allowed(asked: list, law: pa.Array) -> np.ndarray:
    """Which rows of a block each question may find, by its list of acts; a null or empty list allows all."""
    known = law.dictionary_encode()
    codes, names = known.indices.fill_null(-1).to_numpy(zero_copy_only=False), {x: i for i, x in enumerate(known.dictionary.to_pylist())}
    lines = {key: np.isin(codes, [names[x] for x in key if x in names]) for key in {tuple(x) for x in asked if x}}
    return np.stack([lines[tuple(x)] if x else np.ones(len(codes), bool) for x in asked])


def best(sims: np.ndarray, place: np.ndarray, keys: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k best columns of each line, the lower place first on ties; -inf is not found.

    With keys, only the best column of each key counts: the others give way before the cut.
    """
    order = np.lexsort((np.broadcast_to(place, sims.shape), -sims), axis=1)
    rank = np.full(order.shape, -1)
    if keys is None:
        rank[:] = np.arange(order.shape[1])
    else:
        of = keys[order]
        by_key = np.argsort(of, axis=1, kind="stable")  # inside a key the best stands first
        sorted_keys = np.take_along_axis(of, by_key, 1)
        first = np.ones(order.shape, bool)
        np.put_along_axis(first, by_key[:, 1:], sorted_keys[:, 1:] != sorted_keys[:, :-1], 1)
        rank = np.where(first, np.cumsum(first, axis=1) - 1, k)
    line, spot = np.nonzero((rank < k) & (np.take_along_axis(sims, order, 1) > -np.inf))
    return line, order[line, spot]


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 30, laws: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k most similar rows: queries(qid, vector), corpus(id, pos, vector), unit vectors.

    With laws, or where queries has a column laws (null or empty: all), only rows of the corpus with one of these law_slug
    take part, before anything is cut. With key, a column of the corpus, only a question's best row of each key is found,
    the cut to k falls on distinct keys, and key is in the result. Scores are rounded to 6 places; pos decides ties. A
    null vector finds nothing and is not found.
    """
    asked = with_laws(queries, laws)
    limit = ["laws"] if "laws" in asked.columns else []
    fields = ["id", "pos", *(["law_slug"] if limit else []), *([key] if key else [])]
    kinds, cols = dict(corpus.dtypes), [f"c_{i}" for i in range(len(fields))]
    near = packed(corpus.select("vector", *(F.col(f).alias(c) for f, c in zip(fields, cols, strict=True))), cols, "corpus")
    far = packed(asked.select("vector", F.col("qid").alias("q_0"), *(F.col(c).alias("q_1") for c in limit)), ["q_0", "q_1"][: 1 + len(limit)], "query")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
                x, y = (np.frombuffer(row[n].as_py()).reshape(-1, row[f"{n}_width"].as_py()) for n in ("query", "corpus"))
                sims = np.round(x @ y.T, 6)
                if limit:
                    sims = np.where(allowed(row["q_1"].as_py(), row["c_2"].values), sims, -np.inf)
                keys = row[cols[-1]].values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if key else None
                line, column = best(sims, places(row["c_1"].values), keys, k)
                found = [row["q_0"].values.take(pa.array(line)), *(row[c].values.take(pa.array(column)) for c in cols), pa.array(sims[line, column])]
                yield pa.RecordBatch.from_arrays(found, ["qid", *cols, "score"])

    ddl = ", ".join([f"qid {dict(asked.dtypes)['qid']}", *(f"{c} {kinds[f]}" for c, f in zip(cols, fields, strict=True)), "score double"])
    # A join of blocks: each pair is one product of matrices, of which k rows a question go on.
    found = near.crossJoin(far).mapInArrow(task, ddl).withColumnsRenamed(dict(zip(cols, fields, strict=True)))
    place = lambda *by: F.row_number().over(Window.partitionBy("qid", *by).orderBy(F.col("score").desc(), "pos"))
    if key:
        found = found.withColumn("rank", place(key)).filter("rank = 1")
    return found.withColumn("rank", place()).filter(F.col("rank") <= k).select("qid", "id", "score", "rank", *([key] if key else []))
