"""Places of rows in an order over the whole table, without gathering the table or a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed


def apart(df: DataFrame, name: str) -> str:
    """A column name that df has not got: name itself, or with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(rows: DataFrame, group: str, order: list[Column], place: str = "place", held: str = "held") -> DataFrame:
    """rows with place long, from 0 in its group by order, and held long, the number of rows of its group.

    Rows are dealt by ranges of (group, order), so a group of any size lies in as many ranges as it needs; rows equal in
    all of it are told apart by where they are read, so they can be split too. A row's number inside its range is its
    monotonic id after the sort; what is summed over groups and joined back is one row for each group in each range.
    rows should be a written table: it is read twice, once to find the ranges. group must not be null.
    """
    tie, seat, part, first, n = (apart(rows, x) for x in ("tie", "seat", "part", "first", "n"))
    keys = [F.col(group), *order, F.col(tie)]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    seated = checkpointed(ranged.drop(tie).withColumn(seat, F.monotonically_increasing_id())).withColumn(part, F.shiftright(seat, 33))
    facts = seated.groupBy(group, part).agg(F.min(seat).alias(first), F.count("*").alias(n))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum(n).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = facts.select(group, part, (before - F.col(first)).alias(first), F.sum(n).over(whole).alias(held))
    return seated.join(facts, [group, part]).withColumn(place, F.col(seat) + F.col(first)).drop(seat, part, first)
