"""A vector table kept in step with the chunks by content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_index(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, state): new, changed, same or stale. Both sides are narrowed to (id, hash) before the shuffle."""
    e, w = existing.select("id", F.col("hash").alias("old")), wanted.select("id", F.col("hash").alias("now"))
    state = F.when(F.col("in_old").isNull(), "new").when(F.col("in_now").isNull(), "stale").when(~F.col("old").eqNullSafe(F.col("now")), "changed").otherwise("same")
    both = e.withColumn("in_old", F.lit(True)).join(w.withColumn("in_now", F.lit(True)), "id", "full_outer")
    return both.select("id", state.alias("state"))


def apply_sync(existing: DataFrame, wanted: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next snapshot: unchanged rows as they are, new and changed chunks through embed, stale rows gone."""
    states = diff_index(existing, wanted)
    kept = existing.join(states.filter("state = 'same'").select("id"), "id", "left_semi")
    todo = wanted.join(states.filter("state in ('new', 'changed')").select("id"), "id", "left_semi")
    return kept.unionByName(embed(todo).select(*existing.columns))


def embed_column(encoder: Callable[[], Callable[[list[str]], list]], text: Column, prefix: str = "") -> Column:
    """Vectors of a text column. encoder() builds the model, once for each task; batches follow the Arrow batch size."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for b in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in b])), dtype=object)

    return run(text)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def rounded(x: Column, places: int) -> Column:
    """Rounded half up; the sign of a zero is kept, as SQL keeps it."""
    return F.abs(F.round(x, places)) * F.signum(x)
