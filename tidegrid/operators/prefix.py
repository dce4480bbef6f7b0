"""Running sums per key in time order, without one task per key.

Rows are numbered and summed inside short stretches of time; the stretches' totals, one compact row each, are summed
along every key and joined back. So a key that holds a third of all rows is spread over as many tasks as it has
stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000


def running_sums(df: DataFrame, keys: list[str], time: str, ties: list[str], sums: dict[str, Column], stretch: int = MINUTE) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its expression over the rows of the same ``keys`` up to this
    one, in order of ``time`` (epoch ms) and ``ties``. Rows with a null time come first, as one stretch."""
    local = {f"__{n}": c for n, c in sums.items()}
    parts = df.withColumn("__stretch", F.floor(F.col(time) / F.lit(stretch)).cast("long")).withColumns(local)
    totals = parts.groupBy(*keys, "__stretch").agg(*(F.sum(c).alias(f"{c}_all") for c in local))
    along = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__stretch", *(F.coalesce(F.sum(f"{c}_all").over(along), F.lit(0)).alias(f"{c}_before") for c in local))
    inner = Window.partitionBy(*keys, "__stretch").orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"{c}_here": F.sum(c).over(inner) for c in local})
    on = [summed[k].eqNullSafe(before[k]) for k in [*keys, "__stretch"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = summed.join(before.select(*(F.col(c) for c in before.columns)), condition)
    return joined.select(*(summed[c] for c in df.columns), *((F.coalesce(F.col(f"__{n}_here"), F.lit(0)) + F.col(f"__{n}_before")).alias(n) for n in sums))


def ordinals(df: DataFrame, keys: list[str], time: str, ties: list[str], stretch: int = MINUTE, name: str = "rn") -> DataFrame:
    """``df`` with each row's number (from 1) among those of the same ``keys`` in time order."""
    return running_sums(df, keys, time, ties, {name: F.lit(1).cast("long")}, stretch)


def previous(df: DataFrame, keys: list[str], time: str, ties: list[str], columns: list[str], stretch: int = MINUTE, prefix: str = "last_") -> DataFrame:
    """``df`` with each of ``columns`` as it was in the row before of the same ``keys`` (null in the first), in order of
    ``time`` and ``ties``. The first row of a stretch gets it from the last stretch's closing row. Rows
    with a null key or time are left out."""
    parts = df.withColumn("__stretch", F.floor(F.col(time) / F.lit(stretch)).cast("long"))
    inner = Window.partitionBy(*keys, "__stretch").orderBy(time, *ties)
    row = F.struct(*columns)
    closing = parts.groupBy(*keys, "__stretch").agg(F.max(F.struct(time, *ties, row.alias("__row"))).alias("__end"))
    before = closing.select(*keys, "__stretch", F.lag("__end.__row").over(Window.partitionBy(*keys).orderBy("__stretch")).alias("__before"))
    lagged = parts.withColumns({"__n": F.row_number().over(inner), "__lag": F.lag(row).over(inner)})
    joined = lagged.join(before, [*keys, "__stretch"])
    last = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__lag"))
    return joined.select(*df.columns, *(last[c].alias(f"{prefix}{c}") for c in columns))
