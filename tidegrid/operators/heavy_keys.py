"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join shrink to one compact state per key before anything moves (map-side partial aggregation, so a
hot key leaves each task as one row), the states are joined, counts multiply and sums combine algebraically, and the
result rolls up. No row of a hot key is ever joined one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Counts and integral sums, so that products of two don't overflow.
_WHOLE = "decimal(20,0)"


def key_states(df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column] | None = None) -> DataFrame:
    """One state per kind and non-null key: key_kind, key_value, n (rows, copies included) and ``aggs``, which must be
    sums, counts, minima or maxima. Null keys form no state; an empty table gives none. The keys must be of one type.

    All kinds are grouped in one scan, as grouping sets.
    """
    aggs = aggs or {}
    names = {kind: f"__key_{i}" for i, kind in enumerate(keys)}
    keyed = df.withColumns({names[k]: c for k, c in keys.items()})
    sets = [[F.col(n)] for n in names.values()]
    kind = F.coalesce(*(F.when(F.grouping(n) == 0, k) for k, n in names.items()))
    states = keyed.groupingSets(sets, *(F.col(n) for n in names.values())).agg(kind.alias("key_kind"), F.count("*").alias("n"), *(a.alias(k) for k, a in aggs.items()))
    return states.select("key_kind", F.coalesce(*names.values()).alias("key_value"), "n", *aggs).where(F.col("key_value").isNotNull())


def _whole(df: DataFrame, column: str) -> Column:
    """A column of states as it may be multiplied."""
    return F.col(column).cast(_WHOLE) if isinstance(df.schema[column].dataType, IntegralType) else F.col(column)


def join_states(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """States of both sides (``n_left``, ``n_right`` rows, and sums of either), joined by key, with ``n_pairs``: how many
    pairs of rows meet."""
    joined = left.join(right, key)
    return joined.withColumn("n_pairs", _whole(joined, "n_left") * _whole(joined, "n_right"))


def eager_join(left: DataFrame, right: DataFrame, key: str, sums: dict[str, tuple[str, str]], rollup: list[str] | None = None) -> DataFrame:
    """What ``left JOIN right ON key`` followed by ``GROUP BY key`` (or ``rollup``, columns of ``left``) gives, from
    states: ``n_pairs`` (decimal) and, for each name in ``sums``, the sum over all pairs of a column of one side:
    ``{"sx": ("left", "x")}``; sums of whole numbers are decimals too, so no hot key overflows.

    Null keys match nothing. Sums skip nulls. Extra columns, also of equal names on both sides, don't matter.
    """
    by = [key, *(rollup or [])]

    def state(df: DataFrame, side: str, group: list[str]) -> DataFrame:
        own = [(name, col) for name, (where, col) in sums.items() if where == side]
        return df.where(F.col(key).isNotNull()).groupBy(*group).agg(F.count("*").alias(f"n_{side}"), *(F.sum(col).alias(f"__{name}") for name, col in own))

    joined = join_states(state(left, "left", by), state(right, "right", [key]), key)
    other = {"left": "n_right", "right": "n_left"}
    out = joined.select(*by, "n_pairs", *((_whole(joined, f"__{name}") * (_whole(joined, other[side]) if isinstance(joined.schema[f"__{name}"].dataType, IntegralType) else F.col(other[side]))).alias(name) for name, (side, _) in sums.items()))
    return out.groupBy(*(rollup or [key])).agg(F.sum("n_pairs").alias("n_pairs"), *(F.sum(name).alias(name) for name in sums))


def heavy_keys(df: DataFrame, keys: dict[str, Column], one_in: int = 20) -> DataFrame:
    """Keys that hold at least one row in ``one_in`` of those with a key of their kind: key_kind, key_value, n, n_kind.

    It is the join of the rows with themselves by kind, rolled up to keys, from states: a key's rows (``n_left``) meet
    all of its kind (``n_right``), and it is heavy if its pairs are one in ``one_in`` of all that the kind has. The
    kinds' side has one row per entry of ``keys``, so its broadcast has a fixed size. Ties at the border are in. An
    empty table gives no rows.
    """
    left = key_states(df, keys).withColumnRenamed("n", "n_left")
    kinds = left.groupBy("key_kind").agg(F.sum("n_left").alias("n_right"))
    pairs = join_states(left, F.broadcast(kinds), "key_kind")
    all_pairs = F.col("n_right").cast("decimal(19,0)") * F.col("n_right").cast("decimal(19,0)")
    heavy = pairs.where(F.col("n_pairs") * F.lit(one_in) >= all_pairs)
    return heavy.select("key_kind", "key_value", F.col("n_left").alias("n"), F.col("n_right").alias("n_kind"))
