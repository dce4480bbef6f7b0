"""Range, k-nearest-neighbour and distance-join queries between points, polygons and lines, in any combination.

Pruning is by cells of a grid: a shape lies in the cells of its bbox, a query reaches the cells within its radius, and
what shares no cell is never compared. A shape outside the grid is in no cell, so it matches nothing unless pruning is
off (``grid=None``). Pairs that share several cells meet in all, and are kept in the first only, which needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.grid import Grid
from tidegrid.operators.windowing import Windows, assign, window_columns
from tidegrid.shared import spread


def _check(kind: str, query_kind: str, r: float) -> None:
    if kind not in G.KINDS or query_kind not in G.KINDS:
        raise ValueError(f"kinds are {G.KINDS}")
    if not r >= 0:
        raise ValueError("a radius is 0 or more")


def _cells(df: DataFrame, grid: Grid, r: float, prefix: str) -> DataFrame:
    """One row per cell within ``r`` of a shape's bbox, with the range's lower corner."""
    near = grid.near_box(F.col(f"{prefix}box"), r)
    df = df.withColumns({f"{prefix}{k}": v for k, v in near.items()})
    some = (F.col(f"{prefix}lo_x") <= F.col(f"{prefix}hi_x")) & (F.col(f"{prefix}lo_y") <= F.col(f"{prefix}hi_y"))
    df = df.where(some)
    df = df.withColumn("cx", F.explode(F.sequence(f"{prefix}lo_x", f"{prefix}hi_x")))
    return df.withColumn("cy", F.explode(F.sequence(f"{prefix}lo_y", f"{prefix}hi_y"))).drop(f"{prefix}hi_x", f"{prefix}hi_y")


def _ranges(df: DataFrame, grid: Grid, r: float, prefix: str) -> DataFrame:
    """``df`` with the ranges of the cells it reaches (lo_x, hi_x, lo_y, hi_y), as far as they are in the grid."""
    df = df.withColumns({f"{prefix}{k}": v for k, v in grid.reach_box(F.col(f"{prefix}box"), r).items()})
    return df.where((F.col(f"{prefix}lo_x") <= F.col(f"{prefix}hi_x")) & (F.col(f"{prefix}lo_y") <= F.col(f"{prefix}hi_y")))


def _blocks(df: DataFrame, side: int, prefix: str, single: bool = False) -> DataFrame:
    """``df`` once for each block of ``side`` by ``side`` cells that its ranges touch: columns bx, by. ``single`` rows have
    one cell."""
    first = {a: F.floor(F.col(f"{prefix}lo_{a}") / side).cast("int") for a in "xy"}
    if single:
        return df.withColumns({f"{prefix}b{a}": first[a] for a in "xy"})
    for a in "xy":
        df = df.withColumn(f"{prefix}b{a}", F.explode(F.sequence(first[a], F.floor(F.col(f"{prefix}hi_{a}") / side).cast("int"))))
    return df


def _meeting(side: int, single: bool) -> Column:
    """Condition of a pair: one block, the first of those it shares, and a common cell. Blocks are as wide as the radius
    reaches; so a query is exploded to a few of them, however fine the grid."""
    on = F.lit(True)
    for a in "xy":
        low = F.greatest(F.col(f"lo_{a}"), F.col(f"q_lo_{a}"))
        on = on & (F.col(f"b{a}") == F.col(f"q_b{a}")) & (low <= F.least(F.col(f"hi_{a}"), F.col(f"q_hi_{a}")))
        if not single:
            on = on & (F.col(f"b{a}") == F.floor(low / side))
    return on


def within(kind: str, query_kind: str, r: float, approximate: bool = False) -> tuple[Column, Column]:
    """Condition and distance of a pair with columns as they are and prefixed ``q_``. The bboxes are tried first."""
    boxes = G.box_distance(F.col("box"), F.col("q_box"))
    dist = boxes if approximate else G.distance(kind, "", query_kind, "q_", r)
    if approximate or (kind == "pt" and query_kind == "pt"):
        return dist <= r, dist
    # A bbox can't be farther than its shape; the margin is for rounding.
    return F.when(boxes <= r * (1 + 1e-9) + 1e-12, dist <= r).otherwise(F.lit(False)), dist


def _prefixed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(f"q_{c}") for c in df.columns))


def range_query(objects: DataFrame, queries: DataFrame, r: float, grid: Grid | None, kind: str = "pt", query_kind: str = "pt", key: str | None = None, approximate: bool = False, windows: Windows | None = None) -> DataFrame:
    """Objects within ``r`` of any query shape, each once (for points: each row; else each ``key``), as they came; with
    ``windows`` once for each window. ``approximate`` takes the bboxes' distance.

    The query set, exploded to blocks of cells, joins by block. The engine broadcasts it if its size in bytes is below
    the session's threshold, and nothing is shuffled for points; else both sides are shuffled by block. Polygons and lines are exploded to their blocks too and the hits made single by ``key``, which must tell
    rows apart. Objects without a shape match nothing. The time test comes last, so each object is compared once.
    """
    _check(kind, query_kind, r)
    queries = queries.drop("ts_ms")
    if kind != "pt" and key is None:
        raise ValueError("polygons and lines need a key")
    columns = objects.columns
    left = G.with_shape(_even(objects, kind, query_kind), kind)
    right = _prefixed(G.with_shape(queries.select(*{"x", "y", "rings", "path", "paths"}.intersection(queries.columns)), query_kind).drop("rings", "path", "paths"))
    fits, _ = within(kind, query_kind, r, approximate)
    if grid is None:
        hits = left.join(right, fits, "left_semi")
    else:
        side, single = max(1, grid.candidate_layers(r)), kind == "pt"
        left = _blocks(_ranges(left, grid, 0, ""), side, "", single)
        right = _blocks(_ranges(right, grid, r, "q_"), side, "q_")
        hits = left.join(right, _meeting(side, single) & fits, "left_semi")
        if not single:
            hits = hits.dropDuplicates([key])
    hits = hits.select(*columns)
    return hits if windows is None else assign(hits, windows)


def _even(objects: DataFrame, kind: str, query_kind: str) -> DataFrame:
    """A small input over all cores, where pairs cost more than a formula."""
    return objects if kind == query_kind == "pt" else spread(objects)


def knn_query(objects: DataFrame, query: DataFrame, r: float, k: int, grid: Grid | None, kind: str = "pt", query_kind: str = "pt", windows: Windows | None = None, approximate: bool = False) -> DataFrame:
    """The ``k`` nearest distinct oids within ``r`` of one query shape (the one row of ``query``; more are an error), per window: window,
    rank, oid, dist. An oid's distance is that of its nearest row; ties are ranked by oid. Null oids don't take part.

    Rows shrink to one per window and oid before they move, then to ``k`` per window. On a stream, windows come out once
    the watermark has passed them (see ``streaming.nearest``).
    """
    _check(kind, query_kind, r)
    if k < 1:
        raise ValueError("k is 1 or more")
    if not query.isStreaming and query.limit(2).count() > 1:
        raise ValueError("query is one shape")
    left = G.with_shape(_even(objects.where(F.col("oid").isNotNull()), kind, query_kind), kind)
    right = _prefixed(G.with_shape(query.select(*{"x", "y", "rings", "path", "paths"}.intersection(query.columns)), query_kind).drop("rings", "path", "paths"))
    _, dist = within(kind, query_kind, r, approximate)
    fits = G.box_distance(F.col("box"), F.col("q_box")) <= r * (1 + 1e-9) + 1e-12
    if grid is not None:
        own, near = grid.near_box(F.col("box"), 0), grid.near_box(F.col("q_box"), r)
        apart = [F.greatest(own[f"lo_{a}"], near[f"lo_{a}"]) <= F.least(own[f"hi_{a}"], near[f"hi_{a}"]) for a in "xy"]
        fits = apart[0] & apart[1] & fits
    # One query shape: the join carries a single row to all objects.
    hits = left.join(F.broadcast(right), fits)
    hits = hits.select("oid", "ts_ms", dist.alias("dist"))
    if objects.isStreaming:
        from tidegrid.streaming.nearest import nearest

        if windows is None:
            raise ValueError("on a stream the nearest are those of a window")
        return nearest(hits.where(F.col("dist") <= r), k, windows).select("window", "rank", "oid", "dist")
    hits = assign(hits, windows) if windows else hits
    by = window_columns(hits) if windows else []
    # The radius is tested on each oid's least distance, so distances are computed once.
    near = hits.groupBy(*by, "oid").agg(F.min("dist").alias("dist")).where(F.col("dist") <= r)
    return top_k(near, k, by)


def top_k(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The ``k`` rows of least (dist, oid) per window, with their rank. A group limit in front of the ranking leaves k
    rows per task and window."""
    order = Window.partitionBy(*by).orderBy("dist", "oid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spatial_join(left: DataFrame, right: DataFrame, r: float, grid: Grid | None, kind: str = "pt", query_kind: str = "pt", windows: Windows | None = None, approximate: bool = False) -> DataFrame:
    """Pairs of rows at most ``r`` apart, in the same window: the left's columns, the right's prefixed ``q_``, dist and
    the window. Each pair of rows comes once per window. Pairs meet by window and block of cells; skewed cells are left to the
    engine's skew join.
    """
    _check(kind, query_kind, r)
    own = left.columns
    a, b = G.with_shape(_even(left, kind, query_kind), kind), G.with_shape(right, query_kind)
    if windows:
        a, b = assign(a, windows), assign(b, windows)
    when = window_columns(a) if windows else []
    if windows and a.isStreaming:
        b = b.withColumnRenamed("window", "q_window")
        b = b.select("q_window", *(F.col(c).alias(f"q_{c}") for c in b.columns if c != "q_window"))
        same = [F.col("window") == F.col("q_window")]
    else:
        b = _prefixed(b)
        same = [F.col(w) == F.col(f"q_{w}") for w in when]
    fits, dist = within(kind, query_kind, r, approximate)
    if grid is not None:
        side, single = max(1, grid.candidate_layers(r)), kind == "pt"
        a = _blocks(_ranges(a, grid, 0, ""), side, "", single)
        b = _blocks(_ranges(b, grid, r, "q_"), side, "q_")
        same.append(_meeting(side, single))
    on = fits
    for s in same:
        on = s & on
    pairs = a.join(b, on)
    return pairs.select(*when, *own, *(F.col(f"q_{c}") for c in right.columns), dist.alias("dist"))
