"""Trajectory operators over points (event_id, oid, ts_ms, x, y): filter, range, statistics, heat map, nearest and join.

A trajectory is all points of an oid; a sub-trajectory those in one window, in order of time (ties: x, then y). Points
without oid, time or finite coordinates belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.functions.canonical import finite
from tidegrid.grid import Grid
from tidegrid.operators.prefix import ordinals
from tidegrid.operators.spatial import _cells, _check, spatial_join, top_k
from tidegrid.operators.windowing import Windows, assign, window_columns
from tidegrid.shared import spread

DAY = 86_400_000
AGGREGATES = ("ALL", "SUM", "AVG", "MIN", "MAX")


def usable(points: DataFrame) -> DataFrame:
    return points.where(F.col("oid").isNotNull() & F.col("ts_ms").isNotNull() & finite(F.col("x")) & finite(F.col("y")))


def _of(points: DataFrame, ids: list[str] | None) -> DataFrame:
    """Points of the given oids; an empty set means all."""
    points = usable(points)
    return points.where(F.col("oid").isin(list(ids))) if ids else points


def _path() -> Column:
    return F.array_sort(F.collect_list(F.struct("ts_ms", "x", "y")))


def sub_trajectories(points: DataFrame, windows: Windows) -> DataFrame:
    """window, oid, n, path (array of ts_ms, x, y) of each window's sub-trajectories of two or more points."""
    placed = assign(usable(points), windows)
    paths = placed.groupBy(*window_columns(placed), "oid").agg(_path().alias("path"))
    return paths.withColumn("n", F.size("path")).where(F.col("n") >= 2)


def tfilter(points: DataFrame, ids: list[str] | None = None, windows: Windows | None = None) -> DataFrame:
    """Points of the given oids (none given: all); with ``windows`` their sub-trajectories."""
    own = _of(points, ids)
    return own if windows is None else sub_trajectories(own, windows)


def polygon_index(polygons: DataFrame, grid: Grid) -> DataFrame:
    """Per grid cell: cx, cy, shapes (the sides of each polygon whose bbox meets the cell)."""
    shaped = G.with_shape(polygons.select("rings"), "pg").select("segs", "box")
    return _cells(shaped, grid, 0, "").groupBy("cx", "cy").agg(F.collect_list("segs").alias("shapes"))


def in_any(points: DataFrame, polygons: DataFrame, grid: Grid | None) -> DataFrame:
    """``points`` with ``inside``: whether a polygon contains the point, borders excluded. Each point stays one row.
    ``polygons`` is a query set: at a cell it is as large as polygons overlap there."""
    x, y = F.col("x"), F.col("y")
    if grid is None:
        shapes = G.with_shape(polygons.select("rings"), "pg").select("segs", "box")
        boxed = x.between(F.col("box.minx"), F.col("box.maxx")) & y.between(F.col("box.miny"), F.col("box.maxy"))
        hits = points.join(shapes, F.when(boxed, G.contains(x, y, F.col("segs"))).otherwise(F.lit(False)), "left_semi")
        return hits.withColumn("inside", F.lit(True))
    index = polygon_index(polygons, grid).withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
    placed = points.withColumns({"cx": grid.cx(x), "cy": grid.cy(y)})
    joined = placed.join(index, (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")), "left")
    inside = F.coalesce(F.exists("shapes", lambda s: G.contains(x, y, s)), F.lit(False))
    return joined.select(*points.columns, inside.alias("inside"))


def trange(points: DataFrame, polygons: DataFrame, grid: Grid | None, windows: Windows | None = None) -> DataFrame:
    """Points inside any polygon; with ``windows`` the whole sub-trajectories that have such a point."""
    marked = in_any(spread(usable(points)), polygons, grid)
    if windows is None:
        return marked.where("inside").drop("inside")
    placed = assign(marked, windows)
    paths = placed.groupBy(*window_columns(placed), "oid").agg(F.bool_or("inside").alias("inside"), _path().alias("path"))
    return paths.withColumn("n", F.size("path")).where(F.col("inside") & (F.col("n") >= 2)).drop("inside")


def tstats(points: DataFrame, ids: list[str] | None = None, windows: Windows | None = None, stretch: int = DAY) -> DataFrame:
    """Length, duration and mean speed (per ms) of trajectories.

    Only points of strictly later time than the one before count; of several at one time the smallest ``event_id``
    does. Without ``windows``: a row for each counting point but an oid's first: oid, ts_ms, spatial_len,
    temporal_len_ms, speed so far. With: one row per window and oid; a single point has a null speed.

    Running values come from stretches of time whose ends are joined, so no oid is one task's burden.
    """
    own = _of(points, ids).select("oid", "ts_ms", "event_id", "x", "y")
    by: list[str] = []
    if windows is not None:
        own = assign(own, windows)
        by = window_columns(own)
    by.append("oid")
    parts = own.withColumn("stretch", F.floor(F.col("ts_ms") / F.lit(stretch)).cast("long"))
    steps = _counting(parts, Window.partitionBy(*by, "stretch").orderBy("ts_ms", "event_id"))
    ends = steps.groupBy(*by, "stretch").agg(
        F.sum("step").alias("len"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.min_by("x", "ts_ms").alias("fx"), F.min_by("y", "ts_ms").alias("fy"), F.max_by("x", "ts_ms").alias("lx"), F.max_by("y", "ts_ms").alias("ly"),
    )
    along = Window.partitionBy(*by).orderBy("stretch")
    link = F.coalesce(G.point_distance(F.lag("lx").over(along), F.lag("ly").over(along), F.col("fx"), F.col("fy")), F.lit(0.0))
    ends = ends.withColumn("link", link)
    if windows is not None:
        sums = ends.groupBy(*by).agg(F.sum(F.col("len") + F.col("link")).alias("spatial_len"), (F.max("last_ms") - F.min("first_ms")).alias("temporal_len_ms"))
        return sums.withColumn("speed", F.try_divide("spatial_len", "temporal_len_ms"))
    ends = ends.withColumn("start_ms", F.first("first_ms").over(along))
    before = ends.select("oid", "stretch", "start_ms", (F.sum(F.col("len") + F.col("link")).over(along) - F.col("len")).alias("before"))
    order = Window.partitionBy("oid", "stretch").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("here", F.sum("step").over(order)).join(before, ["oid", "stretch"]).where(F.col("ts_ms") > F.col("start_ms"))
    length, time = F.col("before") + F.col("here"), F.col("ts_ms") - F.col("start_ms")
    return out.select("oid", "ts_ms", length.alias("spatial_len"), time.alias("temporal_len_ms"), F.try_divide(length, time).alias("speed"))


def _counting(points: DataFrame, order) -> DataFrame:  # noqa: ANN001
    """Points later than their predecessor, with ``step``: the distance from it (0 for the first)."""
    last = points.withColumns({"__t": F.lag("ts_ms").over(order)}).where(F.col("__t").isNull() | (F.col("ts_ms") > F.col("__t"))).drop("__t")
    return last.withColumn("step", F.coalesce(G.point_distance(F.lag("x").over(order), F.lag("y").over(order), F.col("x"), F.col("y")), F.lit(0.0)))


def _heat(lengths: DataFrame, by: list[str], fn: str) -> DataFrame:
    """One row per window and cell from one per oid: n_traj and ``lengths``, a map."""
    if fn not in AGGREGATES:
        fn = "ALL"
    ms, moved = F.col("ms"), F.col("n") >= 2
    n_traj = F.count("*").alias("n_traj")
    if fn == "ALL":
        return lengths.groupBy(*by).agg(n_traj, F.map_from_entries(F.array_sort(F.collect_list(F.struct("oid", "ms")))).alias("lengths"))
    if fn in ("SUM", "AVG"):
        total = F.sum("ms")
        value = total if fn == "SUM" else F.floor(total / F.count("*") + 0.5).cast("long")
        out = lengths.groupBy(*by).agg(n_traj, total.alias("__sum"), value.alias("__v")).where(F.col("__sum") > 0)
        return out.select(*by, "n_traj", F.create_map(F.lit(""), F.col("__v")).alias("lengths"))
    pair = F.struct(ms.alias("ms"), F.col("oid").alias("oid")) if fn == "MIN" else F.struct((-ms).alias("ms"), F.col("oid").alias("oid"))
    out = lengths.groupBy(*by).agg(n_traj, F.min(F.when(moved, pair)).alias("__v")).where(F.col("__v").isNotNull())
    return out.select(*by, "n_traj", F.create_map(F.col("__v.oid"), F.abs("__v.ms")).alias("lengths"))


def taggregate(points: DataFrame, fn: str, grid: Grid, windows: Windows, count_based: bool = False) -> DataFrame:
    """Heat map: per window and cell the number of trajectories and the length in ms (last minus first time) of all
    (``ALL``), their ``SUM`` or ``AVG`` (key ``""``; rounded half up, none where the sum is 0), or the shortest or
    longest (``MIN``, ``MAX``; of those with two points, ties to the smaller oid). Unknown names count as ``ALL``.

    With ``count_based``, windows hold the last ``size`` points of a cell each time ``slide`` more have come; the row
    has ``last``, the number of the window's last point. Points outside the grid don't count.
    """
    placed = usable(points).withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))}).where(grid.has(F.col("cx"), F.col("cy")))
    if count_based:
        placed = ordinals(placed, ["cx", "cy"], "ts_ms", ["event_id", "oid"])
        slide, size = F.lit(windows.step), F.lit(windows.size)
        fired = F.floor((F.col("rn") + slide - 1) / slide).cast("long") * slide  # the first window that has this point
        ends = placed.withColumn("last", F.explode(F.sequence(fired, F.col("rn") + size - 1 - F.pmod(F.col("rn") + size - 1, slide), slide)))
        counts = placed.groupBy("cx", "cy").agg(F.count("*").alias("n_cell"))
        placed = ends.join(counts, ["cx", "cy"]).where(F.col("last") <= F.col("n_cell"))
        by = ["last", "cx", "cy"]
    else:
        placed = assign(placed, windows)
        by = [*window_columns(placed), "cx", "cy"]
    lengths = placed.groupBy(*by, "oid").agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"), F.count("*").alias("n"))
    return _heat(lengths, by, fn)


def taggregate_now(points: DataFrame, fn: str, grid: Grid, now_ms: int | None = None, halt_ms: int | None = None) -> DataFrame:
    """The heat map over all points up to ``now_ms``, without oids whose last point in the cell is more than ``halt_ms``
    before it. Single points count with length 0, and sums of 0 are reported."""
    placed = usable(points).withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))}).where(grid.has(F.col("cx"), F.col("cy")))
    if now_ms is not None:
        placed = placed.where(F.col("ts_ms") <= now_ms)
    lengths = placed.groupBy("cx", "cy", "oid").agg((F.max("ts_ms") - F.min("ts_ms")).alias("ms"), F.max("ts_ms").alias("last_ms"), F.lit(2).alias("n"))
    if halt_ms is not None and now_ms is not None:
        lengths = lengths.where(F.col("last_ms") >= now_ms - halt_ms)
    by = ["cx", "cy"]
    if fn in ("SUM", "AVG"):
        value = F.sum("ms") if fn == "SUM" else F.floor(F.sum("ms") / F.count("*") + 0.5).cast("long")
        return lengths.groupBy(*by).agg(F.count("*").alias("n_traj"), value.alias("__v")).select(*by, "n_traj", F.create_map(F.lit(""), F.col("__v")).alias("lengths"))
    return _heat(lengths, by, fn)


def _near(points: DataFrame, x: float, y: float, r: float | None, grid: Grid | None) -> DataFrame:
    dist = G.point_distance(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y)))
    near = points.withColumn("dist", dist)
    if grid is not None and r is not None:
        (qx, qy), k = grid.index(x, y), grid.candidate_layers(r)
        cx, cy = grid.cx(F.col("x")), grid.cy(F.col("y"))
        near = near.where(grid.has(cx, cy) & cx.between(qx - k, qx + k) & cy.between(qy - k, qy + k))
    return near if r is None else near.where(F.col("dist") <= r)


def tknn(points: DataFrame, x: float, y: float, r: float | None, k: int, grid: Grid | None, windows: Windows, paths: bool = False, every_batch: bool = False) -> DataFrame:
    """The ``k`` trajectories nearest to a place, per window: rank, oid, dist and the nearest point's x, y; with
    ``paths`` the sub-trajectory (n, path) instead, and only oids of two or more points are ranked. ``r`` None: at any
    distance. Ties of distance rank by oid; of an oid's points at one distance the earliest counts.

    Oids shrink to one row per window before ranking; paths are collected for the winners alone. On a stream (without
    paths) windows come out when they are closed, or with ``every_batch`` whenever a batch brings points for them.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    if points.isStreaming:
        from tidegrid.streaming.nearest import nearest

        if paths:
            raise ValueError("on a stream the nearest come without paths")
        return nearest(_near(usable(points), x, y, r, grid).select("oid", "dist", "ts_ms", "x", "y"), k, windows, every_batch).drop("ts_ms")
    placed = assign(usable(points), windows)
    by = window_columns(placed)
    hits = _near(placed, x, y, r, grid).groupBy(*by, "oid").agg(F.min(F.struct("dist", "ts_ms", "x", "y")).alias("p"))
    hits = hits.select(*by, "oid", F.col("p.dist").alias("dist"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    if not paths:
        return top_k(hits, k, by)
    counts = placed.groupBy(*by, "oid").agg(F.count("*").alias("n")).where("n >= 2")
    best = top_k(hits.drop("x", "y").join(counts, [*by, "oid"], "left_semi"), k, by)
    return best.join(placed, [*by, "oid"]).groupBy(*by, "rank", "oid", "dist").agg(_path().alias("path")).withColumn("n", F.size("path"))


def _met_anywhere(left: DataFrame, right: DataFrame, r: float, windows: Windows, apart: bool) -> DataFrame:
    """window_start, window_end, oid, qid, p, q of all pairs of ids that come within ``r``, wherever they are.

    Points meet by window and block of the plane, which has no border: a left point lies in one block, a right one in all
    that it reaches. Pairs of points shrink where they are made, by hash: times are least and greatest, and no two places
    of one time share a group (``turn`` numbers an oid's places of one time, the right's places are in the key). The rest
    moves once, by window and oid, which is also how the first point of an oid is found.
    """
    _check("pt", "pt", r)
    reach = r * (1 + 1e-9) + 1e-12  # more than r by what rounding may add
    block = lambda v: F.floor(v / F.lit(4 * reach))
    place = ["window_start", "bx", "by"]
    a = assign(left, windows).drop("window_end").withColumns({"bx": block(F.col("x")), "by": block(F.col("y"))}).repartition(*place)
    a = a.withColumn("turn", F.dense_rank().over(Window.partitionBy(*place, "oid", "ts_ms").orderBy("x", "y")))
    b = assign(right, windows).drop("window_end").withColumnsRenamed({"oid": "qid", "ts_ms": "q_ts_ms", "x": "q_x", "y": "q_y"})
    for axis in "xy":
        b = b.withColumn(f"b{axis}", F.explode(F.sequence(block(F.col(f"q_{axis}") - reach), block(F.col(f"q_{axis}") + reach))))
    b = b.withColumnsRenamed({c: f"q_{c}" for c in place})
    near = G.point_distance(F.col("x"), F.col("y"), F.col("q_x"), F.col("q_y")) <= r
    for c in place:
        near = (F.col(c) == F.col(f"q_{c}")) & near
    pairs = a.join(b, near & (F.col("oid") != F.col("qid")) if apart else near)
    own = {"ts_ms": F.min("ts_ms"), "x": F.min_by("x", "ts_ms"), "y": F.min_by("y", "ts_ms"), "q_ts_ms": F.max("q_ts_ms")}
    once = pairs.groupBy(*place, "oid", "turn", "qid", "q_x", "q_y").agg(*(v.alias(c) for c, v in own.items())).drop("bx", "by", "turn")
    met = once.repartition("window_start", "oid").groupBy("window_start", "oid", "qid").agg(F.min(F.struct("ts_ms", "x", "y")).alias("p"), F.max(F.struct("q_ts_ms", "q_x", "q_y")).alias("q"))
    return met.withColumn("window_end", F.col("window_start") + F.lit(windows.size))


def tjoin(points: DataFrame, queries: DataFrame, r: float, grid: Grid | None, windows: Windows, paths: bool = False, apart: bool = False) -> DataFrame:
    """Pairs of trajectories that come within ``r`` of each other in a window: oid, qid, the oid's first such point
    (ts_ms, x, y) and the qid's latest one near the oid (q_ts_ms, q_x, q_y); with ``paths`` both sub-trajectories (path,
    q_path; two or more points each). ``apart`` leaves out pairs of equal ids, for joining a stream to itself.

    Pairs of points shrink to one row per pair of ids where they are made; only those rows move on. On streams (without
    paths) a pair comes out when its window is closed, with the first of its own oid's points.
    """
    left, right = usable(points).select("oid", "ts_ms", "x", "y"), usable(queries).select("oid", "ts_ms", "x", "y")
    by = ["window"] if points.isStreaming else window_columns(assign(left, windows))
    if points.isStreaming and paths:
        raise ValueError("on streams pairs come without paths")
    if grid is None and not points.isStreaming:
        met = _met_anywhere(left, right, r, windows, apart)
    else:
        pairs = spatial_join(left, right, r, grid, windows=windows)
        if apart:
            pairs = pairs.where(F.col("oid") != F.col("q_oid"))
        met = pairs.groupBy(*by, "oid", F.col("q_oid").alias("qid")).agg(F.min(F.struct("ts_ms", "x", "y")).alias("p"), F.max(F.struct("q_ts_ms", "q_x", "q_y")).alias("q"))
    if points.isStreaming:
        return met.select(*by, "oid", "qid", "p.ts_ms", "p.x", "p.y", "q.q_ts_ms", "q.q_x", "q.q_y")
    if not paths:
        first = F.min("p").over(Window.partitionBy(*by, "oid"))
        return met.withColumn("p", first).select(*by, "oid", "qid", "p.ts_ms", "p.x", "p.y", "q.q_ts_ms", "q.q_x", "q.q_y")
    own = sub_trajectories(left, windows).drop("n")
    other = own if queries is points else sub_trajectories(right, windows).drop("n")
    other = other.withColumnsRenamed({"oid": "qid", "path": "q_path"})
    return met.select(*by, "oid", "qid").join(own, [*by, "oid"]).join(other, [*by, "qid"])
