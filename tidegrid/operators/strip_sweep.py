"""Points near other points or inside regions: latitude strips, swept in longitude order.

Latitude is cut into strips of one height. A point belongs to one strip, its owner; a target reaches into every strip
within its distance or extent, so strips overlap in targets only and each pair meets in exactly one place. Strips are
range-partitioned over the tasks in order of latitude by what they weigh; a strip that weighs more than a task should
is cut along longitude where its cells' counts say, and a target goes to the pieces that it reaches. So a point moves
once, however many targets there are, and not at all if its cell has none.

In a task the points of each piece are sorted by longitude; the active points of every target are a range of them,
found for all targets at once, and only those are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.shared import written

#: Within this distance (degrees) of an edge, a point lies on it. Coordinates have six decimals; so a point off an edge
#: that is shorter than half a degree is at least 2e-12 away, and rounding moves one on it by less than 1e-13.
ON_EDGE = 1e-12
#: Points and targets that a task should hold.
STRIP_POINTS, STRIP_TARGETS = 200_000, 50_000
#: Candidate pairs (or pairs and edges) verified at once.
CHUNK = 1_000_000
#: Cells that a target is listed for one by one. Larger targets are compared with the cells that have points.
WIDE = 1 << 16


@dataclass
class Discs:
    """Targets that hold the points within ``radius`` of their place."""

    x: np.ndarray
    y: np.ndarray
    radius: float

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r = self.radius * (1 + 1e-9) + 1e-12
        return self.x - r, self.y - r, self.x + r, self.y + r

    def holds(self, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether target k[i] holds the i-th point."""
        dx, dy = x - self.x[k], y - self.y[k]
        return np.sqrt(dx * dx + dy * dy) <= self.radius


def _each(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``n`` numbers from ``first`` one after the other: to which range each belongs, and the numbers."""
    owner = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return owner, np.arange(ends[-1] if len(n) else 0) - (ends - n)[owner] + first[owner]


class Regions:
    """Targets that hold the points in their outer ring (the first) and not inside a hole; borders belong to them.

    ``x``, ``y``: the vertices of all rings, none closed, each of three or more; ``sizes``: vertices of each ring;
    ``n_rings``: rings of each target, at least one.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n_rings: np.ndarray) -> None:
        self.x, self.y, self.sizes, self.n_rings = x, y, sizes, n_rings
        self.ring_at, self.edge_at = np.cumsum(n_rings) - n_rings, np.cumsum(sizes) - sizes
        after = np.arange(len(x)) + 1
        after[self.edge_at + sizes - 1] = self.edge_at  # an unclosed ring closes itself; turning sense doesn't matter
        self.ex, self.ey = x[after] - x, y[after] - y
        self.by = y[after]

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.n_rings):
            return (np.empty(0),) * 4
        outer = [f.reduceat(v, self.edge_at)[self.ring_at] for f in (np.minimum, np.maximum) for v in (self.x, self.y)]
        return outer[0] - ON_EDGE, outer[1] - ON_EDGE, outer[2] + ON_EDGE, outer[3] + ON_EDGE

    def holds(self, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether target k[i] holds the i-th point: inside by even-odd crossings, or on the border."""
        out = np.zeros(len(k), bool)
        edges = np.add.reduceat(self.sizes, self.ring_at)[k] if len(k) else np.empty(0, np.int64)
        for a, z in _chunks(edges):
            pair, ring = _each(self.ring_at[k[a:z]], self.n_rings[k[a:z]])
            which, e = _each(self.edge_at[ring], self.sizes[ring])
            at = a + pair[which]
            ax, ay, ex, ey = self.x[e], self.y[e], self.ex[e], self.ey[e]
            px, py = x[at] - ax, y[at] - ay
            with np.errstate(divide="ignore", invalid="ignore"):
                length = ex * ex + ey * ey
                t = np.where(length > 0, np.clip((px * ex + py * ey) / length, 0, 1), 0.0)
                cross = (ey != 0) & ((ay > y[at]) != (self.by[e] > y[at])) & (px < py * (ex / ey))
            edge = np.hypot(px - t * ex, py - t * ey) <= ON_EDGE
            first = np.cumsum(self.sizes[ring]) - self.sizes[ring]
            inside, border = np.bitwise_xor.reduceat(cross, first), np.logical_or.reduceat(edge, first)
            outer = ring == self.ring_at[k[a:z]][pair]
            fine = np.where(outer, inside | border, ~inside | border)
            out[a:z] = np.logical_and.reduceat(fine, np.flatnonzero(outer))
        return out


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose ``sizes`` sum to at most about CHUNK."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        yield a, z
        a = z


def _lower(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool = False) -> np.ndarray:
    """For each i where ``wanted[i]`` belongs in the sorted ``values[low[i] : high[i]]``, by bisection of all at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        before = open_ & ((v <= wanted) if right else (v < wanted))
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def sweep(targets: Discs | Regions, target_piece: np.ndarray, x: np.ndarray, y: np.ndarray, piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (target's index, point's index) of the same piece, each once."""
    x0, y0, x1, y1 = targets.boxes()
    if not len(x0) or not len(x):
        return
    order = np.lexsort((x, piece))
    xs, ys, ps = x[order], y[order], piece[order]
    a, z = np.searchsorted(ps, target_piece), np.searchsorted(ps, target_piece, side="right")
    a = _lower(xs, a, z, x0)
    z = _lower(xs, a, z, x1, right=True)
    for i, j in _chunks(z - a):
        k, at = _each(a[i:j], (z - a)[i:j])
        k += i
        near = (ys[at] >= y0[k]) & (ys[at] <= y1[k])
        k, at = k[near], at[near]
        fine = targets.holds(k, xs[at], ys[at])
        if fine.any():
            yield k[fine], order[at[fine]]


def _unpacked(shapes: pa.ListArray) -> Regions:
    """Regions from their ``shape``."""
    v = shapes.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(pc.list_value_length(shapes).to_numpy(zero_copy_only=False).astype(np.int64))
    at = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(end)]
    n_rings = v[at].astype(np.int64)
    sizes = v[_each(at + 1, n_rings)[1]].astype(np.int64)
    n = (end - at - 1 - n_rings) // 2
    x = v[_each(at + 1 + n_rings, n)[1]]
    return Regions(x, v[_each(at + 1 + n_rings + n, n)[1]], sizes, n_rings)


@dataclass(frozen=True)
class Relation:
    """Targets and how they hold points. ``targets`` has ``target_id`` and ``x``, ``y`` (discs of ``radius``) or
    ``rings``; ``height`` is what strips should measure for them."""

    targets: DataFrame
    target_id: str
    height: float
    radius: float | None = None

    def rows(self, number: int) -> DataFrame:
        """One row per target that can hold a point: rel, id, x, y, shape (of regions: how many rings, their sizes, all x,
        all y), and its extent."""
        t = self.targets.select(F.lit(number).alias("rel"), F.col(self.target_id).alias("id"), *(["x", "y"] if self.radius is not None else ["rings"]))
        if self.radius is not None:
            r = self.radius * (1 + 1e-9) + 1e-12
            t = t.selectExpr("rel", "id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", f"{_NO_SHAPE} AS shape").where(f"{_finite('x')} AND {_finite('y')}")
            return t.selectExpr("*", f"x - {r!r} AS x0", f"y - {r!r} AS y0", f"x + {r!r} AS x1", f"y + {r!r} AS y1")
        # Vertices that lack finite numbers go, so does a closing one; null rings are empty, holes of fewer than three
        # vertices have no inside.
        fine = f"coalesce(filter(r, p -> p IS NOT NULL AND {_finite('p.x')} AND {_finite('p.y')}), array())"
        opened = "if(size(r) > 1 AND get(r, 0) = get(r, size(r) - 1), slice(r, 1, greatest(size(r) - 1, 0)), r)"
        t = t.selectExpr("rel", "id", f"transform(transform(rings, r -> {fine}), r -> {opened}) AS rings").where("size(get(rings, 0)) >= 3")
        t = t.selectExpr("rel", "id", "concat(slice(rings, 1, 1), filter(slice(rings, 2, size(rings)), r -> size(r) >= 3)) AS rings")
        flat = lambda c: f"transform(flatten(rings), p -> p.{c})"
        outer = lambda f, c, s: f"array_{f}(transform(get(rings, 0), p -> p.{c})) {s} {ON_EDGE!r}"
        shape = f"concat(array(CAST(size(rings) AS DOUBLE)), transform(rings, r -> CAST(size(r) AS DOUBLE)), {flat('x')}, {flat('y')})"
        edges = [f"{outer('min', c, '-')} AS {c}0" for c in "xy"] + [f"{outer('max', c, '+')} AS {c}1" for c in "xy"]
        return t.selectExpr("rel", "id", "0.0D AS x", "0.0D AS y", f"{shape} AS shape", *edges)


#: The shape of what has none: an empty array, as Spark's writer of Arrow batches goes over all null ones anew at each row.
_NO_SHAPE = "CAST(array() AS ARRAY<DOUBLE>)"


def _finite(x: str) -> str:
    return f"({x} IS NOT NULL AND abs({x}) < DOUBLE('Infinity'))"


def near(sites: DataFrame, radius: float, site_id: str) -> Relation:
    """Points at most ``radius`` from a site (Euclidean)."""
    return Relation(sites, site_id, max(2 * radius, 1e-6), radius)


def within(zones: DataFrame, zone_id: str, height: float = 0.02) -> Relation:
    """Points that a zone (``rings``) contains. ``height`` should be about the zones' own: a zone of a hundred times
    that is listed for ten thousand cells."""
    return Relation(zones, zone_id, height)


def related(points: DataFrame, point_id: str, relations: dict[str, Relation]) -> DataFrame:
    """Pairs (rel_kind, target_id, ``point_id``): the points (``x``, ``y``) that each target of each relation holds,
    every pair of rows once.

    Points or targets without finite coordinates pair with nothing; null ids stay null in pairs. Repeated rows give
    repeated pairs. Empty tables give no pairs. Other columns don't matter. All relations share one pass over the
    points, after one over their coordinates that counts them by cell. All target ids must be of one type.
    """
    height = max(r.height for r in relations.values())
    step = lambda c: f"CAST(floor({c} / {height!r}D) AS BIGINT)"  # noqa: E731  wild coordinates end up in the outermost cells
    p = points.select(F.col(point_id).alias("pid"), F.col("x").cast("double"), F.col("y").cast("double")).where(f"{_finite('x')} AND {_finite('y')}")
    p = p.selectExpr("*", f"{step('y')} AS strip", f"{step('x')} AS col")
    rows = [r.rows(i) for i, r in enumerate(relations.values())]
    if len({t.schema["id"].dataType for t in rows}) != 1:
        raise ValueError("target ids of one type are needed")
    targets = reduce(DataFrame.unionByName, rows).selectExpr("rel", "id", "x", "y", "shape", *(f"{step(c)} AS {k}" for k, c in (("s0", "y0"), ("s1", "y1"), ("c0", "x0"), ("c1", "x1"))))
    occupied = written(p.groupBy("strip", "col").agg(F.count("*").alias("n_p")), "occupied")
    listed = _listed(targets, occupied)
    cells = written(_pieces(occupied, listed), "cells")
    total, n = cells.agg(F.max(F.col("load_before") + F.col("unit_load") * F.col("n_shares") * F.col("n_blocks")), F.count("*")).first()
    kinds = f"rel_kind string, target_id {targets.schema['id'].dataType.simpleString()}, `{point_id}` {p.schema['pid'].dataType.simpleString()}"
    if not n:
        return p.sparkSession.createDataFrame([], kinds)
    n_parts = max(p.sparkSession.sparkContext.defaultParallelism, int(np.ceil(total)))
    return _swept(p, listed, cells, [(name, r.radius) for name, r in relations.items()], point_id, kinds, n_parts, total)


def _listed(targets: DataFrame, occupied: DataFrame) -> DataFrame:
    """``targets`` once for each cell (strip, col) that they reach."""
    wide = f"(CAST(s1 AS DOUBLE) - CAST(s0 AS DOUBLE) + 1) * (CAST(c1 AS DOUBLE) - CAST(c0 AS DOUBLE) + 1) > {WIDE}"
    narrow = targets.where(f"NOT ({wide})").selectExpr("*", "explode(sequence(s0, s1)) AS strip").selectExpr("*", "explode(sequence(c0, c1)) AS col")
    return narrow.unionByName(targets.where(wide).join(occupied.select("strip", "col"), F.expr("strip BETWEEN s0 AND s1 AND col BETWEEN c0 AND c1")))


def _pieces(occupied: DataFrame, listed: DataFrame) -> DataFrame:
    """Cells that have points and targets, and the piece that each belongs to: first_unit, n_shares and n_blocks (of
    points and targets; more than one only where the piece's last cell outweighs a task), load_before and unit_load
    (in tasks), prev_col (the last cell in the same piece)."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    cells = occupied.join(listed.groupBy("strip", "col").agg(F.count("*").alias("n_t")), ["strip", "col"])
    load = f"n_p / {STRIP_POINTS}.0D + n_t / {STRIP_TARGETS}.0D"
    cells = cells.selectExpr("*", f"CAST(floor(coalesce(sum({load}) OVER (PARTITION BY strip ORDER BY col {before}), 0.0D)) AS BIGINT) AS piece")
    cells = cells.selectExpr("*", "lag(col) OVER (PARTITION BY strip, piece ORDER BY col) AS prev_col")
    pieces = cells.groupBy("strip", "piece").agg(F.sum("n_p").alias("sp"), F.sum("n_t").alias("st"))
    shares = lambda n, most: f"CAST(greatest(ceil({n} / {2 * most}.0D), 1) AS INT)"
    pieces = pieces.selectExpr("*", f"{shares('sp', STRIP_POINTS)} AS n_shares", f"{shares('st', STRIP_TARGETS)} AS n_blocks")
    pieces = pieces.selectExpr("*", f"sp / n_shares / {STRIP_POINTS}.0D + st / n_blocks / {STRIP_TARGETS}.0D AS unit_load", "CAST(n_shares AS BIGINT) * n_blocks AS n_units")
    # One row per piece: on a globe 180 / height, and one more for each task's load. So one task may order them.
    pieces = pieces.selectExpr(
        "strip", "piece", "n_shares", "n_blocks", "unit_load",
        f"coalesce(sum(unit_load * n_units) OVER (ORDER BY strip, piece {before}), 0.0D) AS load_before", f"coalesce(sum(n_units) OVER (ORDER BY strip, piece {before}), 0) AS first_unit",
    )
    return cells.select("strip", "col", "piece", "prev_col").join(pieces, ["strip", "piece"]).drop("piece")


def _swept(p: DataFrame, listed: DataFrame, cells: DataFrame, kinds: list[tuple[str, float | None]], point_id: str, ddl: str, n_parts: int, total: float) -> DataFrame:
    """Both sides by part, a range of pieces in order of latitude; swept there."""
    share = lambda n, cols: f"CAST(pmod(xxhash64({cols}), {n}) AS INT)"
    each = lambda n: f"explode(sequence(0, {n} - 1))"
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    number = "(CAST(share AS BIGINT) * n_blocks + block)"
    head = [f"CAST(least(floor((load_before + {number} * unit_load) * {n_parts / total!r}D), {n_parts - 1}) AS INT) AS part", f"first_unit + {number} AS unit"]
    # A target is in a piece once, with the first of its cells there.
    t = listed.join(cells, ["strip", "col"]).where("prev_col IS NULL OR prev_col < c0").selectExpr("*", f"{share('n_blocks', 'id, x, y, shape')} AS block", f"{each('n_shares')} AS share")
    q = p.join(cells, ["strip", "col"]).selectExpr("*", f"{share('n_shares', 'pid, x, y')} AS share", f"{each('n_blocks')} AS block")
    t = t.selectExpr(*head, "CAST(rel AS INT) AS rel", "id", f"CAST(NULL AS {kind(p, 'pid')}) AS pid", "x", "y", "shape")
    q = q.selectExpr(*head, "-1 AS rel", f"CAST(NULL AS {kind(listed, 'id')}) AS id", "pid", "x", "y", f"{_NO_SHAPE} AS shape")
    both = t.unionByName(q)
    both = both.repartitionById(n_parts, "part") if hasattr(both, "repartitionById") else both.repartition(n_parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept)
        rel, unit = rows.column("rel").to_numpy(), rows.column("unit").to_numpy()
        here = np.flatnonzero(rel == -1)
        own = rows.select(["pid", "x", "y"]).take(pa.array(here))
        x, y, pid = own.column("x").to_numpy(), own.column("y").to_numpy(), own.column("pid").combine_chunks()
        for number, (name, radius) in enumerate(kinds):
            there = np.flatnonzero(rel == number)
            t = rows.take(pa.array(there)).combine_chunks()
            if radius is None:
                targets: Discs | Regions = _unpacked(t.column("shape").combine_chunks())
            else:
                targets = Discs(t.column("x").to_numpy(), t.column("y").to_numpy(), radius)
            ids = t.column("id").combine_chunks()
            for i, j in sweep(targets, unit[there], x, y, unit[here]):
                yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(i), np.int64))), ids.take(pa.array(i)), pid.take(pa.array(j))], names=["rel_kind", "target_id", point_id])

    return both.drop("part").mapInArrow(run, ddl)


def near_points(points: DataFrame, sites: DataFrame, radius: float, point_id: str, site_id: str) -> DataFrame:
    """Pairs (site_id, point_id) of rows at most ``radius`` apart; see ``related``."""
    return related(points, point_id, {"": near(sites, radius, site_id)}).select(F.col("target_id").alias(site_id), point_id)


def points_in_regions(points: DataFrame, zones: DataFrame, point_id: str, zone_id: str, height: float = 0.02) -> DataFrame:
    """Pairs (zone_id, point_id) of a zone and a point that it contains; see ``related``."""
    return related(points, point_id, {"": within(zones, zone_id, height)}).select(F.col("target_id").alias(zone_id), point_id)
