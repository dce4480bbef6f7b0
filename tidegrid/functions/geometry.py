"""Plane geometry as Column expressions.

Kinds: ``pt`` (columns x, y), ``ls`` (``path``: array of vertices, or ``paths`` for a multi-part line) and ``pg``
(``rings``: array of rings, outer ones and holes of all parts alike). ``with_shape`` adds to lines and polygons their
segments and bbox once, so pairs only compute distances. Distances are Euclidean on raw coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("pt", "pg", "ls")
VERTEX = "struct<x:double,y:double>"
EARTH_M = 6371008.7714


def _vertices(ring: Column) -> Column:
    """Vertices that have both coordinates."""
    return F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))


def _segment(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def ring_segments(rings: Column) -> Column:
    """All sides of all rings, an unclosed ring closed. Rings of fewer than three vertices have none."""

    def sides(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.sequence(F.lit(1), n), lambda i: _segment(F.get(ring, i - 1), F.get(ring, i % n)))

    full = F.filter(F.transform(F.filter(rings, lambda r: r.isNotNull()), _vertices), lambda r: F.size(F.array_distinct(r)) >= 3)
    return F.flatten(F.transform(full, sides))


def path_segments(path: Column) -> Column:
    """Pieces of a line; none for fewer than two vertices."""
    v = _vertices(path)
    return F.when(F.size(v) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: _segment(F.get(v, i - 1), F.get(v, i))))


def bbox(segs: Column) -> Column:
    """Envelope of segments."""
    return F.struct(
        F.array_min(F.transform(segs, lambda s: F.least(s["ax"], s["bx"]))).alias("minx"), F.array_min(F.transform(segs, lambda s: F.least(s["ay"], s["by"]))).alias("miny"),
        F.array_max(F.transform(segs, lambda s: F.greatest(s["ax"], s["bx"]))).alias("maxx"), F.array_max(F.transform(segs, lambda s: F.greatest(s["ay"], s["by"]))).alias("maxy"),
    )


def point_box(x: Column, y: Column) -> Column:
    return F.struct(x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))


def with_shape(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with ``segs`` and ``box`` for lines and polygons, ``box`` for points. Rows without a shape (null or broken
    coordinates, lines of one vertex, polygons without a ring of three) are left out."""
    if kind == "pt":
        return df.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).withColumn("box", point_box(F.col("x"), F.col("y")))
    if kind == "pg":
        outer = F.size(F.array_distinct(_vertices(F.get("rings", F.lit(0))))) >= 3
        df = df.where(outer).withColumn("segs", ring_segments(F.col("rings")))
    elif "paths" in df.columns:
        df = df.withColumn("segs", F.flatten(F.filter(F.transform("paths", path_segments), lambda s: s.isNotNull())))
    else:
        df = df.withColumn("segs", path_segments(F.col("path")))
    return df.where(F.size("segs") > 0).withColumn("box", bbox(F.col("segs")))


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_segment(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a segment; a segment of no length counts as its first end."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    length = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - s["ax"]) * dx + (y - s["ay"]) * dy, length))), F.lit(0.0))
    ex, ey = x - s["ax"] - t * dx, y - s["ay"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def point_path(x: Column, y: Column, segs: Column) -> Column:
    return F.array_min(F.transform(segs, lambda s: point_segment(x, y, s)))


def inside(x: Column, y: Column, segs: Column) -> Column:
    """Even-odd ray cast over all rings; which side a point on the border gets is not defined."""

    def step(odd: Column, s: Column) -> Column:
        crosses = ((s["ay"] > y) != (s["by"] > y)) & (x < F.coalesce(F.try_divide((s["bx"] - s["ax"]) * (y - s["ay"]), s["by"] - s["ay"]), F.lit(0.0)) + s["ax"])
        return odd != crosses

    return F.aggregate(segs, F.lit(False), step)


def on_border(x: Column, y: Column, segs: Column) -> Column:
    return F.exists(segs, lambda s: point_segment(x, y, s) <= 1e-12)


def contains(x: Column, y: Column, segs: Column) -> Column:
    """Inside, borders excluded."""
    return inside(x, y, segs) & ~on_border(x, y, segs)


def point_polygon(x: Column, y: Column, segs: Column) -> Column:
    return F.when(inside(x, y, segs), F.lit(0.0)).otherwise(point_path(x, y, segs))


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def segment_segment(a: Column, b: Column) -> Column:
    """0 where two segments cross, else the least of the four ends' distances."""
    s1, s2 = _side(a["ax"], a["ay"], a["bx"], a["by"], b["ax"], b["ay"]), _side(a["ax"], a["ay"], a["bx"], a["by"], b["bx"], b["by"])
    s3, s4 = _side(b["ax"], b["ay"], b["bx"], b["by"], a["ax"], a["ay"]), _side(b["ax"], b["ay"], b["bx"], b["by"], a["bx"], a["by"])
    crossing = (((s1 > 0) & (s2 < 0)) | ((s1 < 0) & (s2 > 0))) & (((s3 > 0) & (s4 < 0)) | ((s3 < 0) & (s4 > 0)))
    ends = F.least(point_segment(b["ax"], b["ay"], a), point_segment(b["bx"], b["by"], a), point_segment(a["ax"], a["ay"], b), point_segment(a["bx"], a["by"], b))
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def path_path(a: Column, b: Column) -> Column:
    return F.array_min(F.transform(a, lambda s: F.array_min(F.transform(b, lambda t: segment_segment(s, t)))))


def _corner_inside(segs: Column, area: Column, box: Column) -> Column:
    """Whether a segment begins inside an area, of which ``box`` is the bbox."""
    boxed = lambda s: (s["ax"] >= box["minx"]) & (s["ax"] <= box["maxx"]) & (s["ay"] >= box["miny"]) & (s["ay"] <= box["maxy"])
    return F.exists(segs, lambda s: boxed(s) & inside(s["ax"], s["ay"], area))


def near_segments(segs: Column, box: Column, r: float) -> Column:
    """Segments whose own bbox is within ``r`` of ``box``: all that can be within ``r`` of a shape in it."""
    r = r * (1 + 1e-9) + 1e-12

    def near(s: Column) -> Column:
        out = F.lit(True)
        for c in "xy":
            a, b = s[f"a{c}"], s[f"b{c}"]
            out = out & (F.least(a, b) <= box[f"max{c}"] + r) & (F.greatest(a, b) >= box[f"min{c}"] - r)
        return out

    return F.filter(segs, near)


def distance(kind: str, a: str, query_kind: str, q: str, r: float | None = None) -> Column:
    """Distance of two shapes, whose columns are prefixed ``a`` and ``q``; 0 where they meet. Polygons are areas. With
    ``r``, only distances up to it need be right; others may come out larger, or null."""
    c = lambda prefix, name: F.col(f"{prefix}{name}")
    if kind == "pt" and query_kind == "pt":
        return point_distance(c(a, "x"), c(a, "y"), c(q, "x"), c(q, "y"))
    if query_kind == "pt":
        return distance(query_kind, q, kind, a)
    if kind == "pt":
        return (point_polygon if query_kind == "pg" else point_path)(c(a, "x"), c(a, "y"), c(q, "segs"))
    # A line's last vertex needs no test of its own: where no sides cross, one vertex tells for its whole part.
    overlap = F.lit(False)
    if query_kind == "pg":
        overlap = overlap | _corner_inside(c(a, "segs"), c(q, "segs"), c(q, "box"))
    if kind == "pg":
        overlap = overlap | _corner_inside(c(q, "segs"), c(a, "segs"), c(a, "box"))
    mine, other = c(a, "segs"), c(q, "segs")
    if r is not None:
        mine, other = near_segments(mine, c(q, "box"), r), near_segments(other, c(a, "box"), r)
    return F.when(overlap, F.lit(0.0)).otherwise(path_path(mine, other))


def box_distance(a: Column, b: Column) -> Column:
    """Distance of two bboxes; 0 where they meet."""
    dx = F.greatest(b["minx"] - a["maxx"], a["minx"] - b["maxx"], F.lit(0.0))
    dy = F.greatest(b["miny"] - a["maxy"], a["miny"] - b["maxy"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def haversine_m(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres along the sphere between two places in degrees."""
    r = F.radians
    cosine = F.sin(r(ay)) * F.sin(r(by)) + F.cos(r(ay)) * F.cos(r(by)) * F.cos(r(bx) - r(ax))
    return F.lit(EARTH_M) * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def segment_meets_box(ax: Column, ay: Column, bx: Column, by: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a segment and a closed rectangle share a point (clipping by the four sides)."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    fine = F.lit(True)
    for start, delta, low, high in ((ax, bx - ax, minx, maxx), (ay, by - ay, miny, maxy)):
        t0, t1 = F.try_divide(low - start, delta), F.try_divide(high - start, delta)
        fine = fine & F.when(delta == 0, (start >= low) & (start <= high)).otherwise(F.lit(True))
        lo = F.greatest(lo, F.when(delta != 0, F.least(t0, t1)))
        hi = F.least(hi, F.when(delta != 0, F.greatest(t0, t1)))
    return fine & (lo <= hi)


def polygon_meets_box(segs: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether an area and a closed rectangle share a point."""
    side = F.exists(segs, lambda s: segment_meets_box(s["ax"], s["ay"], s["bx"], s["by"], minx, miny, maxx, maxy))
    return side | inside(minx, miny, segs)


def path_length(path: Column) -> Column:
    """Length of an array of vertices (or of structs that have x and y)."""
    n = F.size(path)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(point_distance(F.get(path, i - 1)["x"], F.get(path, i - 1)["y"], F.get(path, i)["x"], F.get(path, i)["y"]), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)
