import random
from math import hypot

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.grid import BEIJING, Grid
from tidegrid.operators import cells, spatial, trajectories
from tidegrid.operators.prefix import ordinals, previous, running_sums
from tidegrid.operators.windowing import Windows, assign

GRID = Grid.by_count(10, 0.0, 1.0, 0.0, 1.0)


def ring(*vs):
    return [{"x": float(x), "y": float(y)} for x, y in vs]


def shapes(rnd, kind, n, size=0.12):
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-0.1, 1.1), rnd.uniform(-0.1, 1.1)
        if kind == "pt":
            rows.append((str(i), 1000 * i, x, y))
        elif kind == "ls":
            rows.append((str(i), 1000 * i, ring(*[(x + rnd.uniform(0, size), y + rnd.uniform(0, size)) for _ in range(3)])))
        else:
            w, h = rnd.uniform(0.01, size), rnd.uniform(0.01, size)
            outer = ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
            rows.append((str(i), 1000 * i, [outer, ring((x + w / 3, y + h / 3), (x + w / 2, y + h / 3), (x + w / 2, y + h / 2))]))
    return rows


DDL = {"pt": "oid string, ts_ms bigint, x double, y double", "ls": "oid string, ts_ms bigint, path array<struct<x:double,y:double>>", "pg": "oid string, ts_ms bigint, rings array<array<struct<x:double,y:double>>>"}


def jts(spark, kind, row):
    g = spark._jvm.org.locationtech.jts.io.WKTReader()
    text = lambda vs: "(" + ", ".join(f"{p['x']!r} {p['y']!r}" for p in vs) + ")"
    if kind == "pt":
        return g.read(f"POINT ({row[2]!r} {row[3]!r})")
    if kind == "ls":
        return g.read("LINESTRING " + text(row[2]))
    return g.read("POLYGON (" + ", ".join(text([*r, r[0]]) for r in row[2]) + ")")


@pytest.mark.parametrize("kind", G.KINDS)
@pytest.mark.parametrize("other", G.KINDS)
def test_pairs(spark, kind, other):
    """Distances against an independent library; pruned and plain joins and ranges agree."""
    rnd = random.Random(kind + other)
    left, right = shapes(rnd, kind, 30), shapes(rnd, other, 25)
    a, b = spark.createDataFrame(left, DDL[kind]), spark.createDataFrame(right, DDL[other])
    own, theirs = [jts(spark, kind, r) for r in left], [jts(spark, other, r) for r in right]
    r = 0.11
    exact = {(i[0], j[0]): g.distance(h) for i, g in zip(left, own) for j, h in zip(right, theirs)}
    plain = {(p.oid, p.q_oid): p.dist for p in spatial.spatial_join(a, b, r, None, kind, other).collect()}
    assert set(plain) == {k for k, v in exact.items() if v <= r}
    assert all(abs(v - exact[k]) < 1e-9 for k, v in plain.items())
    pruned = spatial.spatial_join(a, b, r, GRID, kind, other).collect()
    assert len({(p.oid, p.q_oid) for p in pruned}) == len(pruned)
    inside = lambda g: g.intersects(box)
    box = spark._jvm.org.locationtech.jts.io.WKTReader().read("POLYGON ((0 0, 0.999999 0, 0.999999 0.999999, 0 0.999999, 0 0))")
    fully = lambda g: box.contains(g)
    both = {(i[0], j[0]) for i, g in zip(left, own) for j, h in zip(right, theirs) if fully(g) and fully(h)}
    none = {(i[0], j[0]) for i, g in zip(left, own) for j, h in zip(right, theirs) if not inside(g) and kind == "pt"}
    found = {(p.oid, p.q_oid) for p in pruned}
    assert found <= set(plain) and set(plain) & both <= found and not found & none
    hits = {x.oid for x in spatial.range_query(a, b, r, GRID, kind, other, "oid").collect()}
    assert hits == {i for i, _ in found}
    near = spatial.range_query(a, b, r, GRID, kind, other, "oid", approximate=True)
    assert hits <= {x.oid for x in near.collect()}


def test_knn(spark):
    rnd = random.Random(1)
    rows = [(o, t, x, y) for o, t, x, y in shapes(rnd, "pt", 60)] + [("3", 10, 0.5, 0.5), ("4", 20, 0.5, 0.5), (None, 30, 0.5, 0.5), ("5", None, 0.5, 0.5)]
    pts = spark.createDataFrame(rows, DDL["pt"])
    place = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    got = [(r.window_start, r.rank, r.oid) for r in spatial.knn_query(pts, place, 0.4, 3, GRID, windows=Windows(20_000)).orderBy("window_start", "rank").collect()]
    want = []
    for w in range(0, 60_000, 20_000):
        best = {}
        for o, t, x, y in rows:
            d = hypot(x - 0.5, y - 0.5)
            if o is not None and t is not None and w <= t < w + 20_000 and d <= 0.4 and 0 <= x < 1 and 0 <= y < 1:
                best[o] = min(best.get(o, 9), d)
        want += [(w, i + 1, o) for i, (d, o) in enumerate(sorted((d, o) for o, d in best.items())[:3])]
    assert got == want
    assert spatial.knn_query(pts, place, 0.4, 500, None).count() <= 60
    with pytest.raises(ValueError):
        spatial.knn_query(pts, place, 0.4, 0, GRID)
    with pytest.raises(ValueError):
        spatial.range_query(pts, place, -1, GRID)


def test_grid_edges(spark):
    rows = [(0.0, 0.0), (1.0, 0.5), (-1e-9, 0.5), (0.999999, 0.999999), (float("nan"), 0.1), (None, 0.1), (1e300, 0.1), (float("inf"), 0.1)]
    df = spark.createDataFrame(rows, "x double, y double").select(F.coalesce(GRID.contains(F.col("x"), F.col("y")), F.lit(False)), GRID.cx(F.col("x")))
    assert [tuple(r) for r in df.collect()] == [(True, 0), (False, 10), (False, -1), (True, 9), (False, None), (False, None), (False, None), (False, None)]
    assert BEIJING.candidate_layers(0.1) == 5 and BEIJING.guaranteed_layers(0.1) == 2 and BEIJING.guaranteed_layers(0.001) < 0
    square = Grid.by_length(0.3, 0.0, 2.0, 0.0, 1.0)
    assert (square.min_y, square.n, round(square.cell, 6)) == (-0.5, 7, round(2 / 7, 6))
    point = spark.createDataFrame([("a", 0, 0.5, 0.5)], DDL["pt"])
    assert spatial.range_query(point, point, 0, GRID).count() == 1
    assert cells.cells_within(GRID, 0.05, 0.05, 0.1, spark).count() == 4
    assert cells.layer_cells(GRID, 0.55, 0.55, 2, spark).count() == 16
    assert cells.cells_within(GRID, 5.0, 5.0, 0.1, spark).count() == 0


def test_multi_parts_and_broken_shapes(spark):
    far, near = ring((5, 5), (6, 5), (6, 6)), ring((0.1, 0.1), (0.2, 0.1), (0.2, 0.2))
    rows = [("multi", 0, [far, near]), ("null", 0, None), ("two", 0, [ring((0, 0), (1, 1))]), ("empty", 0, []), ("hole", 0, [near, None])]
    polygons = spark.createDataFrame(rows, DDL["pg"])
    place = spark.createDataFrame([(0.15, 0.11)], "x double, y double")
    assert {r.oid for r in spatial.range_query(polygons, place, 0.01, None, "pg", "pt", "oid").collect()} == {"multi", "hole"}
    lines = spark.createDataFrame([("a", 0, [ring((5, 5), (6, 6)), ring((0.1, 0.1), (0.2, 0.1))])], "oid string, ts_ms bigint, paths array<array<struct<x:double,y:double>>>")
    assert spatial.range_query(lines, place, 0.02, None, "ls", "pt", "oid").count() == 1
    one = spark.createDataFrame([("a", 0, ring((1, 1)))], DDL["ls"])
    assert spatial.range_query(one, place, 9, None, "ls", "pt", "oid").count() == 0


def test_windows(spark):
    df = spark.createDataFrame([(0,), (-1,), (14_999,), (None,)], "ts_ms bigint")
    got = sorted((r.ts_ms, r.window_start) for r in assign(df, Windows(10_000, 4_000)).collect())
    want = sorted((t, w) for t in (0, -1, 14_999) for w in range(-40_000, 40_000, 4_000) if w <= t < w + 10_000)
    assert got == want
    with pytest.raises(ValueError):
        Windows(5, 6)


def test_prefix(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 500), i, rnd.randint(-3, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {}
    for k in ("a", "b", None):
        total, n, last = 0, 0, None
        for r in order:
            if r[0] == k:
                total, n = total + r[3], n + 1
                want[r[2]] = (total, n, last)
                last = r[3]
    summed = {r.i: r.s for r in running_sums(df, ["k"], "t", ["i"], {"s": F.col("v")}, 50).collect()}
    assert summed == {i: w[0] for i, w in want.items()}
    assert {r.i: r.rn for r in ordinals(df, ["k"], "t", ["i"], 50).collect()} == {i: w[1] for i, w in want.items()}
    lagged = {r.i: r.last_v for r in previous(df.where("k is not null"), ["k"], "t", ["i"], ["v"], 50).collect()}
    assert lagged == {r[2]: want[r[2]][2] for r in rows if r[0]}


def test_trajectories_edges(spark):
    rows = [(1, "a", 0, 0.05, 0.05), (2, "a", 0, 0.9, 0.9), (3, "a", 1000, 0.05, 0.15), (4, "b", 500, 0.05, 0.05), (5, None, 0, 0.1, 0.1), (6, "c", None, 0.1, 0.1), (7, "d", 5, float("nan"), 0.1)]
    pts = spark.createDataFrame(rows, "event_id bigint, oid string, ts_ms bigint, x double, y double")
    assert trajectories.tfilter(pts).count() == 4 and trajectories.tfilter(pts, ["b"]).count() == 1
    stats = trajectories.tstats(pts, stretch=300).collect()
    assert [(r.oid, r.ts_ms, round(r.spatial_len, 9), r.temporal_len_ms) for r in stats] == [("a", 1000, 0.1, 1000)]
    single = {r.oid: r.speed for r in trajectories.tstats(pts, windows=Windows(10_000)).collect()}
    assert single["b"] is None and single["a"] is not None
    heat = {(r.cx, r.cy): (r.n_traj, r.lengths) for r in trajectories.taggregate(pts, "nonsense", GRID, Windows(10_000)).collect()}
    assert heat == {(0, 0): (2, {"a": 0, "b": 0}), (9, 9): (1, {"a": 0}), (0, 1): (1, {"a": 0})}
    assert trajectories.taggregate(pts, "SUM", GRID, Windows(10_000)).count() == 0 and trajectories.taggregate(pts, "MIN", GRID, Windows(10_000)).count() == 0
    assert trajectories.taggregate_now(pts, "SUM", GRID).count() == 3
    zone = spark.createDataFrame([([ring((0, 0), (0.05, 0), (0.05, 0.05), (0, 0.05))],), ([ring((0, 0.1), (0.2, 0.1), (0.2, 0.2), (0, 0.2))],)], "rings array<array<struct<x:double,y:double>>>")
    assert [r.event_id for r in trajectories.trange(pts, zone, GRID).collect()] == [3]  # a corner is not inside
    assert trajectories.trange(pts, zone, GRID, Windows(10_000)).first().n == 3
    empty = pts.limit(0)
    for df in (trajectories.tstats(empty), trajectories.tknn(empty, 0, 0, 1, 1, GRID, Windows(10)), trajectories.tjoin(empty, pts, 1, GRID, Windows(10)), trajectories.taggregate(empty, "ALL", GRID, Windows(3, 1), True)):
        assert df.count() == 0


def test_haversine_and_meets_box(spark):
    row = spark.range(1).select(
        G.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("a"), G.haversine_m(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("b"),
        *(G.segment_meets_box(*(F.lit(float(v)) for v in s), *(F.lit(float(v)) for v in (0, 0, 1, 1))).alias(f"m{i}") for i, s in enumerate([(-1, 0.5, 2, 0.5), (-1, -1, 2, 2), (2, 0, 2, 1), (-1, 0.5, 1.5, 3), (0.5, 0.5, 0.5, 0.5), (1, 1, 2, 2)])),
    ).first()
    assert abs(row.a - 6371008.7714 * 3.141592653589793 / 2) < 1e-3 and row.b == 0
    assert [row[f"m{i}"] for i in range(6)] == [True, True, False, False, True, True]


def test_query_shapes(spark):
    tiles = cells.query_polygons(spark, 0.0, 2.0, 0.0, 1.0, 150, 10).collect()
    assert len(tiles) == 150 and abs(tiles[10].rings[0][0].x - 0.1) < 1e-12
    made = cells.query_points(spark, 0.0, 1.0, 5.0, 6.0, 50).collect()
    assert all(0 <= r.x < 1 and 5 <= r.y < 6 for r in made) and made == cells.query_points(spark, 0.0, 1.0, 5.0, 6.0, 50).collect()
    zone = spark.createDataFrame([("a", 5, [ring((0.05, 0.05), (0.25, 0.05), (0.25, 0.15))])], DDL["pg"])
    copies = cells.replicate(zone, GRID, "pg", oid="key")
    assert copies.count() == 6 and copies.select("key").distinct().count() == 1 and copies.first().ts_ms == 5
    assert cells.in_cells(zone, copies.select("cx", "cy"), GRID, "pg").count() == 1
    with pytest.raises(Exception, match="control"):
        cells.stop_on_control(spark.createDataFrame([("control",)], "kind string"), "kind").collect()


def test_knn_of_several_shapes(spark):
    pts = spark.createDataFrame([("a", 0, 0.1, 0.1), ("b", 0, 0.9, 0.9)], "oid string, ts_ms bigint, x double, y double")
    places = spark.createDataFrame([(0.1, 0.1), (0.9, 0.9)], "x double, y double")
    with pytest.raises(ValueError):
        spatial.knn_query(pts, places, 0.4, 3, GRID)
    assert [r.oid for r in spatial.knn_query(pts, places.where("x < 0.5"), 0.4, 3, GRID).collect()] == ["a"]
    assert spatial.knn_query(pts, places.limit(0), 0.4, 3, GRID).count() == 0
