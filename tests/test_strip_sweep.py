import random

import numpy as np
import pytest

from tidegrid.operators import strip_sweep as P

NAN = float("nan")
SQUARE = [(0.0, 0.0), (0.4, 0.0), (0.4, 0.4), (0.0, 0.4)]
HOLE = [(0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.1, 0.3), (0.1, 0.1)]


def ring(vs):
    return [{"x": x, "y": y} for x, y in vs]


def regions(*shapes):
    rings = [r for s in shapes for r in s]
    flat = np.array([v for r in rings for v in r], float)
    return P.Regions(flat[:, 0], flat[:, 1], np.array([len(r) for r in rings]), np.array([len(s) for s in shapes]))


def test_borders():
    own = regions([SQUARE, HOLE[:-1]], [[(116.774217, 40.59636), (116.804217, 40.62636), (116.774217, 40.62636)]])
    cases = {(0.05, 0.05): True, (0.2, 0.2): False, (0.4, 0.2): True, (0.0, 0.0): True, (0.1, 0.2): True, (0.1, 0.1): True, (0.3, 0.3): True, (0.41, 0.2): False, (0.4, 0.400001): False, (0.2, 0.399999): True}
    x, y = np.array([p[0] for p in cases]), np.array([p[1] for p in cases])
    assert own.holds(np.zeros(len(x), int), x, y).tolist() == list(cases.values())
    assert own.holds(np.array([1, 1, 0]), np.array([116.784217, 116.784218, 0.05]), np.array([40.60636, 40.60636, 0.05])).tolist() == [True, False, True]


@pytest.mark.parametrize("seed", range(5))
def test_sweep_is_complete(seed, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 500)
    rnd = np.random.default_rng(seed)
    x, y, piece = rnd.normal(0, 0.05, 800), rnd.normal(0, 0.05, 800), rnd.integers(0, 3, 800)
    tx, ty, tp = rnd.normal(0, 0.05, 60), rnd.normal(0, 0.05, 60), rnd.integers(0, 4, 60)
    got = [(a, b) for i, j in P.sweep(P.Discs(tx, ty, 0.01), tp, x, y, piece) for a, b in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a in range(60) for b in range(800) if tp[a] == piece[b] and np.hypot(tx[a] - x[b], ty[a] - y[b]) <= 0.01}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("small", [False, True])
def test_frame(spark, small, monkeypatch):
    if small:  # strips are cut, and single cells into shares and blocks
        monkeypatch.setattr(P, "STRIP_POINTS", 20)
        monkeypatch.setattr(P, "STRIP_TARGETS", 1)
        monkeypatch.setattr(P, "WIDE", 30)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0.2, rnd.uniform(-0.1, 0.5)]), rnd.choice([0.2, rnd.uniform(-0.1, 0.5)]), 1, 1) for i in range(400)]
    rows += [(900, NAN, 0.1, 1, 1), (901, None, 0.1, 1, 1), (902, float("inf"), 0.1, 1, 1), (903, 1e300, 1e300, 1, 1), rows[0]]
    points = spark.createDataFrame(rows, "event_id bigint, x double, y double, strip int, id int")
    sites = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.0, 0.0), (3, None, 0.1), (4, NAN, NAN), (2, 0.0, 0.0)], "site_id bigint, x double, y double")
    got = sorted((r.site_id, r.event_id) for r in P.near_points(points, sites, 0.05, "event_id", "site_id").collect())
    where = {1: (0.2, 0.2), 2: (0.0, 0.0)}
    one = lambda s: [(s, r[0]) for r in rows if r[1] is not None and np.hypot(r[1] - where[s][0], r[2] - where[s][1]) <= 0.05]
    assert got == sorted(one(1) + one(2) * 2) and got
    zones = [(1, [ring(SQUARE), ring(HOLE)]), (2, [ring(SQUARE[::-1] + [SQUARE[3]])]), (3, None), (4, [ring(SQUARE[:2])]), (5, []), (6, [None]), (7, [ring(SQUARE), None, ring(HOLE[:2])])]
    zones.append((8, [ring([(-1e300, -1e300), (1e301, -1e300), (1e301, 1e301), (-1e300, 1e301)])]))  # reaches every cell
    frame = spark.createDataFrame(zones, "zone_id bigint, rings array<array<struct<x:double,y:double>>>")
    got = sorted((r.zone_id, r.event_id) for r in P.points_in_regions(points, frame, "event_id", "zone_id").where("zone_id < 8").collect())
    inside = [r for r in rows if r[1] is not None and 0 <= r[1] <= 0.4 and 0 <= r[2] <= 0.4]
    want = [(z, r[0]) for z in (1, 2, 7) for r in inside if z != 1 or not (0.1 < r[1] < 0.3 and 0.1 < r[2] < 0.3)]
    assert got == sorted(want)
    for a, b in ((points.limit(0), sites), (points, sites.limit(0))):
        assert P.near_points(a, b, 0.05, "event_id", "site_id").count() == 0
    assert P.points_in_regions(points, frame.limit(0), "event_id", "zone_id").count() == 0


def test_both_relations_and_pairs_of_points(spark, monkeypatch):
    monkeypatch.setattr(P, "STRIP_POINTS", 30)
    monkeypatch.setattr(P, "STRIP_TARGETS", 30)
    rnd = random.Random(7)
    rows = [(i, *rnd.choice([(0.2, 0.2), (0.2003, 0.2), (rnd.uniform(0, 0.3), rnd.uniform(0, 0.3))])) for i in range(300)]
    points = spark.createDataFrame(rows, "a bigint, x double, y double")
    other = points.withColumnRenamed("a", "b")
    zones = spark.createDataFrame([(1, [ring(SQUARE), ring(HOLE)])], "b bigint, rings array<array<struct<x:double,y:double>>>")
    got = [tuple(r) for r in P.related(points, "a", {"near": P.near(other, 0.004, "b"), "in": P.within(zones, "b", 0.05)}).collect()]
    near = [("near", t[0], r[0]) for t in rows for r in rows if np.sqrt((t[1] - r[1]) ** 2 + (t[2] - r[2]) ** 2) <= 0.004]
    assert sorted(got) == sorted(near + [("in", 1, r[0]) for r in rows if not (0.1 < r[1] < 0.3 and 0.1 < r[2] < 0.3)])


def test_points_move_once(spark, monkeypatch):
    """In a dense strip joined to itself, rows of both sides grow with the points, not with their square."""
    monkeypatch.setattr(P, "STRIP_POINTS", 100)
    monkeypatch.setattr(P, "STRIP_TARGETS", 100)
    moved = []
    for n in (1_000, 4_000):
        points = spark.range(n).selectExpr("id AS a", "id * 0.002 AS x", "0.5 AS y")
        height = 0.002
        p = points.selectExpr("a", "x", "y", f"CAST(floor(y / {height}) AS BIGINT) AS strip", f"CAST(floor(x / {height}) AS BIGINT) AS col")
        t = P.near(points, 0.001, "a").rows(0).selectExpr("*", *(f"CAST(floor({c} / {height}) AS BIGINT) AS {k}" for k, c in (("s0", "y0"), ("s1", "y1"), ("c0", "x0"), ("c1", "x1"))))
        occupied = p.groupBy("strip", "col").agg({"*": "count"}).withColumnRenamed("count(1)", "n_p")
        listed = P._listed(t, occupied)
        cells = P._pieces(occupied, listed)
        held = listed.join(cells, ["strip", "col"]).where("prev_col IS NULL OR prev_col < c0")
        moved.append((p.join(cells, ["strip", "col"]).selectExpr("sum(n_blocks)").first()[0] / n, held.selectExpr("sum(n_shares)").first()[0] / n))
    assert all(a == 1 and b <= 1.1 for a, b in moved), moved


def test_vertices_without_numbers(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(-0.1, 0.5), rnd.uniform(-0.1, 0.5)) for i in range(200)]
    points = spark.createDataFrame(rows, "event_id bigint, x double, y double")
    inf = float("inf")
    zones = [(1, [ring([*SQUARE, (0.2, NAN)])]), (2, [ring([(0.2, -inf), *SQUARE])]), (3, [ring(SQUARE), ring([(0.2, NAN), *HOLE])]), (4, [ring([(inf, 9.0), (NAN, -9.0), *SQUARE])]), (5, [ring([(NAN, NAN)] * 4)]), (6, [ring([*SQUARE, (None, 0.1)]) + [None]])]
    frame = spark.createDataFrame(zones, "zone_id bigint, rings array<array<struct<x:double,y:double>>>")
    got = sorted((r.zone_id, r.event_id) for r in P.points_in_regions(points, frame, "event_id", "zone_id").collect())
    inside = [r for r in rows if 0 <= r[1] <= 0.4 and 0 <= r[2] <= 0.4]
    assert got == sorted((z, r[0]) for z in (1, 2, 3, 4, 6) for r in inside if z != 3 or not (0.1 < r[1] < 0.3 and 0.1 < r[2] < 0.3))
