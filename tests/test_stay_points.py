import random
from math import hypot

import numpy as np
import pytest

from tidegrid.operators import stay_points as S

RULES = S.StayRules()
MIN = 60_000


def smallest_radius(pts):
    """By trying all circles through two or three points."""
    best = float("inf")
    ok = lambda c, r: all(hypot(p[0] - c[0], p[1] - c[1]) <= r * (1 + 1e-9) + 1e-15 for p in pts)
    if len(set(pts)) == 1:
        return 0.0
    for i, p in enumerate(pts):
        for j, q in enumerate(pts[:i]):
            c, r = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), hypot(p[0] - q[0], p[1] - q[1]) / 2
            if r < best and ok(c, r):
                best = r
            for s in pts[:j]:
                d = 2 * ((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]))
                if abs(d) > 1e-18:
                    a, b = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, (s[0] - p[0]) ** 2 + (s[1] - p[1]) ** 2
                    ux, uy = ((s[1] - p[1]) * a - (q[1] - p[1]) * b) / d, ((q[0] - p[0]) * b - (s[0] - p[0]) * a) / d
                    r = hypot(ux, uy)
                    if r < best and ok((p[0] + ux, p[1] + uy), r):
                        best = r
    return best


def brute(t, x, y):
    """Stops and trips of clean fixes, by the definitions, one fix after the other."""
    out, n, i, stop_of = [], len(t), 0, {}
    while i < n:
        j = i
        while j + 1 < n and t[j + 1] - t[j] <= RULES.max_gap and smallest_radius([(x[k], y[k]) for k in range(i, j + 2)]) <= RULES.radius:
            j += 1
        if t[j] - t[i] >= RULES.min_stop:
            out.append((S.STOP, t[i], t[j], j - i + 1))
            stop_of |= {k: (i, j) for k in range(i, j + 1)}
            i = j + 1
        else:
            i += 1
    i = 0
    while i < n:
        end = i
        while end + 1 < n and t[end + 1] - t[end] <= RULES.max_gap:
            end += 1
        k = i
        while k <= end:
            if k in stop_of:
                k = stop_of[k][1] + 1
                continue
            z = k
            while z + 1 <= end and z + 1 not in stop_of:
                z += 1
            a, b = (k - 1 if k > i else k), (z + 1 if z < end else z)
            if b - a + 1 >= RULES.min_trip_fixes:
                out.append((S.TRIP, t[a], t[b], b - a + 1))
            k = z + 1
        i = end + 1
    return sorted(out)


def track(rnd, n):
    t, x, y = [0], [0.0], [0.0]
    px = py = 0.0
    mode = 0
    for _ in range(n - 1):
        t.append(t[-1] + rnd.choice([30_000, 60_000, 120_000, 120_000] + [3 * 3_600_000] * (rnd.random() < 0.05)))
        if rnd.random() < 0.1:
            mode = rnd.choice([0, 0, 1, 2])
        step = (0, 0.004, 0.0006)[mode]
        px, py = px + step * rnd.uniform(0.5, 1), py + step * rnd.uniform(-1, 1)
        x.append(px + rnd.uniform(-0.0009, 0.0009))
        y.append(py + rnd.uniform(-0.0009, 0.0009))
    return np.array(t), np.array(x), np.array(y)


@pytest.mark.parametrize("seed", range(12))
def test_against_definitions(seed):
    t, x, y = track(random.Random(seed), 70)
    got = sorted((r[0], r[2], r[5], r[8]) for r in S.whole_track(t, x, y, RULES))
    assert got == brute(t.tolist(), x.tolist(), y.tolist())


def with_noise(rnd, t, x, y):
    x, y = x.copy(), y.copy()
    i = 3
    while i + 8 < len(t):
        if rnd.random() < 0.3:
            m = rnd.randint(1, 3)
            x[i : i + m] += 40
            i += m
        i += 3
    return x, y


@pytest.mark.parametrize("seed", range(20))
def test_parts_join_to_the_whole(seed):
    rnd = random.Random(seed)
    t, x, y = track(rnd, 400)
    x, y = with_noise(rnd, t, x, y)
    rounded = lambda rows: sorted((r[0], r[2], r[5], r[8], round(r[9], 9)) for r in rows)
    whole = rounded(S.whole_track(t, x, y, RULES))
    for _ in range(10):
        cuts = [0, *sorted(rnd.sample(range(1, 400), rnd.randint(1, 8))), 400]
        found, pieces = [], []
        for a, z in zip(cuts[:-1], cuts[1:]):
            first = rnd.randint(0, 99)
            rows, raw = S.part_of_track(t[a:z], x[a:z], y[a:z], first, a > 0, z < 400, RULES)
            found += [r for r in rows if r[0] < S.FIX]
            pieces += [r for r in rows if r[0] >= S.FIX]
            for i, j in raw:
                pieces += zip(*(c.tolist() for c in S.fix_columns(t[a:z][i:j], x[a:z][i:j], y[a:z][i:j], first + i)))
        pieces.sort(key=lambda r: (r[2], r[1]))
        assert rounded(found + S.join_pieces([np.array(c) for c in zip(*pieces)], RULES)) == whole


def test_noise():
    t = np.arange(12) * 30_000
    x, y = np.zeros(12), np.zeros(12)
    x[3:6], x[7] = 5, -9
    assert S.kept_fixes(t, x, y, RULES).tolist() == [True] * 3 + [False] * 3 + [True, False] + [True] * 4
    x[:] = 0
    x[6:] = 5  # a jump without a way back is no noise
    assert S.kept_fixes(t, x, y, RULES).all()


def test_frame(spark):
    rows = []
    for i in range(30):
        rows.append((i, ' "Bus-1"', 1704067200000 + i * MIN, 0.0001 * (i % 2), 0.0, "z"))
    for i in range(10):
        rows.append((100 + i, "bus-1", 1704067200000 + (30 + i) * MIN, 0.01 * (i + 1), 0.0, "z"))
    rows += [rows[5]] * 3 + [(None, "bus-1", rows[7][2] + 1, 0.0, 0.0, "z")] * 2
    rows += [(900, None, 1704067200000, 0.0, 0.0, "z"), (901, "bus-1", None, 0.0, 0.0, "z"), (902, "bus-1", 1704067200000, float("nan"), 0.0, "z"), (903, "bus-1", 12, 0.0, 0.0, "z"), (904, "x", 1704067200000, None, 0.0, "z")]
    df = spark.createDataFrame(rows, "event_id bigint, oid string, ts_ms bigint, x double, y double, kind string")
    got = sorted((r.oid, r.seg_kind, r.start_ms, r.end_ms, r.n_fixes, round(r.distance, 6)) for r in S.stops_and_trips(df).collect())
    first = 1704067200000
    assert got == [("bus-1", "stop", first, first + 29 * MIN, 31, 0.0029), ("bus-1", "trip", first + 29 * MIN, first + 39 * MIN, 11, 0.0999)]
    assert S.stops_and_trips(df.limit(0)).count() == 0


def test_hot_device_over_many_tasks(spark):
    t, x, y = track(random.Random(77), 3000)
    t = t + 1704067200000
    rows = [(i, "hot", int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, y))] + [(9000 + i, f"cold{i % 40}", int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t[:400], x, y))]
    df = spark.createDataFrame(rows, "event_id bigint, oid string, ts_ms bigint, x double, y double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted((r.seg_kind, r.start_ms, r.end_ms, r.n_fixes) for r in S.stops_and_trips(df).where("oid = 'hot'").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(("trip" if r[0] else "stop", r[2], r[5], r[8]) for r in S.whole_track(t, x, y, RULES))
