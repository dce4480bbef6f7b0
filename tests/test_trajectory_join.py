import random
import re
from math import inf, sqrt

import pytest

from tidegrid.operators import trajectories
from tidegrid.operators.windowing import Windows

DDL = "oid string, ts_ms bigint, x double, y double"
EDGE = 0.1 * (1 + 1e-9) + 1e-12


def fixes(rnd, n, ids):
    """Points on and off a raster, at few times: places at exactly the radius, ties of time, copies, negative and far coordinates."""
    rows = []
    for _ in range(n):
        x, y = rnd.choice([(rnd.uniform(-1, 1), rnd.uniform(-1, 1)), (rnd.randint(-9, 9) / 10, rnd.randint(-9, 9) / 20), (rnd.choice([-4, 4]) * EDGE, 0.0), (1e7 + rnd.randint(0, 3) / 16, -5.0), (1e300, rnd.randint(0, 1) * 1e-13)])
        rows += [(rnd.choice(ids), rnd.choice([-1, 0, 7, 7, 10, 25]), x, y)] * rnd.choice([1, 1, 2])
    return rows + [(None, 7, 0.0, 0.0), ("a", None, 0.0, 0.0), ("a", 7, None, 0.0), ("a", 7, float("nan"), 0.0), ("a", 7, inf, inf)]


def joined(left, right, r, size, slide, apart):
    usable = lambda rows: [p for p in rows if None not in p and all(-inf < v < inf for v in p[2:])]
    first, last = {}, {}
    for o, t, x, y in usable(left):
        for q, u, a, b in usable(right):
            if sqrt((x - a) * (x - a) + (y - b) * (y - b)) <= r and not (apart and o == q):
                for w in range(-size * 2, 100, slide):
                    if w <= t < w + size and w <= u < w + size:
                        first[w, o] = min(first.get((w, o), (t, x, y)), (t, x, y))
                        last[w, o, q] = max(last.get((w, o, q), (u, a, b)), (u, a, b))
    return sorted((w, w + size, o, q, *first[w, o], *v) for (w, o, q), v in last.items())


@pytest.mark.parametrize("r", [0.1, 0.0, 1e-13, 3.0, 1e6])
@pytest.mark.parametrize("apart", [False, True])
def test_join_without_grid(spark, r, apart):
    """All pairs by brute force, wherever they are."""
    rnd = random.Random(f"{r}{apart}")
    rows = fixes(rnd, 120, ["a", "b", "c"])
    other = rows if apart else fixes(rnd, 90, ["a", "b", "q"])
    left = spark.createDataFrame(rows, DDL)
    right = left if apart else spark.createDataFrame(other, DDL)
    size, slide = (20, 5) if r == 0.1 else (20, 20)
    got = trajectories.tjoin(left, right, r, None, Windows(size, slide), apart=apart)
    names = ["window_start", "window_end", "oid", "qid", "ts_ms", "x", "y", "q_ts_ms", "q_x", "q_y"]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(p[c] for c in names) for p in got.collect()) == joined(rows, other, r, size, slide, apart)


def test_join_without_grid_with_paths(spark):
    rows = [("a", 1, 200.0, 0.0), ("a", 2, 0.0, 0.0), ("b", 3, 0.0, 0.0)]
    other = [("q", 1, 200.05, 0.0), ("q", 4, 9.0, 9.0), ("s", 1, 0.0, 0.0)]
    got = trajectories.tjoin(spark.createDataFrame(rows, DDL), spark.createDataFrame(other, DDL), 0.1, None, Windows(10), paths=True).collect()
    assert [(p.oid, p.qid, [v.ts_ms for v in p.path], [v.ts_ms for v in p.q_path]) for p in got] == [("a", "q", [1, 2], [1, 4])]
    with pytest.raises(ValueError):
        trajectories.tjoin(spark.createDataFrame(rows, DDL), spark.createDataFrame(other, DDL), -1, None, Windows(10))


def test_join_without_grid_compares_near_points_only(spark):
    """A window's points meet by place too: the join has keys of its own for it, not the window alone."""
    one = spark.createDataFrame([("a", 1, 0.0, 0.0)], DDL)
    plan = trajectories.tjoin(one, one, 0.1, None, Windows(10))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Join \[([^]]*)\]", plan)
    assert keys and all({re.sub(r"#.*", "", k.strip()) for k in ks.split(",")} - {"window_start", "window_end"} for ks in keys)
