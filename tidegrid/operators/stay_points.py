"""Trips and stops of moving devices, by stay-point detection over ordered tracks.

Tracks are range-partitioned by (oid, time), so a device with very many fixes spans several tasks and no task holds
more than its share. Each task finishes whatever can't depend on its neighbours. For a track that crosses a task's
border it keeps back only the fixes up to the first, and from the last, step longer than a stop is wide (no stop can
contain such a step), and sums up the movement in between; a second, small shuffle by oid joins those pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.canonical import canonical_oid, finite, is_usable


@dataclass(frozen=True)
class StayRules:
    """Distances in degrees, times in milliseconds, speed in degrees per second.

    A burst of at most ``max_burst`` fixes that needs more than ``max_speed`` to reach and to leave is noise.
    """

    radius: float = 0.0015
    min_stop: int = 600_000
    max_gap: int = 7_200_000
    max_speed: float = 0.002
    max_burst: int = 5
    min_trip_fixes: int = 3


#: Rows that a task should hold at most, as an oid's part of them is kept in arrays.
FIXES = 500_000
STOP, TRIP, FIX, MOVE, STAY, GAP = range(6)  # kinds of rows; the first two are results
PIECES = pa.schema([
    ("oid", pa.string()), ("kind", pa.int8()), ("ord", pa.int64()), ("t0", pa.int64()), ("x0", pa.float64()), ("y0", pa.float64()),
    ("t1", pa.int64()), ("x1", pa.float64()), ("y1", pa.float64()), ("n", pa.int64()), ("dist", pa.float64()),
])
_DDL = "oid string, kind tinyint, ord bigint, t0 bigint, x0 double, y0 double, t1 bigint, x1 double, y1 double, n bigint, dist double"


def _circle(pts: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Smallest circle round a few points."""
    cx, cy, r = pts[0][0], pts[0][1], 0.0
    out = lambda p: hypot(p[0] - cx, p[1] - cy) > r * (1 + 1e-12) + 1e-15
    for i, p in enumerate(pts):
        if not out(p):
            continue
        cx, cy, r = p[0], p[1], 0.0
        for j, q in enumerate(pts[:i]):
            if not out(q):
                continue
            cx, cy, r = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, hypot(p[0] - q[0], p[1] - q[1]) / 2
            for s in pts[:j]:
                if out(s):
                    ax, ay, bx, by = q[0] - p[0], q[1] - p[1], s[0] - p[0], s[1] - p[1]
                    det = 2 * (ax * by - ay * bx)
                    if det == 0:
                        continue
                    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
                    ux, uy = (by * a2 - ay * b2) / det, (ax * b2 - bx * a2) / det
                    cx, cy, r = p[0] + ux, p[1] + uy, hypot(ux, uy)
    return cx, cy, r


def fits(x: np.ndarray, y: np.ndarray, radius: float) -> bool:
    """Whether one place has all points within ``radius``."""
    w, h = x.max() - x.min(), y.max() - y.min()
    if hypot(w, h) / 2 <= radius:
        return True
    if max(w, h) > 2 * radius:
        return False
    chosen = {int(v) for f in (x, y, x + y, x - y) for v in (f.argmin(), f.argmax())}
    while True:  # the circle of the chosen points, until it holds all
        cx, cy, r = _circle([(float(x[i]), float(y[i])) for i in chosen])
        if r > radius * (1 + 1e-9):
            return False
        d = np.hypot(x - cx, y - cy)
        far = int(d.argmax())
        if d[far] <= radius or far in chosen:
            return True
        chosen.add(far)


def kept_fixes(t: np.ndarray, x: np.ndarray, y: np.ndarray, rules: StayRules) -> np.ndarray:
    """True for fixes that are no noise. The first fix is taken as good."""
    keep = np.ones(len(t), bool)
    fast = _fast(t, x, y, rules)
    at = np.flatnonzero(fast) + 1
    if not len(at):
        return keep
    n, done = len(t), 0

    def reachable(a: int, b: int) -> bool:
        return hypot(x[b] - x[a], y[b] - y[a]) * 1000 <= rules.max_speed * (t[b] - t[a])

    for p in at.tolist():
        if p <= done:
            continue
        for m in range(1, rules.max_burst + 1):
            if p + m >= n:
                break
            if fast[p + m - 1] and reachable(p - 1, p + m):
                keep[p : p + m] = False
                done = p + m
                break
    return keep


def _fast(t: np.ndarray, x: np.ndarray, y: np.ndarray, rules: StayRules) -> np.ndarray:
    return np.hypot(np.diff(x), np.diff(y)) * 1000 > rules.max_speed * np.diff(t)


def _stops(t: np.ndarray, x: np.ndarray, y: np.ndarray, cut: np.ndarray, rules: StayRules) -> list[tuple[int, int]]:
    """First and last index of each stop. ``cut``: steps that no stop may hold."""
    found = []
    lo = np.concatenate([[0], np.flatnonzero(cut) + 1])
    hi = np.concatenate([np.flatnonzero(cut), [len(t) - 1]])
    long = t[hi] - t[lo] >= rules.min_stop
    for a, z in zip(lo[long].tolist(), hi[long].tolist()):
        if fits(x[a : z + 1], y[a : z + 1], rules.radius):
            found.append((a, z))
            continue
        end = a  # last index known to fit with the anchor; never decreases
        while a <= z and t[z] - t[a] >= rules.min_stop:
            end, step = max(end, a), 1
            while step:  # gallop forward, then back
                if end + step <= z and fits(x[a : end + step + 1], y[a : end + step + 1], rules.radius):
                    end += step
                    step *= 2
                else:
                    step //= 2
            if t[end] - t[a] >= rules.min_stop:
                found.append((a, end))
                a = end + 1
            else:
                a += 1
    return found


def elements(t: np.ndarray, x: np.ndarray, y: np.ndarray, ord_: np.ndarray, rules: StayRules) -> list[tuple]:
    """Good fixes as a sequence of stays, moves and gaps: rows (kind, ord, t0, x0, y0, t1, x1, y1, n, dist)."""
    n = len(t)
    if not n:
        return []
    dt, d = np.diff(t), np.hypot(np.diff(x), np.diff(y))
    gap = dt > rules.max_gap
    along = np.concatenate([[0.0], np.cumsum(d)])
    gaps = np.flatnonzero(gap).tolist()
    out: list[tuple] = []

    def span(kind: int, a: int, z: int) -> None:
        if z >= a:
            out.append((kind, int(ord_[a]) * 2, int(t[a]), float(x[a]), float(y[a]), int(t[z]), float(x[z]), float(y[z]), z - a + 1, float(along[z] - along[a])))

    at, g = 0, 0

    def moves(until: int) -> None:
        nonlocal at, g
        while g < len(gaps) and gaps[g] < until:
            span(MOVE, at, gaps[g])
            i = gaps[g]
            out.append((GAP, int(ord_[i]) * 2 + 1, int(t[i]), 0.0, 0.0, int(t[i]), 0.0, 0.0, 0, 0.0))
            at, g = gaps[g] + 1, g + 1
        span(MOVE, at, until - 1)
        at = until

    for a, z in _stops(t, x, y, gap | (d > 2 * rules.radius), rules):
        moves(a)
        span(STAY, a, z)
        at = z + 1
    moves(n)
    return out


def assemble(parts: list[tuple], rules: StayRules) -> list[tuple]:
    """Results of a sequence of stays, moves and gaps. Stays of negative ``n`` have been reported before."""
    out: list[tuple] = []
    last = move = None

    def trip(after: tuple | None) -> None:
        if move is None:
            return
        n, dist = move[8] + (last is not None) + (after is not None), move[9]
        t0, x0, y0 = move[2:5] if last is None else last[5:8]
        t1, x1, y1 = move[5:8] if after is None else after[2:5]
        if n >= rules.min_trip_fixes:
            dist += (hypot(move[3] - x0, move[4] - y0) if last else 0) + (hypot(x1 - move[6], y1 - move[7]) if after else 0)
            out.append((TRIP, 0, t0, x0, y0, t1, x1, y1, n, dist))

    for p in parts:
        if p[0] == MOVE:
            move = p if move is None else (MOVE, move[1], *move[2:5], *p[5:8], move[8] + p[8], move[9] + p[9] + hypot(p[3] - move[6], p[4] - move[7]))
            continue
        trip(p if p[0] == STAY else None)
        last, move = (p if p[0] == STAY else None), None
        if p[0] == STAY and p[8] > 0:
            out.append((STOP, 0, *p[2:]))
    trip(None)
    return out


def whole_track(t: np.ndarray, x: np.ndarray, y: np.ndarray, rules: StayRules) -> list[tuple]:
    """Stops and trips of one device's fixes in time order."""
    k = kept_fixes(t, x, y, rules)
    return assemble(elements(t[k], x[k], y[k], np.flatnonzero(k), rules), rules)


def part_of_track(t: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, left_open: bool, right_open: bool, rules: StayRules) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Results that the fixes before and after can't change with other pieces for ``join_pieces``, and the index ranges
    of the fixes that it needs one by one."""
    if not (left_open or right_open):
        return whole_track(t, x, y, rules), []
    n, ord_ = len(t), np.arange(first, first + len(t))
    fast = np.flatnonzero(_fast(t, x, y, rules))
    lo, hi = np.concatenate([[0], fast + 1]), np.concatenate([fast, [n - 1]])
    sure = np.flatnonzero(hi - lo >= rules.max_burst)  # too long for a burst: all good
    if not len(sure):
        return [], [(0, n)]
    a = int(lo[sure[0]]) if left_open else 0
    z = int(hi[sure[-1]]) if right_open else n - 1
    k = np.flatnonzero(kept_fixes(t[a:], x[a:], y[a:], rules)) + a
    k = k[k <= z]
    apart = np.flatnonzero((np.hypot(np.diff(x[k]), np.diff(y[k])) > 2 * rules.radius) | (np.diff(t[k]) > rules.max_gap))
    if len(apart) < left_open + right_open:
        return [], [(0, n)]
    i = int(apart[0]) + 1 if left_open else 0
    j = int(apart[-1]) if right_open else len(k) - 1
    raw = ([(0, int(k[i - 1]) + 1)] if left_open else []) + ([(int(k[j + 1]), n)] if right_open else [])
    mid = k[i : j + 1]
    parts = elements(t[mid], x[mid], y[mid], ord_[mid], rules)
    anchors = [q for q, p in enumerate(parts) if p[0] != MOVE]
    # A track that ends or begins here has its outermost trip here too; so only the open sides' parts go on.
    if not anchors:
        return parts, raw
    f, m = anchors[0], anchors[-1]
    done = assemble(parts[f : m + 1], rules)
    seen = lambda p: (p[0], *p[1:8], -p[8], p[9]) if p[0] == STAY else p
    between = [(GAP, parts[f][1] + 1, parts[f][5], 0.0, 0.0, parts[f][5], 0.0, 0.0, 0, 0.0)] if m > f else []
    return done + parts[:f] + [seen(parts[f])] + between + ([seen(parts[m])] if m > f else []) + parts[m + 1 :], raw


def join_pieces(cols: list[np.ndarray], rules: StayRules) -> list[tuple]:
    """Results of one device's pieces in time order, given by columns (kind, ord, t0, x0, y0, ...)."""
    parts: list[tuple] = []

    def add(new: list[tuple]) -> None:
        for p in new:
            if parts and parts[-1][0] != GAP and p[0] != GAP and p[2] - parts[-1][5] > rules.max_gap:
                parts.append((GAP, 0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0, 0.0))
            parts.append(p)

    fix = cols[0] == FIX
    edges = [0, *(np.flatnonzero(fix[1:] != fix[:-1]) + 1).tolist(), len(fix)]
    for a, z in zip(edges[:-1], edges[1:]):
        if a == z:
            continue
        if fix[a]:  # fixes stay arrays, however many there are
            t, x, y = (c[a:z] for c in cols[2:5])
            k = kept_fixes(t, x, y, rules)
            add(elements(t[k], x[k], y[k], np.flatnonzero(k), rules))
        else:
            add(list(zip(*(c[a:z].tolist() for c in cols))))
    return assemble(parts, rules)


def _emit(found: list[tuple[str, list[tuple]]]) -> pa.RecordBatch:
    oids = [o for o, rows in found for _ in rows]
    rows = [r for _, more in found for r in more]
    cols = list(zip(*rows)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(oids, pa.string()), *(pa.array(c, f.type) for c, f in zip(cols, list(PIECES)[1:]))], schema=PIECES)


def fix_columns(t: np.ndarray, x: np.ndarray, y: np.ndarray, first: int) -> list[np.ndarray]:
    """Single fixes as pieces' columns."""
    n = len(t)
    return [np.full(n, FIX, np.int8), np.arange(first, first + n) * 2, t, x, y, t, x, y, np.ones(n, np.int64), np.zeros(n)]


def _emit_fixes(oid: str, cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([oid] * len(cols[0]), pa.string()), *(pa.array(c, f.type) for c, f in zip(cols, list(PIECES)[1:]))], schema=PIECES)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str, list[np.ndarray], bool]]:
    """Each oid's columns, from rows sorted by oid, and whether it is the last. Holds one oid at a time."""
    oid, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        o = batch.column(0)
        edges = [0, *(np.flatnonzero(pc.not_equal(o.slice(1), o.slice(0, len(o) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(o)]
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        for a, z in zip(edges[:-1], edges[1:]):
            name = o[a].as_py()
            if name != oid and held:
                yield oid, [np.concatenate(c) for c in zip(*held)], False
                held = []
            oid = name
            held.append([c[a:z] for c in cols])
    if held:
        yield oid, [np.concatenate(c) for c in zip(*held)], True


def stops_and_trips(points: DataFrame, rules: StayRules = StayRules()) -> DataFrame:
    """Stops and trips: oid, seg_kind, start_ms, end_ms, duration_ms, n_fixes, distance, x0, y0, x1, y1.

    Fixes need a non-blank oid, a usable time and finite coordinates; rows with the same oid, time and ``event_id`` (or
    without ``event_id`` the same coordinates) are one fix. Fixes of equal time are taken in order of ``event_id``. A
    stop is a longest run of neighbours within ``radius`` of one place; where two could overlap, the earlier has the
    shared fixes. An empty table, and a device with fewer than three fixes and no stop, give no rows.
    """
    fixes = (
        points.where(is_usable(F.col("ts_ms")) & finite(F.col("x")) & finite(F.col("y")))
        .select(canonical_oid(F.col("oid")).alias("oid"), "ts_ms", "event_id", "x", "y")
        .where(F.col("oid").isNotNull())
    )
    # Ranges of no more than about FIXES rows, however large the table and the share of one oid; small tables are left to
    # the session's number of partitions, which adapts to them.
    n_ranges = -(-points.count() // FIXES)
    by = ["oid", "ts_ms"]
    fixes = fixes.repartitionByRange(n_ranges, *by) if n_ranges > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) else fixes.repartitionByRange(*by)
    fixes = (
        fixes.sortWithinPartitions("oid", "ts_ms", "event_id", "x", "y")
        .select("oid", "ts_ms", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.col("event_id").isNull().alias("nameless"), "x", "y")
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, first, at = [], 0, True, 0
        for oid, (t, e, nameless, x, y), last in _groups(batches, ["ts_ms", "event_id", "nameless", "x", "y"]):
            copy = np.zeros(len(t), bool)
            copy[1:] = (t[1:] == t[:-1]) & (e[1:] == e[:-1]) & (nameless[1:] == nameless[:-1]) & (~nameless[1:] | ((x[1:] == x[:-1]) & (y[1:] == y[:-1])))
            if copy.any():
                t, x, y = t[~copy], x[~copy], y[~copy]
            rows, raw = part_of_track(t, x, y, at, first, last, rules)
            for a, z in raw:
                for i in range(a, z, 50_000):
                    j = min(i + 50_000, z)
                    yield _emit_fixes(oid, fix_columns(t[i:j], x[i:j], y[i:j], at + i))
            at, first = at + len(t), False
            found.append((oid, rows))
            size += len(rows)
            if size > 20_000:
                yield _emit(found)
                found, size = [], 0
        yield _emit(found)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ready = pc.less(batch.column(1), FIX)
                done.append(batch.filter(ready))
                yield batch.filter(pc.invert(ready))

        done: list[pa.RecordBatch] = []
        for oid, cols, _ in _groups(pieces(), PIECES.names[1:]):
            yield from done
            done.clear()
            yield _emit([(oid, join_pieces(cols, rules))])
        yield from done

    piece = F.col("kind") >= FIX
    out = (
        fixes.mapInArrow(local, _DDL)
        .repartition(F.when(piece, F.col("oid")).otherwise(F.concat("oid", F.lit("\0"), F.col("t0").cast("string"))))
        .sortWithinPartitions(piece, "oid", "t0", "ord")
        .mapInArrow(join, _DDL)
    )
    return out.select(
        "oid", F.when(F.col("kind") == STOP, "stop").otherwise("trip").alias("seg_kind"), F.col("t0").alias("start_ms"), F.col("t1").alias("end_ms"),
        (F.col("t1") - F.col("t0")).alias("duration_ms"), F.col("n").alias("n_fixes"), F.col("dist").alias("distance"), "x0", "y0", "x1", "y1",
    )
