"""SQL of the spatial queries: the same results by plain comparison of rows, without the operators' plans."""

from __future__ import annotations

from tidegrid.functions.geometry import KINDS
from tidegrid.grid import BEIJING
from tidegrid.plans import spatial_queries as q

USABLE = 1577836800000
CELL, MIN_X, MIN_Y, N = repr(BEIJING.cell), repr(BEIJING.min_x), repr(BEIJING.min_y), BEIJING.n
_OID = "nullif(lower(trim(replace(oid, '\"', ''))), '')"
CX = f"CAST(floor((x - CAST({MIN_X} AS DOUBLE)) / CAST({CELL} AS DOUBLE)) AS INT)"
CY = f"CAST(floor((y - CAST({MIN_Y} AS DOUBLE)) / CAST({CELL} AS DOUBLE)) AS INT)"

POINTS = f"SELECT event_id, {_OID} AS oid, ts_ms, x, y FROM moving_points WHERE {_OID} IS NOT NULL AND ts_ms >= {USABLE} AND isfinite(x) AND isfinite(y)"
EVENTS = f"SELECT event_id, min(oid) AS oid, min(ts_ms) AS ts_ms, min(x) AS x, min(y) AS y FROM ({POINTS}) GROUP BY event_id"
PINGS = f"SELECT event_id, CAST(user_id AS VARCHAR) AS oid, epoch_us(ts) // 1000 AS ts_ms, {q.PING_X} AS x, {q.PING_Y} AS y FROM events"
ZONE_STREAM = f"SELECT event_id, min({_OID}) AS oid, min(ts_ms) AS ts_ms, any_value(rings) AS rings FROM zone_stream WHERE {_OID} IS NOT NULL AND ts_ms >= {USABLE} GROUP BY event_id"
ZONES = f"SELECT zone_id, CASE WHEN ts_ms >= {USABLE} THEN ts_ms END AS ts_ms, rings FROM zones"
SITES = "SELECT site_id, x, y FROM sites WHERE isfinite(x) AND isfinite(y)"


def _line(name: str) -> str:
    f = q.line_fields(name)
    path = ", ".join(f"{{'x': {f[f'x{i}']}, 'y': {f[f'y{i}']}}}" for i in range(3))
    return f"SELECT {f['oid']} AS oid, {f['ts_ms']} AS ts_ms, [{path}] AS path FROM {name}"


STREAMS = {"pt": POINTS, "pg": ZONE_STREAM, "ls": _line("customer")}
QUERY_SETS = {"pt": SITES, "pg": ZONES, "ls": _line("supplier")}
QUERY_STREAMS = {"pt": PINGS, "pg": ZONES, "ls": _line("supplier")}


def one_shape(kind: str) -> str:
    if kind == "pt":
        return f"SELECT CAST({q.PLACE[0]} AS DOUBLE) AS x, CAST({q.PLACE[1]} AS DOUBLE) AS y"
    vertices = lambda vs: "[" + ", ".join(f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}" for x, y in vs) + "]"
    return f"SELECT [{vertices(q.QUERY_RING)}] AS rings" if kind == "pg" else f"SELECT {vertices(q.QUERY_PATH)} AS path"


_SEG = "{{'ax': {a}.x, 'ay': {a}.y, 'bx': {b}.x, 'by': {b}.y}}"
_RING = "list_transform(generate_series(1, len(v)), lambda i: " + _SEG.format(a="v[i]", b="v[i % len(v) + 1]") + ")"
_PATH = "list_transform(generate_series(1, len(path) - 1), lambda i: " + _SEG.format(a="path[i]", b="path[i + 1]") + ")"


def shaped(sql: str, kind: str) -> str:
    """Rows with a number, their shape, bbox and the cells of it, as far as they are in the grid."""
    if kind == "pt":
        inner = f"SELECT *, x AS minx, x AS maxx, y AS miny, y AS maxy FROM ({sql})"
    else:
        if kind == "pg":
            segs = f"flatten(list_transform(list_filter(rings, lambda v: len(list_distinct(v)) >= 3), lambda v: {_RING}))"
            sql = f"SELECT *, {segs} AS segs FROM ({sql}) WHERE len(list_distinct(rings[1])) >= 3"
        else:
            sql = f"SELECT *, {_PATH} AS segs FROM ({sql})"
        ends = lambda f, c: f"list_{f}(list_transform(segs, lambda s: {'least' if f == 'min' else 'greatest'}(s.a{c}, s.b{c})))"
        inner = f"SELECT *, {ends('min', 'x')} AS minx, {ends('max', 'x')} AS maxx, {ends('min', 'y')} AS miny, {ends('max', 'y')} AS maxy FROM ({sql})"
    cell = lambda c, a: f"CAST(floor(({c} - CAST({MIN_X if a == 'x' else MIN_Y} AS DOUBLE)) / CAST({CELL} AS DOUBLE)) AS INT)"
    cells = ", ".join(f"{cell(f'{m}{a}', a)} AS c{m}{a}" for m in ("min", "max") for a in "xy")
    return f"SELECT row_number() OVER () AS rid, *, {cells} FROM ({inner})"


def pt_seg(x: str, y: str, s: str) -> str:
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    t = f"coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - {s}.ax) * {dx} + ({y} - {s}.ay) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0.0::DOUBLE)"
    e = lambda v, a, d: f"({v} - {s}.{a} - {t} * {d})"
    ex, ey = e(x, "ax", dx), e(y, "ay", dy)
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def inside(x: str, y: str, segs: str) -> str:
    crosses = f"((s.ay > {y}) <> (s.by > {y})) AND ({x} < coalesce((s.bx - s.ax) * ({y} - s.ay) / nullif(s.by - s.ay, 0), 0.0::DOUBLE) + s.ax)"
    return f"(len(list_filter({segs}, lambda s: {crosses})) % 2 = 1)"


def _side(p: tuple[str, str], r: tuple[str, str], t: tuple[str, str]) -> str:
    return f"(({r[0]} - {p[0]}) * ({t[1]} - {p[1]}) - ({r[1]} - {p[1]}) * ({t[0]} - {p[0]}))"


def seg_seg(a: str, b: str) -> str:
    ends = lambda s: ((f"{s}.ax", f"{s}.ay"), (f"{s}.bx", f"{s}.by"))
    (a1, a2), (b1, b2) = ends(a), ends(b)
    cross = f"sign({_side(a1, a2, b1)}) * sign({_side(a1, a2, b2)}) < 0 AND sign({_side(b1, b2, a1)}) * sign({_side(b1, b2, a2)}) < 0"
    return f"CASE WHEN {cross} THEN 0.0::DOUBLE ELSE least({pt_seg(*b1, a)}, {pt_seg(*b2, a)}, {pt_seg(*a1, b)}, {pt_seg(*a2, b)}) END"


def distance(kind: str, a: str, query_kind: str, b: str) -> str:
    if kind == "pt" and query_kind == "pt":
        return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
    if query_kind == "pt":
        return distance(query_kind, b, kind, a)
    if kind == "pt":
        near = f"list_min(list_transform({b}.segs, lambda s: {pt_seg(f'{a}.x', f'{a}.y', 's')}))"
        return f"CASE WHEN {inside(f'{a}.x', f'{a}.y', f'{b}.segs')} THEN 0.0::DOUBLE ELSE {near} END" if query_kind == "pg" else near
    corner = lambda segs, area: f"list_bool_or(list_transform({segs}, lambda c: {inside('c.ax', 'c.ay', area)}))"
    tests = ([corner(f"{a}.segs", f"{b}.segs")] if query_kind == "pg" else []) + ([corner(f"{b}.segs", f"{a}.segs")] if kind == "pg" else [])
    near = f"list_min(list_transform({a}.segs, lambda m: list_min(list_transform({b}.segs, lambda n: {seg_seg('m', 'n')}))))"
    return f"CASE WHEN {' OR '.join(tests)} THEN 0.0::DOUBLE ELSE {near} END" if tests else near


def box_distance(a: str, b: str) -> str:
    d = lambda c: f"greatest({b}.min{c} - {a}.max{c}, {a}.min{c} - {b}.max{c}, 0.0::DOUBLE)"
    return f"sqrt({d('x')} * {d('x')} + {d('y')} * {d('y')})"


def pairs(kind: str, query_kind: str, left: str, right: str, r: float, grid: bool = True, approximate: bool = False, windowed: int = 0) -> str:
    """CTEs ``a``, ``b`` and ``p`` (a's and b's numbers, dist, window_start) of all pairs within ``r``."""
    layers = BEIJING.candidate_layers(r)
    on = [f"{box_distance('a', 'b')} <= {r!r} * (1 + 1e-9) + 1e-12"]
    if grid:
        on += [f"greatest(a.cmin{c}, b.cmin{c} - {layers}, 0) <= least(a.cmax{c}, b.cmax{c} + {layers}, {N - 1})" for c in "xy"]
        on += [f"a.cmin{c} <= {N - 1} AND a.cmax{c} >= 0" for c in "xy"]
    if windowed:
        on.append(f"a.ts_ms - a.ts_ms % {windowed} = b.ts_ms - b.ts_ms % {windowed}")
    dist = box_distance("a", "b") if approximate else distance(kind, "a", query_kind, "b")
    start = f", a.ts_ms - a.ts_ms % {windowed} AS window_start" if windowed else ""
    return f"""WITH a AS MATERIALIZED ({shaped(left, kind)}), b AS MATERIALIZED ({shaped(right, query_kind)}),
near AS MATERIALIZED (SELECT a.rid AS ra, b.rid AS rb FROM a JOIN b ON {' AND '.join(on)}),
measured AS MATERIALIZED (SELECT ra, rb, {dist} AS dist{start} FROM near JOIN a ON a.rid = ra JOIN b ON b.rid = rb),
p AS (SELECT * FROM measured WHERE dist <= {r!r})"""


def windows(sql: str, size: int, slide: int) -> str:
    """Rows of ``sql`` once for each window, with window_start."""
    return f"SELECT t.*, t.ts_ms - t.ts_ms % {slide} - i * {slide} AS window_start FROM ({sql}) t, generate_series(0, {size // slide - 1}) g(i)"


def _range(kind: str, query_kind: str, windowed: bool = False, **how: bool) -> str:
    keys = ", ".join(f"a.{k}" for k in q.KEYS[kind])
    hits = f"SELECT {keys} FROM a WHERE rid IN (SELECT ra FROM p)"
    with_ = pairs(kind, query_kind, STREAMS[kind], QUERY_SETS[query_kind], q.R, **how)
    return f"{with_}\n{windows(hits, q.TWO_DAYS.size, q.TWO_DAYS.step) if windowed else hits}"


def knn(kind: str, query_kind: str, size: int, slide: int, **how: bool) -> str:
    hits = f"SELECT a.oid, a.ts_ms, p.dist FROM p JOIN a ON a.rid = ra"
    return f"""{pairs(kind, query_kind, STREAMS[kind], one_shape(query_kind), q.KNN_R, **how)},
w AS ({windows(hits, size, slide)}), m AS (SELECT window_start, oid, min(dist) AS dist FROM w GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY dist, oid) AS INT) AS rank FROM m)
SELECT window_start, rank, oid, round(dist, 6) AS dist FROM o WHERE rank <= {q.K}"""


def _knn(kind: str, query_kind: str, **how: bool) -> str:
    return knn(kind, query_kind, q.TWO_DAYS.size, q.TWO_DAYS.step, **how)


def _join(kind: str, query_kind: str, **how: bool) -> str:
    keys = ", ".join([*(f"a.{k}" for k in q.KEYS[kind]), *(f"b.{k} AS q_{k}" for k in q.Q_KEYS[query_kind])])
    right = f"SELECT * FROM ({QUERY_STREAMS[query_kind]}) WHERE ts_ms IS NOT NULL"
    return f"{pairs(kind, query_kind, STREAMS[kind], right, q.JOIN_R, windowed=q.DAY, **how)}\nSELECT window_start, {keys}, round(dist, 6) AS dist FROM p JOIN a ON a.rid = ra JOIN b ON b.rid = rb"


SQL: dict[str, str] = {}
for _k in KINDS:
    for _q in KINDS:
        SQL[f"range_{_k}_{_q}"] = _range(_k, _q)
        SQL[f"knn_{_k}_{_q}_window"] = _knn(_k, _q)
        SQL[f"join_{_k}_{_q}_window"] = _join(_k, _q)
        SQL[f"range_{_k}_{_q}_window"] = _range(_k, _q, windowed=True)
        SQL[f"range_{_k}_{_q}_approx"] = _range(_k, _q, approximate=True)
        SQL[f"knn_{_k}_{_q}_approx"] = _knn(_k, _q, approximate=True)
        SQL[f"join_{_k}_{_q}_approx"] = _join(_k, _q, approximate=True)
SQL["range_pt_pg_naive"] = _range("pt", "pg", grid=False)
SQL["knn_pt_pg_naive"] = _knn("pt", "pg", grid=False)
SQL["join_pt_pt_naive"] = _join("pt", "pt", grid=False)
SQL["join_pt_pg_naive"] = _join("pt", "pg", grid=False)

IDS = ", ".join(f"'{i}'" for i in q.IDS)
_STEP = "coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0)"


def _two_days(sql: str) -> str:
    return windows(sql, q.TWO_DAYS.size, q.TWO_DAYS.step)


def _summary(rows: str, keys: str, having: str = "count(*) >= 2") -> str:
    steps = f"SELECT *, {_STEP} AS step FROM ({rows}) WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ms, x, y)"
    return f"SELECT {keys}, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, round(sum(step), 6) AS length FROM ({steps}) GROUP BY {keys} HAVING {having}"


#: Points strictly inside some zone.
CONTAINED = f"""SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.x >= b.minx AND a.x <= b.maxx AND a.y >= b.miny AND a.y <= b.maxy
AND CASE WHEN a.x >= b.minx AND a.x <= b.maxx AND a.y >= b.miny AND a.y <= b.maxy THEN {inside('a.x', 'a.y', 'b.segs')} AND list_min(list_transform(b.segs, lambda s: {pt_seg('a.x', 'a.y', 's')})) > 1e-12 ELSE false END)"""


def _contained(points: str) -> str:
    return f"WITH a AS MATERIALIZED ({shaped(points, 'pt')}), b AS MATERIALIZED ({shaped(ZONES, 'pg')}), inner_points AS MATERIALIZED ({CONTAINED})"


SQL["tfilter_rt"] = f"SELECT * FROM ({POINTS}) WHERE oid IN ({IDS})"
SQL["tfilter_window"] = _summary(_two_days(EVENTS), "window_start, oid")
SQL["trange_rt"] = SQL["trange_naive"] = f"{_contained(POINTS)} SELECT event_id, oid, ts_ms, x, y FROM inner_points"
SQL["trange_window"] = f"{_contained(EVENTS)}, w AS ({_two_days('SELECT event_id, oid, ts_ms, x, y, event_id IN (SELECT event_id FROM inner_points) AS hit FROM a')}) {_summary('SELECT * FROM w', 'window_start, oid', 'count(*) >= 2 AND bool_or(hit)')}"


def _counting(rows: str, keys: str) -> str:
    """The first row of each time, with its step."""
    firsts = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, ts_ms ORDER BY event_id) AS nth FROM ({rows})) WHERE nth = 1"
    return f"SELECT *, {_STEP} AS step FROM ({firsts}) WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ms)"


SQL["tstats_rt"] = f"""WITH s AS ({_counting(POINTS, 'oid')}),
t AS (SELECT oid, ts_ms, sum(step) OVER (PARTITION BY oid ORDER BY ts_ms) AS len, ts_ms - min(ts_ms) OVER (PARTITION BY oid) AS ms FROM s)
SELECT oid, ts_ms, round(len, 6) AS spatial_len, ms AS temporal_len_ms, round(len / ms * 1e6, 3) AS speed_micro FROM t WHERE ms > 0"""
SQL["tstats_window"] = f"""WITH s AS ({_counting(_two_days(POINTS), 'window_start, oid')})
SELECT window_start, oid, round(sum(step), 6) AS spatial_len, max(ts_ms) - min(ts_ms) AS temporal_len_ms, round(sum(step) / nullif(max(ts_ms) - min(ts_ms), 0) * 1e6, 3) AS speed_micro FROM s GROUP BY ALL"""

IN_GRID = f"{CX} BETWEEN 0 AND {N - 1} AND {CY} BETWEEN 0 AND {N - 1}"
CELLED = f"SELECT *, {CX} AS cx, {CY} AS cy FROM ({{}}) WHERE {IN_GRID}"


def heat(rows: str, by: str, fn: str, moved: str = "n >= 2") -> str:
    base = f"WITH l AS MATERIALIZED (SELECT {by}, oid, max(ts_ms) - min(ts_ms) AS ms, count(*) AS n, max(ts_ms) AS last_ms FROM ({rows}) GROUP BY {by}, oid)"
    if fn == "ALL":
        return f"{base} SELECT {by}, count(*) OVER (PARTITION BY {by}) AS n_traj, oid AS key, ms AS value FROM l"
    if fn in ("SUM", "AVG"):
        value = "CAST(sum(ms) AS BIGINT)" if fn == "SUM" else "CAST(floor(CAST(sum(ms) AS DOUBLE) / count(*) + 0.5) AS BIGINT)"
        return f"{base} SELECT {by}, count(*) AS n_traj, '' AS key, {value} AS value FROM l GROUP BY {by} HAVING sum(ms) > 0"
    order = f"ms {'ASC' if fn == 'MIN' else 'DESC'}, oid"
    return f"{base} SELECT {by}, n_traj, oid AS key, ms AS value FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_traj, row_number() OVER (PARTITION BY {by}, {moved} ORDER BY {order}) AS nth FROM l) WHERE {moved} AND nth = 1"


for _fn in ("ALL", "SUM", "AVG", "MIN", "MAX"):
    SQL[f"tagg_{_fn.lower()}_time"] = heat(_two_days(CELLED.format(POINTS)), "window_start, cx, cy", _fn)


def count_windows(rows: str) -> str:
    numbered = f"SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY ts_ms, event_id, oid) AS rn, count(*) OVER (PARTITION BY cx, cy) AS n_cell FROM ({CELLED.format(rows)})"
    ends = "(SELECT unnest(generate_series(1, (SELECT count(*) FROM moving_points) // 10)) AS e)"
    return heat(f"SELECT t.*, g.e * 10 AS last FROM ({numbered}) t JOIN {ends} g ON g.e BETWEEN (rn + 9) // 10 AND (rn + 19) // 10 WHERE g.e * 10 <= n_cell", "last, cx, cy", "SUM")


SQL["tagg_sum_count"] = count_windows(EVENTS)
_NOW = 1705276800000
SQL["tagg_max_rt"] = f"""WITH l AS (SELECT cx, cy, oid, max(ts_ms) - min(ts_ms) AS ms, max(ts_ms) AS last_ms FROM ({CELLED.format(POINTS)}) WHERE ts_ms <= {_NOW} GROUP BY ALL),
o AS (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n_traj, row_number() OVER (PARTITION BY cx, cy ORDER BY ms DESC, oid) AS nth FROM l WHERE last_ms >= {_NOW - 7 * q.DAY})
SELECT cx, cy, n_traj, oid AS key, ms AS value FROM o WHERE nth = 1"""


def _tknn(rows: str, r: float | None, size: int, slide: int, at_least: int = 1) -> str:
    px, py = (f"CAST({v} AS DOUBLE)" for v in q.PLACE)
    dist = f"sqrt((x - {px}) * (x - {px}) + (y - {py}) * (y - {py}))"
    near = "true"
    if r is not None:
        (qx, qy), k = BEIJING.index(*q.PLACE), BEIJING.candidate_layers(r)
        near = f"{IN_GRID} AND {CX} BETWEEN {qx - k} AND {qx + k} AND {CY} BETWEEN {qy - k} AND {qy + k} AND {dist} <= {r!r}"
    return f"""WITH w AS MATERIALIZED ({windows(rows, size, slide)}),
h AS (SELECT window_start, oid, {dist} AS dist, x, y, row_number() OVER (PARTITION BY window_start, oid ORDER BY {dist}, ts_ms, x, y) AS nth FROM w WHERE {near}),
c AS (SELECT window_start, oid FROM w GROUP BY ALL HAVING count(*) >= {at_least}),
o AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY window_start ORDER BY dist, oid) AS INT) AS rank FROM h JOIN c USING (window_start, oid) WHERE nth = 1), best AS (SELECT * FROM o WHERE rank <= {q.K})"""


_BEST = "SELECT window_start, rank, oid, round(dist, 6) AS dist, x, y FROM best"


def tknn(rows: str, r: float | None, size: int, slide: int) -> str:
    return f"{_tknn(rows, r, size, slide)} {_BEST}"


SQL["tknn_rt"] = f"{_tknn(POINTS, q.KNN_R, q.HOUR, q.HOUR)} {_BEST}"
SQL["tknn_naive"] = f"{_tknn(POINTS, None, q.DAY, q.DAY)} {_BEST}"
SQL["tknn_window"] = f"{_tknn(EVENTS, q.KNN_R, q.TWO_DAYS.size, q.TWO_DAYS.step, 2)} {_summary('SELECT w.*, rank FROM w JOIN best USING (window_start, oid)', 'window_start, rank, oid')}"

SQL["tknn_window_naive"] = f"{_tknn(EVENTS, None, q.TWO_DAYS.size, q.TWO_DAYS.step, 2)} {_summary('SELECT w.*, rank FROM w JOIN best USING (window_start, oid)', 'window_start, rank, oid')}"


def _met(left: str, right: str, r: float, size: int, apart: bool = False, grid: bool = True) -> str:
    """Rows (window_start, oid, qid, and both points) of all pairs of points."""
    return f"""{pairs('pt', 'pt', left, right, r, grid, windowed=size)},
met AS MATERIALIZED (SELECT window_start, a.oid, b.oid AS qid, {{'ts_ms': a.ts_ms, 'x': a.x, 'y': a.y}} AS p, {{'ts_ms': b.ts_ms, 'x': b.x, 'y': b.y}} AS q FROM p JOIN a ON a.rid = ra JOIN b ON b.rid = rb{' WHERE a.oid <> b.oid' if apart else ''})"""


_TJOIN = """, g AS (SELECT window_start, oid, qid, min(p) AS p, max(q) AS q FROM met GROUP BY ALL), f AS (SELECT window_start, oid, qid, min(p) OVER (PARTITION BY window_start, oid) AS p, q FROM g)
SELECT window_start, oid, qid, p.ts_ms AS ts_ms, p.x AS x, p.y AS y, q.ts_ms AS q_ts_ms, q.x AS q_x, q.y AS q_y FROM f"""
#: As streams give it: every pair with the first point of its own.
SQL_TJOIN_PAIRS = f"{_met(POINTS, PINGS, q.JOIN_R, q.DAY)}{_TJOIN.split(', f AS')[0]} SELECT window_start, oid, qid, p.ts_ms AS ts_ms, p.x AS x, p.y AS y, q.ts_ms AS q_ts_ms, q.x AS q_x, q.y AS q_y FROM g"
SQL_TRANGE_DAY = f"""{_contained(POINTS)}, w AS ({windows('SELECT event_id, oid, ts_ms, x, y, (event_id, ts_ms, x, y) IN (SELECT (event_id, ts_ms, x, y) FROM inner_points) AS hit FROM a', q.DAY, q.DAY)})
SELECT window_start, oid, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2 AND bool_or(hit)"""
SQL["tjoin_rt"] = f"{_met(POINTS, PINGS, q.JOIN_R, q.DAY)}{_TJOIN}"
SQL["tjoin_naive"] = f"{_met(POINTS, PINGS, q.JOIN_R, q.DAY, grid=False)}{_TJOIN}"
SQL["tjoin_self"] = f"{_met(EVENTS, EVENTS, q.NEAR, q.HOUR, True)}{_TJOIN}"
_DAYS = lambda sql: _summary(windows(sql, q.DAY, q.DAY), "window_start, oid")
SQL["tjoin_window"] = f"""{_met(EVENTS, PINGS, q.JOIN_R, q.DAY)}, l AS ({_DAYS(EVENTS)}), r AS ({_DAYS(PINGS)})
SELECT m.window_start, m.oid, m.qid, l.n, l.length, r.n AS q_n, r.length AS q_length FROM (SELECT DISTINCT window_start, oid, qid FROM met) m
JOIN l ON l.window_start = m.window_start AND l.oid = m.oid JOIN r ON r.window_start = m.window_start AND r.oid = m.qid"""


def _bounds(cx: str, cy: str) -> tuple[str, str, str, str]:
    x, y, c = f"(CAST({MIN_X} AS DOUBLE) + {cx} * CAST({CELL} AS DOUBLE))", f"(CAST({MIN_Y} AS DOUBLE) + {cy} * CAST({CELL} AS DOUBLE))", f"CAST({CELL} AS DOUBLE)"
    return x, y, f"({x} + {c})", f"({y} + {c})"


def meets(ax: str, ay: str, bx: str, by: str, box: tuple[str, str, str, str]) -> str:
    """Segment and rectangle: the part of the segment inside both slabs isn't empty."""
    lo, hi, fine = ["0.0::DOUBLE"], ["1.0::DOUBLE"], []
    for a, b, low, high in ((ax, bx, box[0], box[2]), (ay, by, box[1], box[3])):
        t0, t1 = f"(({low} - {a}) / nullif({b} - {a}, 0))", f"(({high} - {a}) / nullif({b} - {a}, 0))"
        lo.append(f"least({t0}, {t1})")
        hi.append(f"greatest({t0}, {t1})")
        fine.append(f"({b} <> {a} OR ({a} >= {low} AND {a} <= {high}))")
    return f"({' AND '.join(fine)} AND greatest({', '.join(lo)}) <= least({', '.join(hi)}))"


_STAY = f"""WITH w AS ({windows(CELLED.format(EVENTS), q.DAY, q.DAY)}),
n AS (SELECT *, lead(ts_ms) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(cx) OVER w AS cx2, lead(cy) OVER w AS cy2 FROM w WINDOW w AS (PARTITION BY window_start, oid ORDER BY ts_ms, event_id)),
e AS (SELECT row_number() OVER () AS rid, * FROM n WHERE t2 IS NOT NULL),
c AS (SELECT e.*, i, j FROM e, unnest(generate_series(least(cx, cx2), greatest(cx, cx2))) a(i), unnest(generate_series(least(cy, cy2), greatest(cy, cy2))) b(j)),
k AS (SELECT *, count(*) OVER (PARTITION BY rid) AS parts FROM c WHERE cx = cx2 OR cy = cy2 OR (i = cx AND j = cy) OR (i = cx2 AND j = cy2) OR {meets('x', 'y', 'x2', 'y2', _bounds('i', 'j'))}),
stay AS (SELECT window_start, CAST(i AS INT) AS cx, CAST(j AS INT) AS cy, sum((t2 - t2 + t2 - ts_ms) / parts) AS stay_ms FROM k GROUP BY ALL)"""
_STAY = _STAY.replace("(t2 - t2 + t2 - ts_ms) / parts", "CAST(t2 - ts_ms AS DOUBLE) / parts")
_SENSOR = f"""z AS MATERIALIZED ({shaped(ZONE_STREAM, 'pg')}), zc AS (SELECT z.*, i, j FROM z, unnest(generate_series(greatest(cminx, 0), least(cmaxx, {N - 1}))) a(i), unnest(generate_series(greatest(cminy, 0), least(cmaxy, {N - 1}))) b(j)),
sensor AS (SELECT ts_ms - ts_ms % {q.DAY} AS window_start, CAST(i AS INT) AS cx, CAST(j AS INT) AS cy, count(DISTINCT ts_ms) AS n_ts FROM zc
WHERE list_bool_or(list_transform(segs, lambda s: {meets('s.ax', 's.ay', 's.bx', 's.by', _bounds('i', 'j'))})) OR {inside(*_bounds('i', 'j')[:2], 'segs')} GROUP BY ALL)"""
SQL["stay_cell"] = f"{_STAY} SELECT window_start, cx, cy, round(stay_ms, 4) AS stay_ms FROM stay"
SQL["stay_sensor"] = f"WITH {_SENSOR} SELECT * FROM sensor"
SQL["stay_normalized"] = f"{_STAY}, {_SENSOR} SELECT window_start, cx, cy, round(stay_ms / 1000 / n_ts * {q.DAY // 1000}, 4) AS value FROM stay JOIN sensor USING (window_start, cx, cy)"

_CAPACITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in q.CAPACITIES.items())
_COMPLETE = """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, 'room' || CAST(user_id % 5 AS VARCHAR) AS room, CASE WHEN (event_id * 31) % 3 = 0 THEN 'out' ELSE 'in' END AS way FROM events),
l AS (SELECT *, lag(room || way) OVER w AS before, lag(ts_ms) OVER w AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
f AS (SELECT event_id, user_id, room, way, ts_ms, false AS inserted FROM l UNION ALL
  SELECT event_id, user_id, room, CASE way WHEN 'in' THEN 'out' ELSE 'in' END, (t0 + ts_ms) // 2, true FROM l WHERE before = room || way AND t0 < ts_ms)"""
SQL_MISSED = f"{_COMPLETE} SELECT event_id, user_id, inserted, ts_ms, room || '-' || way AS device_id FROM f"
SQL["checkin"] = f"""{_COMPLETE}
SELECT room, CAST(CASE room {_CAPACITY} END AS INT) AS capacity, CAST(sum(CASE way WHEN 'in' THEN 1 ELSE -1 END) OVER (PARTITION BY room ORDER BY ts_ms, event_id, NOT inserted ROWS UNBOUNDED PRECEDING) AS BIGINT) AS occupancy, ts_ms, event_id, inserted FROM f"""
_HEAT_COUNT = f"SELECT cx, cy, count(*) AS n FROM ({CELLED.format(POINTS)}) GROUP BY ALL"
SQL["heat_count"] = _HEAT_COUNT
SQL["extreme_points"] = "WITH p AS (%s), m AS (SELECT oid, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p GROUP BY oid) SELECT m.*, %s FROM m JOIN p USING (oid) GROUP BY ALL" % (
    POINTS,
    ", ".join(f"max(ts_ms) FILTER (WHERE p.{n[-1]} = m.{n}) AS {n}_ms" for n in ("min_x", "max_x", "min_y", "max_y")),
)
_B = _bounds("cx", "cy")
SQL["cell_bounds"] = f"SELECT printf('%05d%05d', cx, cy) AS cell, round({_B[0]}, 6) AS min_x, round({_B[1]}, 6) AS min_y, round({_B[2]}, 6) AS max_x, round({_B[3]}, 6) AS max_y FROM ({_HEAT_COUNT})"
_QX, _QY = BEIJING.index(*q.PLACE)
SQL["grid_layers"] = f"""WITH s AS (SELECT site_id, {CX} AS cx, {CY} AS cy FROM ({SITES})), l AS (SELECT *, greatest(abs(cx - {_QX}), abs(cy - {_QY})) AS layer FROM s)
SELECT site_id, printf('%05d%05d', cx, cy) AS cell, layer, layer <= {BEIJING.candidate_layers(0.1)} AS candidate, layer <= {BEIJING.guaranteed_layers(0.1)} AS guaranteed FROM l"""
