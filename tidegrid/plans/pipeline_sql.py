"""SQL of the data-pipeline queries that SQL can express over whole tables."""

from __future__ import annotations

from tidegrid.plans.pipeline_queries import SITE_RADIUS
from tidegrid.plans.spatial_sql import CX, CY, USABLE

OID = "nullif(lower(trim(replace(oid, '\"', ''))), '')"
GRID_ID = "CASE WHEN trim(grid_id) = '' THEN NULL WHEN length(trim(grid_id)) >= 10 THEN trim(grid_id) ELSE lpad(trim(grid_id), 10, '0') END"

#: Each event's earliest copy, with the end of its hour.
EVENTS = " UNION ALL ".join(
    f"SELECT '{t}' AS stream_name, event_id, min({OID}) AS oid, min(ts_ms) AS ts_ms, min(epoch_us(ingest_ts)) AS arrived_us, min(ts_ms) // 3600000 * 3600000 AS period_start_ms FROM {t} "
    f"WHERE event_id IS NOT NULL AND ts_ms >= {USABLE} AND ingest_ts IS NOT NULL GROUP BY event_id"
    for t in ("moving_points", "zone_stream")
)
#: Milliseconds of arrival after the hour's end, as a double.
LATE = "((arrived_us - period_start_ms * 1000) / 1000.0 - 3600000)"

KINDS = f"(SELECT 'oid' AS key_kind, {OID} AS key_value, * FROM moving_points UNION ALL SELECT 'grid_id', {GRID_ID}, * FROM moving_points)"

_FIELD = ' *"(?:[^"]|"")*" *|[^"\x01]*'
_AT = lambda i: f"fields[attrs[{i + 1}] + 1]"
_NUMBER = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
#: Lines cut at their stream's delimiter, which a sign that no line has stands for, and what is wrong with them.
LINES = f"""(WITH raw AS (SELECT l.line_id, l.stream_id, c.n_fields, c.csv_tsv_schema_attr AS attrs, c.date_format = 'null' AS epoch,
  replace(regexp_replace(coalesce(raw_line, ''), '\\r\\z', ''), CASE input_delimiter WHEN '\\t' THEN chr(9) WHEN '\\\\t' THEN '\\t' ELSE input_delimiter END, chr(1)) AS line
  FROM stream_lines l JOIN stream_conf c USING (stream_id)),
cut AS (SELECT *, regexp_full_match(line, '(?s)(?:{_FIELD})(?:\x01(?:{_FIELD}))*') AS fine, regexp_extract_all(line || chr(1), '(?s)(?:{_FIELD})\x01') AS parts FROM raw),
f AS (SELECT *, list_transform(parts, lambda p: CASE WHEN trim(replace(p, chr(1), ''), ' ') LIKE '"%' THEN replace(trim(p[:-2], ' ')[2:-2], '""', '"') ELSE trim(p[:-2], ' ') END) AS fields FROM cut),
v AS (SELECT line_id, stream_id, fine, len(parts) = n_fields AS whole, epoch, {_AT(0)} AS oid, {_AT(1)} AS t, {_AT(2)} AS x, {_AT(3)} AS y FROM f),
r AS (SELECT *, CASE WHEN epoch THEN CASE WHEN regexp_full_match(t, '[0-9]{{13}}') AND CAST(t AS BIGINT) >= 946684800000 AND CAST(t AS BIGINT) < 4102444800000 THEN CAST(t AS BIGINT) END
  WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN epoch_ms(try_strptime(t, '%Y-%m-%d %H:%M:%S')) END AS ts_ms,
  CASE WHEN regexp_full_match(x, '{_NUMBER}') THEN CAST(x AS DOUBLE) END AS nx, CASE WHEN regexp_full_match(y, '{_NUMBER}') THEN CAST(y AS DOUBLE) END AS ny FROM v)
SELECT line_id, stream_id, oid, ts_ms, nx AS x, ny AS y, CASE WHEN NOT fine THEN 'quoting' WHEN NOT whole THEN 'column_count' WHEN regexp_full_match(oid, '[\\s\\p{{Z}}]*') THEN 'oid'
  WHEN ts_ms IS NULL THEN 'timestamp' WHEN NOT coalesce(abs(nx) <= 180 AND abs(ny) <= 90, false) THEN 'coordinate' END AS fail_reason FROM r)"""


def _inner(v: str) -> str:
    """A JSON value, or the one whose text a string holds."""
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({v}, '$')) THEN CAST(json_extract_string({v}, '$') AS JSON) END ELSE {v} END"


def _listed(v: str) -> str:
    """The elements of an array; an object is a list of one."""
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) WHEN 'OBJECT' THEN [{v}] ELSE [] END"


def _elements(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [] END"


_EACH = "unnest(generate_series(1, len({}))) u(i)"
_MULTI = "('MultiPoint', 'MultiLineString', 'MultiPolygon')"
_KIND = "CASE json_type(g, '$.type') WHEN 'VARCHAR' THEN json_extract_string(g, '$.type') END"
#: Objects of the records, level by level; geometries go as deep as they are nested.
_LEVELS = f"""WITH RECURSIVE e AS (SELECT record_id, json_extract(CASE WHEN json_valid(record_json) THEN record_json END, '$.value') AS v0 FROM geojson_records),
v AS (SELECT record_id, v FROM (SELECT record_id, {_inner('v0')} AS v FROM e) WHERE json_type(v) = 'OBJECT'),
s AS (SELECT record_id, coalesce(json_extract_string(v, '$.type') = 'FeatureCollection' AND json_type(v, '$.type') = 'VARCHAR', false) AS several, v FROM v),
fs AS (SELECT record_id, CASE WHEN several THEN {_elements("json_extract(v, '$.features')")} ELSE [v] END AS fs, several FROM s),
f AS (SELECT * FROM (SELECT record_id, CAST(i - 1 AS VARCHAR) AS path, fs[i] AS f, NOT several AND coalesce(json_extract_string(fs[i], '$.type') <> 'Feature' OR json_type(fs[i], '$.type') <> 'VARCHAR', true) AS bare FROM fs, {_EACH.format('fs')}) WHERE json_type(f) = 'OBJECT'),
g AS (SELECT record_id, path || '.g' AS path, path AS parent, g FROM (SELECT record_id, path, CASE WHEN bare THEN f ELSE {_inner("json_extract(f, '$.geometry')")} END AS g FROM f) WHERE json_type(g) = 'OBJECT'
  UNION ALL SELECT record_id, path, parent, g FROM (
    SELECT record_id, path || '.' || (i - 1) AS path, path AS parent, {_inner('m[i]')} AS g FROM (SELECT record_id, path, {_elements("json_extract(g, '$.geometries')")} AS m FROM g), {_EACH.format('m')}
    UNION ALL SELECT record_id, path || '.' || (i - 1), path, json_object('type', substr(k, 6), 'coordinates', c[i]) FROM (SELECT record_id, path, {_KIND} AS k, {_elements("json_extract(g, '$.coordinates')")} AS c FROM g), {_EACH.format('c')} WHERE k IN {_MULTI} AND json_type(c[i]) <> 'NULL'
  ) WHERE json_type(g) = 'OBJECT'),
r AS (SELECT record_id, path || '.r' || (i - 1) AS path, path AS parent FROM (SELECT record_id, path, {_KIND} AS k, {_elements("json_extract(g, '$.coordinates')")} AS c FROM g), {_EACH.format('c')} WHERE k = 'Polygon' AND json_type(c[i]) <> 'NULL'),
l AS (SELECT record_id, path || '.l' || (i - 1) AS path, path AS parent, ls[i] AS l FROM (SELECT record_id, path, {_listed("json_extract(p, '$.legs')")} AS ls FROM (SELECT record_id, path, {_inner("json_extract(f, '$.properties')")} AS p FROM f WHERE NOT bare) WHERE json_type(p) = 'OBJECT'), {_EACH.format('ls')} WHERE json_type(ls[i]) = 'OBJECT'),
c AS (SELECT record_id, path || '.c' || (i - 1) AS path, path AS parent, cs[i] AS c FROM (SELECT record_id, path, {_listed("json_extract(l, '$.calls')")} AS cs FROM l), {_EACH.format('cs')} WHERE json_type(cs[i]) = 'OBJECT')
{{}}"""
_PATHS = """SELECT record_id, 'feature' AS entity, path AS node_path, '' AS parent_path FROM f UNION ALL SELECT record_id, 'geometry', path, parent FROM g UNION ALL SELECT record_id, 'ring', path, parent FROM r
UNION ALL SELECT record_id, 'leg', path, parent FROM l UNION ALL SELECT record_id, 'call', path, parent FROM c"""
NODES = _LEVELS.format(_PATHS)
_VALUE = lambda v, path: f"CASE WHEN json_type({v}, '{path}') <> 'NULL' THEN json_extract_string({v}, '{path}') END"


def inside_ring(ring: str) -> tuple[str, str]:
    """Whether a point (p.x, p.y) is inside a list of vertices, and whether on its border."""
    side = "{{'ax': {r}[i].x, 'ay': {r}[i].y, 'bx': {r}[i % len({r}) + 1].x, 'by': {r}[i % len({r}) + 1].y}}".format(r=ring)
    sides = f"list_transform(generate_series(1, len({ring})), lambda i: {side})"
    crosses = "(s.ay > p.y) <> (s.by > p.y) AND p.x < coalesce((s.bx - s.ax) * (p.y - s.ay) / nullif(s.by - s.ay, 0), 0.0::DOUBLE) + s.ax"
    t = "coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.by - s.ay)) / nullif((s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay), 0))), 0.0::DOUBLE)"
    dx, dy = f"(p.x - s.ax - {t} * (s.bx - s.ax))", f"(p.y - s.ay - {t} * (s.by - s.ay))"
    edge = f"list_bool_or(list_transform({sides}, lambda s: sqrt({dx} * {dx} + {dy} * {dy}) <= 1e-12))"
    return f"(len(list_filter({sides}, lambda s: {crosses})) % 2 = 1)", edge


_OUTER, _OUTER_EDGE = inside_ring("z.rings[1]")
_HOLE, _HOLE_EDGE = inside_ring("h")

SQL: dict[str, str] = {
    "p1_found": NODES,
    "p1_call_counts": _LEVELS.format(f"SELECT {_VALUE('c', '$.site')} AS site, {_VALUE('c', '$.arr')} AS arr, TRY_CAST({_VALUE('c', '$.load.in')} AS BIGINT) AS load_in, TRY_CAST({_VALUE('c', '$.load.out')} AS BIGINT) AS load_out, count(*) AS n FROM c GROUP BY ALL"),
    "p1_leg_counts": _LEVELS.format(f"SELECT {_VALUE('l', '$.leg')} AS leg, {_VALUE('l', '$.mode')} AS mode, count(*) AS n FROM l GROUP BY ALL"),
    "p2_found": f"""SELECT stream_name, event_id, period_start_ms, CASE WHEN {LATE} <= 21600000 THEN 'corrects' ELSE 'dropped' END AS outcome
FROM ({EVENTS}) WHERE {LATE} > 120000""",
    "p2_counts": f"""WITH e AS (SELECT *, CASE WHEN {LATE} <= 120000 THEN 0 ELSE ceil(({LATE} - 120000) / 3600000) END AS run FROM ({EVENTS}) WHERE oid IS NOT NULL)
SELECT stream_name, oid, period_start_ms, count(*) FILTER (WHERE {LATE} <= 120000) AS n_provisional, count(*) FILTER (WHERE {LATE} <= 21600000) AS n,
count(*) FILTER (WHERE {LATE} > 21600000) AS n_dropped, count(DISTINCT run) FILTER (WHERE {LATE} > 120000 AND {LATE} <= 21600000) AS n_revisions FROM e GROUP BY ALL""",
    "p3_found": f"SELECT line_id, fail_reason FROM {LINES} WHERE fail_reason IS NOT NULL",
    "p3_loaded": f"SELECT line_id, stream_id, oid, ts_ms, x, y FROM {LINES} WHERE fail_reason IS NULL",
    "p3_records": f"SELECT l.stream_id, coalesce(raw_line, '') AS raw_line FROM stream_lines l JOIN {LINES} r USING (line_id) WHERE fail_reason IS DISTINCT FROM 'quoting'",
    "p4_found": f"""WITH k AS (SELECT key_kind, key_value, count(*) AS n FROM {KINDS} WHERE key_value IS NOT NULL GROUP BY ALL)
SELECT key_kind, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY key_kind) AS n_kind FROM k) WHERE n * 20 >= n_kind""",
    "p4_stats": f"""SELECT key_kind, key_value, count(*) AS n, count(*) FILTER (WHERE ts_ms >= {USABLE}) AS n_timed, min(ts_ms) FILTER (WHERE ts_ms >= {USABLE}) AS first_ms,
max(ts_ms) FILTER (WHERE ts_ms >= {USABLE}) AS last_ms, count(*) FILTER (WHERE isfinite(x) AND isfinite(y)) AS n_placed,
CAST(sum(CAST(round(x * 1000000) AS BIGINT)) FILTER (WHERE isfinite(x) AND isfinite(y)) AS BIGINT) AS sum_x_micro, CAST(sum(CAST(round(y * 1000000) AS BIGINT)) FILTER (WHERE isfinite(x) AND isfinite(y)) AS BIGINT) AS sum_y_micro
FROM (SELECT * REPLACE (CASE WHEN isfinite(x) AND isfinite(y) THEN x END AS x, CASE WHEN isfinite(x) AND isfinite(y) THEN y END AS y) FROM {KINDS}) WHERE key_value IS NOT NULL GROUP BY ALL""",
    "p4_joined": f"""WITH p AS (SELECT {GRID_ID} AS cell, CASE WHEN ts_ms >= {USABLE} THEN ts_ms // 1000 END AS s FROM moving_points),
c AS (SELECT printf('%05d%05d', {CX}, {CY}) AS cell, site_id FROM sites WHERE isfinite(x) AND isfinite(y))
SELECT cell, count(*) AS n_pairs, CAST(sum(s) AS BIGINT) AS sum_ts_s, CAST(sum(site_id) AS BIGINT) AS sum_site_id FROM p JOIN c USING (cell) GROUP BY cell""",
    "p6_found": f"""WITH p AS MATERIALIZED (SELECT DISTINCT event_id, x, y FROM moving_points WHERE event_id IS NOT NULL AND isfinite(x) AND isfinite(y)),
z AS (SELECT zone_id, rings, list_min(list_transform(rings[1], lambda v: v.x)) AS x0, list_max(list_transform(rings[1], lambda v: v.x)) AS x1, list_min(list_transform(rings[1], lambda v: v.y)) AS y0, list_max(list_transform(rings[1], lambda v: v.y)) AS y1
  FROM zones WHERE len(list_distinct(rings[1])) >= 3),
near AS MATERIALIZED (SELECT p.event_id, p.x, p.y, z.zone_id, z.rings FROM p JOIN z ON p.x BETWEEN x0 - 1e-9 AND x1 + 1e-9 AND p.y BETWEEN y0 - 1e-9 AND y1 + 1e-9)
SELECT DISTINCT 'near_site' AS rel_kind, s.site_id AS target_id, p.event_id FROM p JOIN sites s ON abs(p.x - s.x) <= 0.0031 AND abs(p.y - s.y) <= 0.0031 AND sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= {SITE_RADIUS!r}
UNION ALL SELECT DISTINCT 'in_zone', zone_id, event_id FROM (SELECT event_id, x, y, zone_id, rings FROM near) p, (SELECT 1) WHERE ({_OUTER.replace('z.rings', 'p.rings')} OR {_OUTER_EDGE.replace('z.rings', 'p.rings')})
AND NOT coalesce(list_bool_or(list_transform(p.rings[2:], lambda h: {_HOLE} AND NOT {_HOLE_EDGE})), false)""",
}
SQL["p6_site_pairs"] = "SELECT a.site_id, b.site_id AS near_id FROM sites a JOIN sites b ON a.site_id < b.site_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01"
