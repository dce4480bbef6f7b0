"""Queries that write shapes as text and read them back, and their SQL: what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans import spatial_queries as q
from tidegrid.plans import spatial_sql as s
from tidegrid.plans.tables import table
from tidegrid.sinks import encode
from tidegrid.sources import decode

ATTRS = [1, 4, 5, 6]


def _points(df: DataFrame) -> DataFrame:
    return df.select("event_id", "oid", "ts_ms", "x", "y")


def _bare(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c in ("event_id", "zone_id", "value")))


def io_csv_points(spark: SparkSession, d: str) -> DataFrame:
    lines = _bare(encode.encode_csv(q.points(spark, d), ATTRS, ";"))
    return _points(decode.decode_csv(lines, ATTRS, delimiter=";"))


def io_tsv_points(spark: SparkSession, d: str) -> DataFrame:
    lines = _bare(encode.encode_csv(q.points(spark, d), ATTRS, r"\t", "yyyy-MM-dd HH:mm:ss.SSS"))
    return _points(decode.decode_csv(lines, ATTRS, delimiter=r"\t", date_format="yyyy-MM-dd HH:mm:ss.SSS"))


def io_geojson_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(decode.decode_geojson(_bare(encode.encode_geojson(q.points(spark, d), "pt", None)), "pt", date_format=None))


def io_wkt_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(decode.decode_wkt(_bare(encode.encode_wkt(q.points(spark, d), "pt")), "pt"))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return q.zones(spark, d).where(F.size("rings") > 0).withColumn("parts", F.array("rings"))


def _rings(df: DataFrame) -> DataFrame:
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return df.select("zone_id", "oid", "ts_ms", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_vertices"), first["x"].alias("x"), first["y"].alias("y"))


def io_geojson_polygons(spark: SparkSession, d: str) -> DataFrame:
    return _rings(decode.decode_geojson(_bare(encode.encode_geojson(_zones(spark, d), "pg", None)), "pg", date_format=None))


def io_wkt_polygons(spark: SparkSession, d: str) -> DataFrame:
    return _rings(decode.decode_wkt(_bare(encode.encode_wkt(_zones(spark, d), "pg")), "pg"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return q.lines("customer")(spark, d).withColumn("paths", F.array("path"))


def _vertices(df: DataFrame) -> DataFrame:
    p = F.flatten("paths")
    return df.select("oid", "ts_ms", *(F.get(p, F.lit(i))[c].alias(f"{c}{i}") for i in range(3) for c in "xy"))


def io_geojson_lines(spark: SparkSession, d: str) -> DataFrame:
    return _vertices(decode.decode_geojson(_bare(encode.encode_geojson(_lines(spark, d), "ls", None)), "ls", date_format=None))


def io_wkt_lines(spark: SparkSession, d: str) -> DataFrame:
    return _vertices(decode.decode_wkt(_bare(encode.encode_wkt(_lines(spark, d), "ls", "|")), "ls", delimiter="|"))


def _text(encoded: DataFrame) -> DataFrame:
    return encoded.select("event_id", "value")


def io_geojson_text(spark: SparkSession, d: str) -> DataFrame:
    """The records themselves, as a consumer gets them."""
    return _text(encode.encode_geojson(q.points(spark, d), "pt"))


def io_wkt_text(spark: SparkSession, d: str) -> DataFrame:
    return _text(encode.encode_wkt(q.points(spark, d), "pt"))


def io_csv_text(spark: SparkSession, d: str) -> DataFrame:
    return _text(encode.encode_csv(q.points(spark, d), ATTRS, ";", "yyyy-MM-dd HH:mm:ss"))


def _moved(spark: SparkSession, d: str) -> DataFrame:
    """Each zone twice, the second time a degree to the east, as one shape of two parts."""
    east = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))
    return _zones(spark, d).withColumn("parts", F.array("rings", east))


def _both(df: DataFrame) -> DataFrame:
    at = lambda i: F.get(F.get(F.get("parts", F.lit(i)), F.lit(0)), F.lit(0))
    return df.select("zone_id", "oid", "ts_ms", F.size("parts").alias("n_parts"), F.size("rings").alias("n_rings"), at(0)["x"].alias("x0"), F.round(at(1)["x"], 6).alias("x1"), at(1)["y"].alias("y1"))


def io_geojson_multipolygons(spark: SparkSession, d: str) -> DataFrame:
    return _both(decode.decode_geojson(_bare(encode.encode_geojson(_moved(spark, d), "pg", None)), "pg", date_format=None))


def io_wkt_multipolygons(spark: SparkSession, d: str) -> DataFrame:
    return _both(decode.decode_wkt(_bare(encode.encode_wkt(_moved(spark, d), "pg")), "pg"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's line and the same again, as one line of two parts."""
    return q.lines("customer")(spark, d).withColumn("paths", F.array("path", F.reverse("path")))


def _ends(df: DataFrame) -> DataFrame:
    at = lambda i, k: F.get(F.get("paths", F.lit(i)), F.lit(k))
    return df.select("oid", "ts_ms", F.size("paths").alias("n_parts"), at(0, 0)["x"].alias("x0"), at(1, 0)["x"].alias("x1"), at(1, 2)["y"].alias("y1"))


def io_geojson_multilines(spark: SparkSession, d: str) -> DataFrame:
    return _ends(decode.decode_geojson(_bare(encode.encode_geojson(_pairs(spark, d), "ls", None)), "ls", date_format=None))


def io_wkt_multilines(spark: SparkSession, d: str) -> DataFrame:
    return _ends(decode.decode_wkt(_bare(encode.encode_wkt(_pairs(spark, d), "ls", "|")), "ls", delimiter="|"))


def _corners(spark: SparkSession, d: str) -> DataFrame:
    """Each zone's outer vertices as a multi-point."""
    return _zones(spark, d).withColumn("points", F.get("rings", F.lit(0)))


def _vertex(df: DataFrame) -> DataFrame:
    last = F.element_at("points", -1)
    return df.select("zone_id", "oid", "ts_ms", F.size("points").alias("n_points"), last["x"].alias("x"), last["y"].alias("y"))


def io_geojson_multipoints(spark: SparkSession, d: str) -> DataFrame:
    return _vertex(decode.decode_geojson(_bare(encode.encode_geojson(_corners(spark, d), "mp", None)), "mp", date_format=None))


def io_wkt_multipoints(spark: SparkSession, d: str) -> DataFrame:
    return _vertex(decode.decode_wkt(_bare(encode.encode_wkt(_corners(spark, d), "mp")), "mp"))


def _collections(spark: SparkSession, d: str) -> DataFrame:
    """Each zone as a collection of itself, its vertices and its first one."""
    own = lambda df, kind: F.struct(F.lit({"pg": "Polygon", "mp": "MultiPoint", "pt": "Point"}[kind]).alias("kind"), encode.geometry_json(kind).alias("geojson"))
    zones = _corners(spark, d).withColumns({"x": F.get("points", F.lit(0))["x"], "y": F.get("points", F.lit(0))["y"]})
    return zones.withColumn("members", F.array(*(own(zones, k) for k in ("pg", "mp", "pt"))))


def _inside(df: DataFrame) -> DataFrame:
    at = lambda i: F.get("members", F.lit(i))
    point = F.from_json(F.get_json_object(at(2)["geojson"], "$.coordinates"), "array<double>")
    return df.select("zone_id", "oid", "ts_ms", F.concat_ws(" ", F.transform("members", lambda m: m["kind"])).alias("kinds"), F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))


def io_geojson_collections(spark: SparkSession, d: str) -> DataFrame:
    return _inside(decode.decode_geojson(_bare(encode.encode_geojson(_collections(spark, d), "gc", None)), "gc", date_format=None))


def io_wkt_collections(spark: SparkSession, d: str) -> DataFrame:
    return _inside(decode.decode_wkt(_bare(encode.encode_wkt(_collections(spark, d), "gc", "|")), "gc", delimiter="|"))


def io_geojson_collection_records(spark: SparkSession, d: str) -> DataFrame:
    """Members of the envelope records' collections, those of collections in them in their place."""
    rows = decode.decode_geojson(decode.features(table(spark, d, "geojson_records"), "record_json"), "gc", "record_json")
    return rows.select("record_id", "position", "oid", F.posexplode("members").alias("member", "m")).select("record_id", "position", "oid", "member", "m.kind")


def io_geojson_records(spark: SparkSession, d: str) -> DataFrame:
    """Points of the envelope records: bare, as features, and in collections of features."""
    rows = decode.decode_geojson(decode.features(table(spark, d, "geojson_records"), "record_json"), "pt", "record_json")
    return rows.where(F.col("x").isNotNull()).select("record_id", "position", "oid", "ts_ms", "x", "y")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("io_")}

_ZONES = f"SELECT zone_id, oid, CASE WHEN ts_ms >= {s.USABLE} THEN ts_ms END AS ts_ms, len(rings) AS n_rings, len(flatten(rings)) AS n_vertices, rings[1][1].x AS x, rings[1][1].y AS y FROM zones WHERE len(rings) > 0"
_LINES = f"SELECT oid, ts_ms, {', '.join(f'path[{i + 1}].{c} AS {c}{i}' for i in range(3) for c in 'xy')} FROM ({s.STREAMS['ls']})"
SQL = {f"io_{form}_points": s.POINTS for form in ("csv", "tsv", "geojson", "wkt")} | {f"io_{form}_polygons": _ZONES for form in ("geojson", "wkt")} | {f"io_{form}_lines": _LINES for form in ("geojson", "wkt")}
_RECORDS = """(WITH e AS (SELECT record_id, json_extract(CASE WHEN json_valid(record_json) THEN record_json END, '$.value') AS v FROM geojson_records),
l AS (SELECT record_id, CASE WHEN json_extract_string(v, '$.type') = 'FeatureCollection' THEN CASE json_type(v, '$.features') WHEN 'ARRAY' THEN CAST(json_extract(v, '$.features') AS JSON[]) ELSE [] END ELSE [v] END AS vs FROM e),
r AS (SELECT record_id, CAST(i - 1 AS INT) AS position, vs[i] AS v FROM l, unnest(generate_series(1, len(vs))) u(i)),
g AS (SELECT record_id, position, v, CASE json_type(v, '$.geometry') WHEN 'OBJECT' THEN json_extract(v, '$.geometry') WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$.geometry')) THEN CAST(json_extract_string(v, '$.geometry') AS JSON) END ELSE v END AS g, json_extract(v, '$.properties') AS p FROM r WHERE json_type(v) = 'OBJECT')
SELECT *, CASE json_type(p) WHEN 'OBJECT' THEN p WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p, '$')) THEN CAST(json_extract_string(p, '$') AS JSON) END END AS o FROM g)"""
_META = """nullif(trim(replace(json_extract_string(o, '$.oID'), '"', '')), '') AS oid,
coalesce(epoch_ms(try_strptime(json_extract_string(o, '$.timestamp'), '%Y-%m-%d %H:%M:%S')), CASE WHEN regexp_full_match(json_extract_string(o, '$.timestamp'), '-?[0-9]{1,18}') THEN CAST(json_extract_string(o, '$.timestamp') AS BIGINT) END) AS ts_ms"""
SQL["io_geojson_records"] = f"SELECT record_id, position, {_META}, CAST(json_extract(g, '$.coordinates[0]') AS DOUBLE) AS x, CAST(json_extract(g, '$.coordinates[1]') AS DOUBLE) AS y FROM {_RECORDS} WHERE json_extract_string(g, '$.type') = 'Point' AND json_type(g, '$.coordinates[0]') IN ('DOUBLE', 'UBIGINT', 'BIGINT')"
_VALUE = {
    "geojson": """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"oID":"' || oid || '","timestamp":"' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || '"}}'""",
    "wkt": "oid || ', POINT(' || x || ' ' || y || '), ' || ts_ms", "csv": "'0;' || oid || ';0;0;' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || ';' || x || ';' || y",
}
SQL |= {f"io_{form}_text": f"SELECT event_id, {value} AS value FROM ({s.POINTS})" for form, value in _VALUE.items()}
_OWN = f"SELECT zone_id, oid, CASE WHEN ts_ms >= {s.USABLE} THEN ts_ms END AS ts_ms, rings FROM zones WHERE len(rings) > 0"
for _form in ("geojson", "wkt"):
    SQL[f"io_{_form}_multipolygons"] = f"SELECT zone_id, oid, ts_ms, 2 AS n_parts, CAST(2 * len(rings) AS INT) AS n_rings, rings[1][1].x AS x0, round(rings[1][1].x + 1, 6) AS x1, rings[1][1].y AS y1 FROM ({_OWN})"
    SQL[f"io_{_form}_multilines"] = f"SELECT oid, ts_ms, 2 AS n_parts, path[1].x AS x0, path[3].x AS x1, path[1].y AS y1 FROM ({s.STREAMS['ls']})"
    SQL[f"io_{_form}_multipoints"] = f"SELECT zone_id, oid, ts_ms, CAST(len(rings[1]) AS INT) AS n_points, rings[1][-1].x AS x, rings[1][-1].y AS y FROM ({_OWN})"
    SQL[f"io_{_form}_collections"] = f"SELECT zone_id, oid, ts_ms, 'Polygon MultiPoint Point' AS kinds, rings[1][1].x AS x, rings[1][1].y AS y FROM ({_OWN})"
SQL["io_geojson_collection_records"] = f"""WITH RECURSIVE top AS (SELECT record_id, position, {_META}, g FROM {_RECORDS} WHERE lower(json_extract_string(g, '$.type')) = 'geometrycollection'),
m AS (SELECT record_id, position, oid, CAST([] AS INT[]) AS steps, g FROM top WHERE json_type(g, '$.geometries') = 'ARRAY'
  UNION ALL SELECT record_id, position, oid, list_append(steps, CAST(i AS INT)), es[i] FROM (SELECT *, CAST(json_extract(g, '$.geometries') AS JSON[]) AS es FROM m WHERE json_type(g, '$.geometries') = 'ARRAY'), unnest(generate_series(1, len(es))) u(i))
SELECT record_id, position, oid, CAST(row_number() OVER (PARTITION BY record_id, position ORDER BY steps) - 1 AS INT) AS member, json_extract_string(g, '$.type') AS kind FROM m WHERE json_type(g, '$.geometries') IS DISTINCT FROM 'ARRAY'"""
