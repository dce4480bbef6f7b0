"""Shapes into records as text: GeoJSON features, WKT lines and delimited points. Null times are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def _path(path: Column) -> Column:
    return F.transform(path, _pair)


def _rings(rings: Column) -> Column:
    return F.transform(rings, _path)


def _geometry(name: str, coordinates: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"{name}","coordinates":'), F.to_json(coordinates), F.lit("}"))


def geometry_json(kind: str) -> Column:
    """The geometry of a row as JSON text: a single part as its own kind, more as the Multi kind."""
    c = F.col
    if kind == "pt":
        return _geometry("Point", F.array("x", "y"))
    if kind == "mp":
        return _geometry("MultiPoint", _path(c("points")))
    if kind == "ls":
        return F.when(F.size("paths") == 1, _geometry("LineString", _path(F.get("paths", F.lit(0))))).otherwise(_geometry("MultiLineString", F.transform("paths", _path)))
    if kind == "pg":
        return F.when(F.size("parts") == 1, _geometry("Polygon", _rings(F.get("parts", F.lit(0))))).otherwise(_geometry("MultiPolygon", F.transform("parts", _rings)))
    if kind == "gc":
        return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform("members", lambda m: m["geojson"]), ","), F.lit("]}"))
    raise ValueError(kind)


def time_text(date_format: str | None) -> Column:
    """A row's time as text: in ``date_format`` (session zone), or epoch ms."""
    if not date_format or date_format == "null":
        return F.col("ts_ms").cast("string")
    return F.date_format(F.timestamp_millis("ts_ms"), date_format)


def encode_geojson(df: DataFrame, kind: str, date_format: str | None = "yyyy-MM-dd HH:mm:ss", oid_property: str = "oID", time_property: str = "timestamp") -> DataFrame:
    """``df`` with ``value``: a Feature with the oid and time as properties."""
    properties = F.to_json(F.struct(F.col("oid").alias(oid_property), time_text(date_format).alias(time_property)))
    return df.withColumn("value", F.concat(F.lit('{"type":"Feature","geometry":'), geometry_json(kind), F.lit(',"properties":'), properties, F.lit("}")))


def _text(path: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(path, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def geometry_wkt(kind: str) -> Column:
    if kind == "pt":
        return F.concat(F.lit("POINT("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    if kind == "mp":
        return F.concat(F.lit("MULTIPOINT"), _text(F.col("points")))
    if kind == "ls":
        many = F.concat(F.lit("MULTILINESTRING"), _list(F.transform("paths", _text)))
        return F.when(F.size("paths") == 1, F.concat(F.lit("LINESTRING"), _text(F.get("paths", F.lit(0))))).otherwise(many)
    if kind == "pg":
        polygon = lambda rings: _list(F.transform(rings, _text))
        many = F.concat(F.lit("MULTIPOLYGON"), _list(F.transform("parts", polygon)))
        return F.when(F.size("parts") == 1, F.concat(F.lit("POLYGON"), polygon(F.get("parts", F.lit(0))))).otherwise(many)
    if kind == "gc":
        return F.concat(F.lit("GEOMETRYCOLLECTION"), _list(F.transform("members", _member_wkt)))
    raise ValueError(kind)


def _member_wkt(m: Column) -> Column:
    """A collection's member from its GeoJSON: brackets become parentheses, and the innermost, pairs, none."""
    coordinates = F.get_json_object(m["geojson"], "$.coordinates")
    pairs = F.regexp_replace(coordinates, r"\[\s*([^\[\],]+?)\s*,\s*([^\[\],]+?)\s*(?:,[^\[\]]*)?\]", "$1 $2")
    body = F.translate(pairs, "[]", "()")
    return F.concat(F.upper(m["kind"]), F.when(F.upper(m["kind"]) == "POINT", F.concat(F.lit("("), body, F.lit(")"))).otherwise(body))


def _separator(delimiter: str) -> str:
    return {r"\t": "\t", r"\\t": r"\t"}.get(delimiter, delimiter)


def encode_wkt(df: DataFrame, kind: str, delimiter: str = ",", date_format: str | None = None) -> DataFrame:
    """``df`` with ``value``: oid, WKT and time (both as far as they are known), separated by ``delimiter`` and a blank."""
    return df.withColumn("value", F.concat_ws(_separator(delimiter) + " ", F.col("oid"), geometry_wkt(kind), time_text(date_format)))


def encode_csv(df: DataFrame, attrs: list[int], delimiter: str = ",", date_format: str | None = None) -> DataFrame:
    """``df`` with ``value``: oid, time, x, y at the positions ``attrs``; ``0`` in all other places, and for nulls."""
    fields = dict(zip(attrs, (F.col("oid"), time_text(date_format), F.col("x").cast("string"), F.col("y").cast("string"))))
    cells = [F.coalesce(fields[i], F.lit("0")) if i in fields else F.lit("0") for i in range(max(attrs) + 1)]
    return df.withColumn("value", F.concat_ws(_separator(delimiter), *cells))


def encode_stay_time(df: DataFrame) -> DataFrame:
    """Rows of ``normalized_stay_time`` with ``value``: ``{"cellID", "window": [start, end], "normalizedStayTime"}``."""
    from tidegrid.grid import Grid

    row = F.struct(Grid.id_of(F.col("cx"), F.col("cy")).alias("cellID"), F.array("window_start", "window_end").alias("window"), F.col("value").alias("normalizedStayTime"))
    return df.withColumn("value", F.to_json(row))
