"""Records as text into shapes: GeoJSON (bare or in a ``{"key", "value"}`` envelope), WKT and delimited points.

Kinds: ``pt`` gives x, y; ``pg`` parts (polygons as arrays of rings) and rings (all parts' together); ``ls`` paths; ``mp``
points; ``gc`` members (kind, geojson). All also give oid and ts_ms, null where absent or unreadable, and keep the
input's columns. Texts of another kind or not well-formed give null shapes. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = {"pt": ("Point",), "pg": ("Polygon", "MultiPolygon"), "ls": ("LineString", "MultiLineString"), "mp": ("MultiPoint",), "gc": ("GeometryCollection",)}
SHAPES = {"pt": ["x", "y"], "pg": ["parts", "rings"], "ls": ["paths"], "mp": ["points"], "gc": ["members"]}
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_MEMBER = r"(?i)(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON)\s*(?:Z|M|ZM)?\s*(\([0-9eE+\-.,()\s]*\))"


def _array(levels: int) -> str:
    return "array<" * levels + "double" + ">" * levels


def _xy(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def _path(p: Column) -> Column:
    return F.transform(p, _xy)


#: Coordinates as they are parsed with their record: of one depth for points, else as text until the type is known.
_COORDINATES = {"pt": "array<double>", "mp": "array<array<double>>", "ls": "string", "pg": "string", "gc": "string"}


def shape_columns(kind: str, name: Column, coordinates: Column) -> dict[str, Column]:
    """Shape columns from a geometry's type name and its coordinates (as _COORDINATES has them)."""
    parsed = lambda levels: F.from_json(coordinates, _array(levels))
    is_ = lambda n: F.lower(name) == n.lower()
    if kind == "pt":
        p = F.when(is_("Point"), coordinates)
        return {"x": F.get(p, F.lit(0)), "y": F.get(p, F.lit(1))}
    if kind == "mp":
        return {"points": F.when(is_("MultiPoint"), _path(coordinates))}
    if kind == "ls":
        return {"paths": F.when(is_("LineString"), F.array(_path(parsed(2)))).when(is_("MultiLineString"), F.transform(parsed(3), _path))}
    rings = lambda r: F.transform(r, _path)
    parts = F.when(is_("Polygon"), F.array(rings(parsed(3)))).when(is_("MultiPolygon"), F.transform(parsed(4), rings))
    return {"parts": parts, "rings": F.flatten(parts)}


def parse_time(text: Column, date_format: str | None) -> Column:
    """Epoch ms of a text in ``date_format`` (UTC), or of digits; null where it is neither."""
    ms = F.when(F.rlike(text, F.lit(r"^\s*-?[0-9]{1,18}\s*$")), F.trim(text).try_cast("long"))
    if not date_format or date_format == "null":
        return ms
    dated = F.unix_millis(F.try_to_timestamp(text, F.lit(date_format)))
    # A format with signs between its letters is never written in digits alone, which are told apart at less cost.
    return F.coalesce(dated, ms) if date_format.isalpha() else F.coalesce(ms, dated)


def _made_once(c: Column) -> Column:
    """``c`` as a generated column, which no filter on what is made from it is pushed below; so nothing is parsed twice."""
    return F.explode_outer(F.array(c))


def decode_geojson(records: DataFrame, kind: str, value: str = "value", oid_property: str = "oID", time_property: str = "timestamp", date_format: str | None = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Features, bare geometries, and envelopes of either. A geometry or properties may be an object or, in a string,
    its text. Members of a collection come in order, those of collections in it included.

    A record is parsed once, an envelope's value once more, by a schema that holds what is asked for only.
    """
    geometry = f"struct<type:string,coordinates:{_COORDINATES[kind]},geometries:array<string>>"
    properties = f"struct<`{oid_property}`:string,`{time_property}`:string>"
    fields = f"type:string,coordinates:{_COORDINATES[kind]},geometries:array<string>,geometry:{geometry},properties:{properties}"
    text = F.col(value)
    out = records.withColumn("__r", F.from_json(text, f"struct<value:string,{fields}>"))
    r = F.col("__r")
    bare = F.struct(*(r[c].alias(c) for c in ("type", "coordinates", "geometries", "geometry", "properties")))
    out = out.withColumn("__v", F.when(r["value"].isNotNull(), F.from_json(r["value"], f"struct<{fields}>")).otherwise(bare))
    v, whole = F.col("__v"), F.coalesce(r["value"], text)
    in_string = lambda name, ddl: F.from_json(F.get_json_object(whole, f"$.{name}"), ddl)
    own = F.struct(*(v[c].alias(c) for c in ("type", "coordinates", "geometries")))
    # Only what is neither a geometry nor a feature with an object is looked at for one in a string.
    lone = v["coordinates"].isNotNull() | v["geometries"].isNotNull()
    g = F.coalesce(v["geometry"], F.when(lone, own).otherwise(in_string("geometry", geometry)))
    p = F.coalesce(v["properties"], F.when(v["geometry"].isNotNull() | ~lone, in_string("properties", properties)))
    out = out.withColumn("__d", _made_once(F.struct(g.alias("g"), p.alias("p"))))
    g, p = F.col("__d.g"), F.col("__d.p")
    shapes = {"members": F.when(F.lower(g["type"]) == "geometrycollection", _members(g["geometries"]))} if kind == "gc" else shape_columns(kind, g["type"], g["coordinates"])
    oid = F.nullif(F.trim(F.replace(p[oid_property], F.lit('"'), F.lit(""))), F.lit(""))
    return out.withColumns({"oid": oid, "ts_ms": parse_time(p[time_property], date_format), **shapes}).drop("__r", "__v", "__d")


def features(records: DataFrame, value: str = "value") -> DataFrame:
    """``records`` with each feature of a FeatureCollection (in an envelope or bare) as a record of its own; others as
    they are. Null features give none. Adds ``position``, the feature's in its collection, 0 for others."""
    own = "type:string,features:array<string>"
    out = records.withColumn("__r", F.from_json(value, f"struct<value:string,{own}>"))
    r = F.col("__r")
    out = out.withColumn("__v", F.when(r["value"].isNotNull(), F.from_json(r["value"], f"struct<{own}>")).otherwise(F.struct(r["type"].alias("type"), r["features"].alias("features"))))
    several = F.coalesce(F.col("__v.type") == "FeatureCollection", F.lit(False))
    parts = F.when(several, F.coalesce("__v.features", F.array().cast("array<string>"))).otherwise(F.array(F.col(value)))
    kept = [c for c in records.columns if c not in (value, "position")]
    out = out.select(*kept, several.alias("__several"), F.posexplode(parts).alias("position", value))
    return out.where(F.col(value).isNotNull() | ~F.col("__several")).drop("__several")


#: Levels of collections inside collections that are gone into.
DEPTH = 8


def _members(texts: Column) -> Column:
    """Members (kind, geojson) of a collection from their texts, those of collections in it in their place."""
    parsed = F.transform(texts, lambda t: F.from_json(t, "struct<type:string,coordinates:string,geometries:array<string>>"))
    flat = parsed
    for _ in range(DEPTH):
        inner = lambda m: F.transform(m["geometries"], lambda t: F.from_json(t, "struct<type:string,coordinates:string,geometries:array<string>>"))
        flat = F.flatten(F.transform(flat, lambda m: F.coalesce(inner(m), F.array(m))))
    as_text = lambda m: F.concat(F.lit('{"type":"'), m["type"], F.lit('","coordinates":'), m["coordinates"], F.lit("}"))
    deep = F.when(F.exists(parsed, lambda m: m["geometries"].isNotNull()), flat).otherwise(parsed)
    return F.transform(deep, lambda m: F.struct(m["type"].alias("kind"), as_text(m).alias("geojson")))


def _wkt_json(body: Column) -> Column:
    """Coordinates of a WKT body as JSON: pairs (a third number goes) in brackets, parentheses as brackets."""
    pairs = F.regexp_replace(body, rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", "[$1,$2]")
    return F.translate(pairs, "()", "[]")


def _wkt_coordinates(kind: str, body: Column) -> Column:
    if kind == "pt":
        return F.transform(F.split(F.trim(F.translate(body, "()\t\r\n", "     ")), " +"), lambda v: v.try_cast("double"))
    text = _wkt_json(body)
    if kind == "mp":  # each point may have brackets of its own
        text = F.regexp_replace(F.regexp_replace(text, r"\[\s*\[([^\[\]]*)\]\s*\]", "[$1]"), r"^(\[[^\[\]]*\])$", "[$1]")
        return F.from_json(text, _array(2))
    return text


def decode_wkt(records: DataFrame, kind: str, value: str = "value", delimiter: str = ",", date_format: str | None = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """``oid<delimiter>WKT<delimiter>time`` (oid and time may be missing; the time is the last field behind the WKT
    that reads as one). Double quotes don't count."""
    text = F.replace(F.col(value), F.lit('"'), F.lit(""))
    tags = "|".join(n.upper() for n in NAMES[kind])
    body = rf"\(\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})*\s*\)" if kind == "pt" else r"\(.*\)"
    whole = rf"(?is)^(.*?)\b({tags})\s*(?:Z|M|ZM)?\s*({body})([^)]*)$"
    # One match gives all parts, between signs that no record has; texts that don't match have none.
    records = records.withColumn("__parts", _made_once(F.split(F.regexp_replace(text, whole, "\u0001$1\u0001$2\u0001$3\u0001$4"), "\u0001")))
    part = lambda i: F.coalesce(F.get("__parts", F.lit(i)), F.lit(""))
    sep = {r"\t": "\t", r"\\t": r"\t"}.get(delimiter, delimiter)
    fields = lambda c: F.split(c, F.lit("\\Q" + sep + "\\E"))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    oid = F.nullif(trimmed(F.get(fields(part(1)), F.lit(0))), F.lit(""))
    times = F.filter(F.transform(fields(part(4)), lambda f: parse_time(trimmed(f), date_format)), lambda t: t.isNotNull())
    if kind == "gc":
        found = F.regexp_extract_all(part(3), F.lit(_MEMBER), F.lit(0))
        pick = lambda m, i: F.regexp_extract(m, _MEMBER, i)

        def member(m: Column) -> Column:
            name, body = F.upper(pick(m, 1)), pick(m, 2)
            proper = F.lit(None).cast("string")
            for k, names in NAMES.items():
                for n in names:
                    coordinates = _wkt_coordinates(k, _closed(body))
                    coordinates = coordinates if _COORDINATES[k] == "string" else F.to_json(coordinates)
                    proper = F.when(name == n.upper(), F.concat(F.lit(f'{{"type":"{n}","coordinates":'), coordinates, F.lit("}"))).otherwise(proper)
            return F.struct(F.get_json_object(proper, "$.type").alias("kind"), proper.alias("geojson"))

        shapes = {"members": F.when(part(2) != "", F.transform(found, member))}
    else:
        shapes = shape_columns(kind, part(2), _wkt_coordinates(kind, part(3)))
    return records.withColumns({"oid": oid, "ts_ms": F.try_element_at(times, F.lit(-1)), **shapes}).drop("__parts")


def _closed(body: Column) -> Column:
    """A member's body without what belongs to the collection: the shortest start whose parentheses balance."""
    n = F.length(body)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring(body, i, F.lit(1)) == "(", 1).when(F.substring(body, i, F.lit(1)) == ")", -1).otherwise(0))
    # Depth after each character; the first 0 ends the body.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        depth, at = acc["depth"] + s, acc["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    return F.substring(body, F.lit(1), F.aggregate(steps, start, step)["end"])


def decode_csv(records: DataFrame, attrs: list[int], value: str = "value", delimiter: str = ",", date_format: str | None = None) -> DataFrame:
    """Points from lines; ``attrs``: positions of oid, time, x, y. Quotes go and blanks round fields too. For lines that
    may be broken, with reasons, see ``operators.reject_rows``."""
    sep = {r"\t": "\t", r"\\t": r"\t"}.get(delimiter, delimiter)
    fields = F.split(F.replace(F.col(value), F.lit('"'), F.lit("")), F.lit(r"\s*\Q" + sep + r"\E\s*" if sep.strip() else "\\Q" + sep + "\\E"))
    at = lambda i: F.trim(F.get(fields, F.lit(attrs[i])))
    return records.withColumns({"oid": F.nullif(at(0), F.lit("")), "ts_ms": parse_time(at(1), date_format), "x": at(2).try_cast("double"), "y": at(3).try_cast("double")})


def decode(records: DataFrame, input_format: str, kind: str = "pt", **options: object) -> DataFrame:
    """``input_format``: GeoJSON, WKT, CSV or TSV. Delimited records hold points as fields, other shapes as WKT among them."""
    form = input_format.lower()
    if form == "geojson":
        return decode_geojson(records, kind, **options)
    if form == "wkt":
        return decode_wkt(records, kind, **options)
    if form in ("csv", "tsv"):
        options = ({"delimiter": "\t"} if form == "tsv" else {}) | options
        if kind != "pt":
            return decode_wkt(records, kind, **{k: v for k, v in options.items() if k != "attrs"})
        return decode_csv(records, **options)
    raise ValueError(f"unknown format {input_format}")
