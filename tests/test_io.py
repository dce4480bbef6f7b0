import json

import pytest
from pyspark.sql import functions as F

from tidegrid.config import load_config
from tidegrid.sinks import encode
from tidegrid.sources import decode, shapefile, streams


def texts(spark, values, **extra):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")


SHAPES = {
    "pt": ("x double, y double", [(1.5, -2.25), (116.123456, 40.0)]),
    "mp": ("points array<struct<x:double,y:double>>", [([(1.0, 2.0)],), ([(1.0, 2.0), (3.5, -4.0)],)]),
    "ls": ("paths array<array<struct<x:double,y:double>>>", [([[(1.0, 2.0), (3.0, 4.0)]],), ([[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.5)]],)]),
    "pg": ("parts array<array<array<struct<x:double,y:double>>>>", [([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]]],), ([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]]],)]),
}
MEMBERS = ['{"type":"Point","coordinates":[1.0,2.0]}', '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}', '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}', '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0]]]}', '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0]]]]}', '{"type":"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.0]],[[5.0,6.0],[7.0,8.0]]]}']
SHAPES["gc"] = ("members array<struct<kind:string,geojson:string>>", [([(json.loads(m)["type"], m) for m in MEMBERS],), ([(json.loads(MEMBERS[0])["type"], MEMBERS[0])],)])


@pytest.mark.parametrize("kind", sorted(SHAPES))
@pytest.mark.parametrize("form", ["geojson", "wkt"])
def test_round_trip(spark, kind, form):
    ddl, rows = SHAPES[kind]
    meta = [("veh 1", 1704067205000), (None, None)]
    df = spark.createDataFrame([(*m, *r) for m, r in zip(meta, rows)], f"oid string, ts_ms bigint, {ddl}")
    if form == "geojson":
        back = decode.decode_geojson(encode.encode_geojson(df, kind).select("value"), kind)
    else:
        back = decode.decode_wkt(encode.encode_wkt(df, kind, ";").select("value"), kind, delimiter=";")
    columns = ["oid", "ts_ms", *(c for c in df.columns if c not in ("oid", "ts_ms"))]
    assert [tuple(r) for r in back.select(*columns).collect()] == [tuple(r) for r in df.select(*columns).collect()]


def test_geojson_variants(spark):
    point = {"type": "Point", "coordinates": [1, 2, 3]}
    feature = {"type": "Feature", "geometry": point, "properties": {"id": '"7"', "when": "2024-01-01 00:00:05"}}
    values = [json.dumps(v) for v in (point, feature, {"key": 1, "value": feature}, {"key": 1, "value": point}, {"type": "Polygon", "coordinates": []}, {"type": "Feature", "properties": {"id": "", "when": "soon"}})] + ["{", "", None]
    got = [tuple(r) for r in decode.decode_geojson(texts(spark, values), "pt", oid_property="id", time_property="when").select("oid", "ts_ms", "x", "y").collect()]
    assert got == [(None, None, 1.0, 2.0), ("7", 1704067205000, 1.0, 2.0), ("7", 1704067205000, 1.0, 2.0), (None, None, 1.0, 2.0), *[(None, None, None, None)] * 5]


def test_wkt_variants(spark):
    values = ['"7, POLYGON((0 0, 1 0, 1 1)), 2024-01-01 00:00:05"', "POLYGON ((0 0,1 0,1 1)),x,1704067205000,", "a,nothing,5", None, "a,point(1e2  -3.5 7)", "MULTIPOINT((1 2),(3 4))"]
    polygons = decode.decode_wkt(texts(spark, values), "pg").select("oid", "ts_ms", F.size("rings").alias("n")).collect()
    assert [(r.oid, r.ts_ms) for r in polygons[:2]] == [("7", 1704067205000), (None, 1704067205000)] and [r.n for r in polygons[:2]] == [1, 1]
    assert all(r.n in (None, -1) for r in polygons[2:])
    point = decode.decode_wkt(texts(spark, values), "pt").collect()[4]
    assert (point.oid, point.x, point.y) == ("a", 100.0, -3.5)
    assert [len(r.points) for r in decode.decode_wkt(texts(spark, values), "mp").where("points is not null").collect()] == [2]


def test_csv(spark):
    values = ['0,"7",0,0,1704067205000,116.41 , 39.92', "0,,0,0,x,1,y", "short", None]
    got = [(r.oid, r.ts_ms, r.x, r.y) for r in decode.decode(texts(spark, values), "CSV", attrs=[1, 4, 5, 6]).collect()]
    assert got == [("7", 1704067205000, 116.41, 39.92), (None, None, 1.0, None), (None, None, None, None), (None, None, None, None)]
    polygon = decode.decode(texts(spark, ["7;POLYGON((0 0, 1 0, 1 1));1704067205000", "7;8"]), "CSV", "pg", attrs=[0, 1, 2, 3], delimiter=";").collect()
    assert [(r.oid, r.ts_ms) for r in polygon][0] == ("7", 1704067205000) and len(polygon[0].rings[0]) == 3 and polygon[1].rings is None
    row = spark.createDataFrame([("7", 5, 1.0, 2.0), (None, None, None, 2.0)], "oid string, ts_ms bigint, x double, y double")
    assert [r.value for r in encode.encode_csv(row, [1, 4, 5, 6]).collect()] == ["0,7,0,0,5,1.0,2.0", "0,0,0,0,0,0,2.0"]


def test_shapefile(spark, tmp_path):
    parts = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]], [[(5.0, 5.0), (6.0, 6.0)]]]
    data = shapefile.write_shapes(shapefile.POLYLINE, parts)
    (tmp_path / "a.shp").write_bytes(data)
    (tmp_path / "b.shp").write_bytes(shapefile.write_shapes(shapefile.POINT, [[[(7.0, 8.0)]]]))
    (tmp_path / "c.shp").write_bytes(data[:-5])
    (tmp_path / "d.dbf").write_bytes(b"x")
    got = shapefile.read_shapefiles(spark, str(tmp_path)).orderBy("file", "record_no").collect()
    assert [(r.file[-5:], r.record_no, r.kind, r.x, r.y) for r in got] == [("a.shp", 1, "ls", None, None), ("a.shp", 2, "ls", None, None), ("b.shp", 1, "pt", 7.0, 8.0), ("c.shp", 1, "ls", None, None)]
    assert [[(p.x, p.y) for p in part] for part in got[0].parts] == parts[0]
    with pytest.raises(ValueError):
        list(shapefile.shapes(b"x" * 200))


def test_config(tmp_path):
    job = load_config({"inputs": [{"topic": "t", "format": "CSV", "cell_length": 0.5}], "query": {"mode": "realtime", "omega_ms": 2000, "traj_ids": [1, "b"]}, "brokers": "b:1"})
    assert job.inputs[0].grid().n == 5 and job.query.windows().size == 2000 and job.query.traj_ids == ["1", "b"]
    (tmp_path / "c.json").write_text(json.dumps({"inputs": [], "query": {"size_ms": 5}}))
    with pytest.raises(ValueError):
        load_config(tmp_path / "c.json").query.windows()
    for bad in ({"inputs": [{"topic": "t", "format": "XML"}]}, {"inputs": [{"topic": "t", "bbox": [1]}]}, {"query": {"mode": "count"}}, {"query": {"aggregate": "MEDIAN"}}):
        with pytest.raises(ValueError):
            load_config(bad)
    with pytest.raises(TypeError):
        load_config({"query": {"unknown": 1}})


def test_configured_stream(spark):
    job = load_config({"inputs": [{"topic": "t", "format": "TSV", "csv_attrs": [0, 1, 2, 3], "delimiter": "\\t", "date_format": "null"}]})
    rows = streams.shapes(texts(spark, ["a\t5\t1\t2", "broken"]), job.inputs[0]).collect()
    assert [(r.oid, r.ts_ms, r.x, r.y) for r in rows] == [("a", 5, 1.0, 2.0)]
