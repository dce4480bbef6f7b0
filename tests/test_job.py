"""Jobs from settings, over tables and streams of records."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrid import job
from tidegrid.config import coordinates, load_config, read_yaml

SETTINGS = """!!some.Tag
# settings
# ---
clusterMode: False
kafkaBootStrapServers: "localhost:9092"

inputStream1:
  topicName: "points"
  #topicName: "others"
  format: "GeoJSON"
  dateFormat: "null"
  geoJSONSchemaAttr: ["oID", "timestamp"]
  csvTsvSchemaAttr: [1, 4, 5, 6]   # positions
  gridBBox: [0.0, 0.0, 1.0, 1.0]
  numGridCells: 10
  cellLength: 0
  delimiter: "	"
  charset: "UTF-8"

inputStream2:
  topicName: 'lines # and more'
  format: "CSV"
  dateFormat: "null"
  csvTsvSchemaAttr: [0, 1, 2, 3]
  gridBBox: [0.0, 0.0, 1.0, 1.0]
  delimiter: ","

outputStream:
  topicName: "out"

query:
  option: %(option)s
  operator: %(operator)s
  parallelism: 4
  approximate: False
  radius: 0.15
  aggregateFunction: "SUM"
  k: 2
  omegaDuration: 20
  trajIDs: [a, b]
  queryPoints:
    - [0.5, 0.5]
    - [0.1, 0.1]
  queryPolygons:
    - [[0.4, 0.4], [0.9, 0.4], [0.9, 0.9], [0.4, 0.4]]
  queryLineStrings:
  - [[0.0, 0.0], [1.0, 0.1]]
  thresholds:
    trajDeletion: 1000
    outOfOrderTuples: 1

window:
  type: "TIME"
  interval: 50
  step: 25
"""


def settings(tmp_path, operator="range", option=1, **more):
    (tmp_path / "settings.yml").write_text(SETTINGS.replace("[a, b]", '["a", "b"]') % {"operator": operator, "option": option})
    made = load_config(tmp_path / "settings.yml")
    for k, v in more.items():
        setattr(made.query, k, v)
    return made


def test_layout(tmp_path):
    made = settings(tmp_path, option=2)
    a, b = made.inputs
    assert (a.topic, a.format, a.date_format, a.csv_attrs, a.delimiter, a.n_cells, a.bbox) == ("points", "GeoJSON", "null", [1, 4, 5, 6], "\t", 10, [0.0, 0.0, 1.0, 1.0])
    assert b.topic == "lines # and more" and b.delimiter == ","
    q = made.query
    assert (q.mode, q.radius, q.k, q.omega_ms, q.size_ms, q.slide_ms, q.lateness_ms, q.deletion_ms, q.traj_ids) == ("realtime", 0.15, 2, 20_000, 50_000, 25_000, 1000, 1_000_000, ["a", "b"])
    assert q.points == [[0.5, 0.5], [0.1, 0.1]] and len(q.polygons[0]) == 4 and q.lines == [[[0.0, 0.0], [1.0, 0.1]]]
    assert (made.brokers, made.output_topic, made.parallelism) == ("localhost:9092", "out", 4)
    assert read_yaml("a: 1\nb:\n  c: -2.5\n  d:\n    - x\n    - 'y z'\ne: plain text\nf:\n") == {"a": 1, "b": {"c": -2.5, "d": ["x", "y z"]}, "e": "plain text", "f": {}}
    with pytest.raises(ValueError):
        load_config({"query": {"operator": "none"}})


def test_coordinates():
    pairs = [[116.5, 40.5], [-117.6, 0.5]]
    for text in ("[116.5, 40.5], [-117.6, .5]", "[[116.5,40.5],[-117.6,5e-1]]", "(116.5 40.5, -117.6 0.5)", "((116.5, 40.5), (-117.6, +0.5))"):
        assert coordinates(text) == pairs
    assert coordinates("[[0 0, 1 0, 1 1], [2 2, 3 2, 3 3]]") == [[[0, 0], [1, 0], [1, 1]], [[2, 2], [3, 2], [3, 3]]]
    assert coordinates("116.5, 40.") == [116.5, 40.0]
    assert load_config({"query": {"points": "[1, 2], [3, 4]"}}).query.points == [[1, 2], [3, 4]]


def records(n=120):
    place = lambda i: [round(i * 37 % 101 / 101, 3), round(i * 53 % 97 / 97, 3)]
    feature = lambda i: {"type": "Feature", "geometry": {"type": "Point", "coordinates": place(i)}, "properties": {"oID": "abcd"[i % 4], "timestamp": str(1000 * i)}}
    return [json.dumps({"key": i, "value": feature(i)}) for i in range(n)], [f"q{i % 3},{1000 * i},{place(i)[1]},{place(i)[0]}" for i in range(n)]


OPERATORS = ["range", "knn", "join", "tfilter", "trange", "tstats", "taggregate", "tknn", "tjoin"]


@pytest.mark.parametrize("operator", OPERATORS)
@pytest.mark.parametrize("option", [1, 2])
def test_tables(spark, tmp_path, operator, option):
    first, second = (spark.createDataFrame([(v,) for v in r], "value string") for r in records())
    made = settings(tmp_path, operator, option, aggregate="ALL")
    out = job.results(spark, made, first, second)
    assert job.as_records(out).count() == out.count() > 0
    if operator == "range":
        want = out.sparkSession.createDataFrame([(v,) for v in records()[0]], "value string").select(F.from_json("value", "value struct<geometry struct<coordinates array<double>>>").alias("v")).select(F.col("v.value.geometry.coordinates").alias("c"))
        near = " OR ".join(f"pow(c[0] - {x}, 2) + pow(c[1] - {y}, 2) <= {0.15 ** 2}" for x, y in made.query.points)
        assert out.select("x", "y").distinct().count() == want.where(near).distinct().count()


@pytest.mark.parametrize("operator", ["range", "tfilter", "tstats"])
def test_streams(spark, tmp_path, operator):
    made = settings(tmp_path, operator, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(records()[0]))
    out = job.as_records(job.results(spark, made, spark.readStream.text(f"{tmp_path}/in")))
    out.writeStream.format("memory").queryName(f"job_{operator}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    table = job.results(spark, made, spark.read.text(f"{tmp_path}/in"))
    assert spark.table(f"job_{operator}").count() == table.count() > 0


def test_shapes(spark, tmp_path):
    text = ["POLYGON((0.45 0.45, 0.55 0.45, 0.55 0.55, 0.45 0.45)),7,1000", "POLYGON((0.8 0.0, 0.9 0.0, 0.9 0.1, 0.8 0.0)),8,1000"]
    made = settings(tmp_path, "range", 2, kind="pg")
    made.inputs[0].format, made.inputs[0].delimiter = "WKT", ","
    out = job.results(spark, made, spark.createDataFrame([(t,) for t in text], "value string"))
    assert out.count() == 1
    with pytest.raises(ValueError):
        job.results(spark, settings(tmp_path, "join"), spark.createDataFrame([("x",)], "value string"))
