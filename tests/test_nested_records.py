import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.operators import nested_records as N

POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], None, []]}


def paths(value, raw=False):
    text = value if raw else json.dumps({"key": 1, "value": value})
    return {(o[0], o[1], o[2]) for o in N.occurrences(text)}


def test_paths():
    nested = {"type": "GeometryCollection", "geometries": [None, POLYGON, {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [None, POLYGON["coordinates"]]}]}]}
    feature = {"type": "Feature", "geometry": nested, "properties": {"oID": 1, "legs": [None, {"leg": 1, "calls": {"site": "a"}}, {"leg": 2, "calls": [None, {"site": "b"}]}]}}
    want = {
        ("feature", "1", ""), ("geometry", "1.g", "1"), ("geometry", "1.g.1", "1.g"), ("ring", "1.g.1.r0", "1.g.1"), ("ring", "1.g.1.r2", "1.g.1"), ("geometry", "1.g.2", "1.g"),
        ("geometry", "1.g.2.0", "1.g.2"), ("geometry", "1.g.2.0.1", "1.g.2.0"), ("ring", "1.g.2.0.1.r0", "1.g.2.0.1"), ("ring", "1.g.2.0.1.r2", "1.g.2.0.1"),
        ("leg", "1.l1", "1"), ("call", "1.l1.c0", "1.l1"), ("leg", "1.l2", "1"), ("call", "1.l2.c1", "1.l2"),
    }
    assert paths({"type": "FeatureCollection", "features": [None, feature]}) == want
    text = dict(feature, geometry=json.dumps(nested), properties=json.dumps(feature["properties"]))
    assert paths({"type": "FeatureCollection", "features": [None, text]}) == want
    assert paths(POLYGON) == {("feature", "0", ""), ("geometry", "0.g", "0"), ("ring", "0.g.r0", "0.g"), ("ring", "0.g.r2", "0.g")}
    assert paths({"type": "Feature"}) == {("feature", "0", "")}
    assert paths({"type": "Feature", "geometry": None, "properties": "no json", "legs": 1}) == {("feature", "0", "")}
    assert paths({"type": "Feature", "properties": {"legs": {"leg": 1, "calls": None}}}) == {("feature", "0", ""), ("leg", "0.l0", "0")}


def test_broken():
    for text in (None, "", "  ", "{", '{"value": {"type": "Feature"}', '{"value": NaN}', "[]", "1", '{"value": 3}', '{"value": {"type": "FeatureCollection", "features": {}}}'):
        assert N.occurrences(text) == []
    deep = '{"value":' + '{"type":"GeometryCollection","geometries":[' * 300 + "]}" * 300 + "}"
    assert len(N.occurrences(deep)) == 301
    assert paths({"type": ["MultiPoint"], "coordinates": [[1, 2]]}) == {("feature", "0", ""), ("geometry", "0.g", "0")}


def test_identities():
    a = N.occurrences('{"value": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}')
    b = N.occurrences('{"value":{"coordinates":[[[0,0],[1,0],[1,1]]],"type":"Polygon"}, "key": 9}')
    assert [o[4] for o in a] == [o[4] for o in b]
    c = N.occurrences('{"value": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 2]]]}}')
    assert not {o[4] for o in a} & {o[4] for o in c}  # a changed leaf changes all above it


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3) | st.sampled_from(["Feature", "FeatureCollection", "Polygon", "MultiPolygon", "MultiPoint", "GeometryCollection"]), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["type", "geometry", "geometries", "coordinates", "properties", "legs", "calls", "features"]) | st.text(max_size=2), c, max_size=4), max_leaves=15)


@given(json_values)
@settings(max_examples=1500, deadline=None)
def test_any_json(value):
    found = N.occurrences(json.dumps({"value": value}))
    by_path = {o[1]: o for o in found}
    assert len(by_path) == len(found)
    for o in found:
        assert (o[2] == "") == (o[0] == "feature")
        if o[2]:
            assert by_path[o[2]][4] == o[5]


def test_spellings():
    record = '{"value":{"type":"Feature","properties":{"a":%s}}}'
    one = lambda v: N.occurrences(record % v)[0][4]
    assert one("1") == one("1.0") == one("1e0") == one("10e-1") != one("1.5") and one("0") == one("-0.0") and one("1e20") == one("1" + "0" * 20)
    assert one('"1"') != one("1") != one("true") and one("1.50") == one("15e-1")


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(N, "HELD", 1000)
    text = json.dumps({"value": {"type": "Feature", "properties": {"legs": [{"leg": 1}, {"leg": 1}]}}})
    rows = [(1, text, "x"), (2, text, "y"), (3, None, None), (None, text, "z"), (4, '{"value":{"type":"Feature","properties":{"a":"\\ud800é"}}}', "w")]
    records = spark.createDataFrame(rows, "record_id bigint, record_json string, content string")
    linked = N.bridge(records).collect()
    assert len(linked) == 10 and {(r.record_id, r.node_path) for r in linked if r.record_id} == {(1, "0"), (1, "0.l0"), (1, "0.l1"), (2, "0"), (2, "0.l0"), (2, "0.l1"), (4, "0")}
    made = {o.object_id: o for o in N.objects(records).collect()}
    assert sorted((o.entity, o.n_occurrences) for o in made.values()) == [("feature", 1), ("feature", 3), ("leg", 6)]
    assert all(r.object_id in made and (r.parent_object_id is None or f"{r.ordinal}:{r.entity}:{r.object_id}" in made[r.parent_object_id].content) for r in linked)
    tables = N.flat_tables(records)
    assert [(r.leg, r.n_occurrences) for r in tables["leg"].collect()] == [("1", 6)] and tables["ring"].count() == 0
    empty = spark.createDataFrame([], "record_id bigint, record_json string")
    assert N.bridge(empty).count() == N.objects(empty).count() == 0


def test_long_record(spark):
    line = {"type": "LineString", "coordinates": [[i, i] for i in range(200_000)]}
    text = json.dumps({"value": {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": line}] * 3}})
    records = spark.createDataFrame([(1, text)], "record_id bigint, record_json string")
    assert N.bridge(records).count() == 6 and {(r.entity, r.n_occurrences) for r in N.objects(records).collect()} == {("feature", 3), ("geometry", 3)}


def test_records_of_any_depth_and_length():
    deep = 20_000
    nested = "[" * deep + "1" + "]" * deep
    record = '{"value":{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2]]]},"properties":{"a":%s}}}'
    assert [r[:2] for r in N.occurrences(record % nested)] == [r[:2] for r in N.occurrences(record % "1")] != []
    assert N.occurrences(record % nested)[0][-1].count("[") == deep + 1  # and the list of children
    assert N.occurrences(record % nested[:-1]) == []
    for levels in (9_980, 9_990, 9_998, 10_000, 10_010):  # about the parser's own limit
        assert len(N.occurrences(record % ("[" * levels + "]" * levels))) == 3
    collections = 6_000
    shape = '{"type":"GeometryCollection","geometries":[' * collections + '{"type":"Point","coordinates":[1,2]}' + "]}" * collections
    assert len(N.occurrences('{"value":%s}' % shape)) == collections + 2
    long = "9" * 5_000
    assert long in N.occurrences(record % long)[0][-1] and N.occurrences(record % long)[0][4] != N.occurrences(record % f'"{long}"')[0][4]
    assert N.occurrences(record % "NaN") == N.occurrences(record % ("0" + long)) == []


@pytest.mark.parametrize("text", ['{"b": [1, -2.5e3, "x\\u00e9", {}], "a": {"c": null, "d": [true, false, []]}, "a": 2}', "[]", " 1 ", '"x"', "", "[1,]", "{,}", '{"a" 1}', "[1 2]", "01", "[", '{"a":1', "1 2", "nul", "﻿1", '{"a":"\n"}', "-", "1.", "[1}", "-Infinity"])
def test_own_parser(text):
    try:
        want = json.loads(text, parse_constant=N._no_constant)
    except ValueError:
        with pytest.raises(ValueError):
            N._loads(text)
    else:
        assert N._loads(text) == want and N._dumps(want) == N.canonical(want)
