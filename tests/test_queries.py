"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidegrid.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Without SQL: rows come, none twice, the same in each run."""
    df = QUERIES[name](spark, DATA)
    rows = sorted(map(repr, df.collect()))
    assert rows and len(set(rows)) == len(rows) and rows == sorted(map(repr, QUERIES[name](spark, DATA).collect()))


def test_tables_of_objects_are_linked(spark):
    """The bridge's ids are those of the tables, and a table counts what the bridge has."""
    linked = QUERIES["p1_bridge"](spark, DATA).groupBy("entity", "object_id").count().collect()
    tables = {"feature": "p1_features", "geometry": "p1_geometries", "ring": "p1_rings", "leg": "p1_legs", "call": "p1_calls"}
    for entity, name in tables.items():
        assert {r.object_id: r.n_occurrences for r in QUERIES[name](spark, DATA).collect()} == {r.object_id: r["count"] for r in linked if r.entity == entity}


def test_sql_has_queries():
    assert not set(SQL) - set(QUERIES)


FOUND = {
    "p1_found": "record_id bigint, entity string, node_path string, parent_path string", "p2_found": "stream_name string, event_id bigint, period_start_ms bigint, outcome string",
    "p3_found": "line_id bigint, fail_reason string", "p4_found": "key_kind string, key_value string", "p5_found": "oid string, seg_kind string, start_ms bigint, end_ms bigint",
    "p6_found": "rel_kind string, target_id bigint, event_id bigint",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == FOUND[name]
    assert df.count() == df.distinct().count() > 0
