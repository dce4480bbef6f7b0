"""Streams give what the same functions give for the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.apps import check_in
from tidegrid.grid import Grid
from tidegrid.operators import spatial, trajectories
from tidegrid.operators.windowing import Windows, assign, by_arrival
from tidegrid.sinks.streams import Meter, observed, to_files, with_latency
from tidegrid.streaming import stateful

GRID = Grid.by_count(10, 0.0, 1.0, 0.0, 1.0)
DDL = "event_id bigint, oid string, ts_ms bigint, x double, y double"


def points(n=200, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice("abcd"), 1000 * i, rnd.random(), rnd.random()) for i in range(n)]


def arriving(spark, tmp_path, rows, ddl=DDL, name="in", batches=4):
    """A stream of ``rows`` in order, some per batch, closed by a late row that moves the watermark on."""
    import time

    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(1.1)  # files are taken in order of age
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def run(spark, df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


CLOSE = [(10**6, "z", 10**9, 0.5, 0.5)]


def test_range_and_filter(spark, tmp_path):
    rows = points()
    query = spark.createDataFrame([(0.5, 0.5), (0.1, 0.1)], "x double, y double")
    stream = arriving(spark, tmp_path, rows)
    batch = spark.createDataFrame(rows, DDL)
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(run(spark, spatial.range_query(stream, query, 0.2, GRID), "r")) == ids(spatial.range_query(batch, query, 0.2, GRID))
    assert ids(run(spark, trajectories.tfilter(stream, ["a"]), "f")) == ids(trajectories.tfilter(batch, ["a"]))


def test_windowed_knn_and_trajectories(spark, tmp_path):
    rows, windows = points(), Windows(50_000, 25_000, 5_000)
    place = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    stream = arriving(spark, tmp_path, rows + CLOSE)
    batch = spark.createDataFrame(rows, DDL)
    start = lambda r: int(r.window.start.timestamp() * 1000)
    got = {(start(r), r.rank, r.oid) for r in run(spark, spatial.knn_query(stream, place, 0.4, 2, GRID, windows=windows), "k").collect()}
    want = {(r.window_start, r.rank, r.oid) for r in spatial.knn_query(batch, place, 0.4, 2, GRID, windows=windows).collect()}
    assert got == want
    near = trajectories.tknn(stream, 0.5, 0.5, 0.4, 2, GRID, windows)
    want = {(r.window_start, r.rank, r.oid, r.dist, r.x, r.y) for r in trajectories.tknn(batch, 0.5, 0.5, 0.4, 2, GRID, windows).collect()}
    assert {(start(r), r.rank, r.oid, r.dist, r.x, r.y) for r in run(spark, near, "n").collect()} == want
    latest = {}

    def keep(df, batch_id):
        for r in df.collect():
            latest.setdefault(start(r), {}).setdefault(batch_id, set()).add((r.rank, r.oid, r.dist))

    every = trajectories.tknn(stream, 0.5, 0.5, 0.4, 2, GRID, windows, every_batch=True)
    every.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(w, *row) for w, by in latest.items() if w < 10**8 for row in by[max(by)]} == {w[:4] for w in want} and max(map(len, latest.values())) > 1
    got = {(int(r.window.start.timestamp() * 1000), r.oid, r.n) for r in run(spark, trajectories.tfilter(stream, None, windows), "t").collect()}
    assert got == {(r.window_start, r.oid, r.n) for r in trajectories.tfilter(batch, None, windows).collect()}


def test_stream_join(spark, tmp_path):
    windows = Windows(50_000, None, 5_000)
    a, b = points(120, 1), points(120, 2)
    left, right = arriving(spark, tmp_path, a + CLOSE, name="a"), arriving(spark, tmp_path, b + CLOSE, name="b")
    got = {(r.event_id, r.q_event_id) for r in run(spark, spatial.spatial_join(left, right, 0.1, GRID, windows=windows), "j").collect()}
    want = {(r.event_id, r.q_event_id) for r in spatial.spatial_join(spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL), 0.1, GRID, windows=windows).collect()}
    assert {g for g in got if g[0] < 10**6} == want and want


def test_streamed_trajectories(spark, tmp_path):
    windows = Windows(50_000, None, 5_000)
    a, b = points(120, 1), points(120, 2)
    left, right = arriving(spark, tmp_path, a + CLOSE, name="a"), arriving(spark, tmp_path, b + CLOSE, name="b")
    start = lambda r: int(r.window.start.timestamp() * 1000)
    own, other = spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL)
    got = {(start(r), r.oid, r.qid, r.q_ts_ms, r.q_x) for r in run(spark, trajectories.tjoin(left, right, 0.1, GRID, windows), "tj").collect()}
    want = {(r.window_start, r.oid, r.qid, r.q_ts_ms, r.q_x) for r in trajectories.tjoin(own, other, 0.1, GRID, windows).collect()}
    assert got == want and want
    zones = spark.createDataFrame([([[(0.1, 0.1), (0.4, 0.1), (0.4, 0.4)]],)], "rings array<array<struct<x:double,y:double>>>")
    got = {(start(r), r.oid, r.n) for r in run(spark, trajectories.trange(left, zones, GRID, windows), "tr").collect()}
    assert got == {(r.window_start, r.oid, r.n) for r in trajectories.trange(own, zones, GRID, windows).collect()} != set()
    for fn in ("ALL", "SUM", "MAX"):
        got = {(start(r), r.cx, r.cy, r.n_traj, *sorted(r.lengths.items())) for r in run(spark, trajectories.taggregate(left, fn, GRID, windows), f"ta_{fn}").collect()}
        assert got == {(r.window_start, r.cx, r.cy, r.n_traj, *sorted(r.lengths.items())) for r in trajectories.taggregate(own, fn, GRID, windows).collect()} != set()


def test_running_stats(spark, tmp_path):
    rows = points()
    got = {(r.oid, r.ts_ms, round(r.spatial_len, 9)) for r in run(spark, stateful.running_stats(arriving(spark, tmp_path, rows)), "s").collect()}
    assert got == {(r.oid, r.ts_ms, round(r.spatial_len, 9)) for r in trajectories.tstats(spark.createDataFrame(rows, DDL), stretch=9_000).collect()}


def test_count_windows(spark, tmp_path):
    rows = points(400)
    small = Grid.by_count(2, 0.0, 1.0, 0.0, 1.0)
    got = {(r.cx, r.cy, r.last, r.n_traj, r.sum_ms) for r in run(spark, stateful.count_windows(arriving(spark, tmp_path, rows), small, 20, 10), "c").collect()}
    batch = trajectories.taggregate(spark.createDataFrame(rows, DDL), "SUM", small, Windows(20, 10), count_based=True)
    assert got == {(r.cx, r.cy, r.last, r.n_traj, r.lengths[""]) for r in batch.collect()} and got


@pytest.mark.parametrize("fn", ["ALL", "SUM", "AVG", "MIN", "MAX"])
def test_heat_map(spark, tmp_path, fn):
    rows = points(100)
    small = Grid.by_count(2, 0.0, 1.0, 0.0, 1.0)
    seen = {}

    def keep(df, batch_id):
        for r in df.collect():
            if seen.get((r.cx, r.cy), (None,))[0] != batch_id:
                seen[r.cx, r.cy] = (batch_id, r.n_traj, {})
            seen[r.cx, r.cy][2][r.key] = r.value

    stateful.heat_map(arriving(spark, tmp_path, rows, batches=2), fn, small).writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    want = {(r.cx, r.cy): (r.n_traj, r.lengths) for r in trajectories.taggregate_now(spark.createDataFrame(rows, DDL), fn, small).collect()}
    assert {k: v[1:] for k, v in seen.items()} == want


def test_check_in(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("uv"), 1000 * i, f"room{rnd.randint(0, 1)}-{rnd.choice(['in', 'out'])}") for i in range(80)]
    ddl = "event_id bigint, user_id string, ts_ms bigint, device_id string"
    stream = arriving(spark, tmp_path, rows, ddl)
    key = lambda df: sorted((r.ts_ms, r.event_id, r.inserted, r.device_id) for r in df.collect())
    full = run(spark, stateful.missed_events(stream), "m")
    batch = check_in.complete_events(spark.createDataFrame(rows, ddl))
    assert key(full) == key(batch) and batch.where("inserted").count() > 0
    last = {r.room: r.occupancy for r in stateful.occupancy(full).collect()}
    ends = {}
    for r in check_in.check_in(spark.createDataFrame(rows, ddl), {"room0": 5}).orderBy("ts_ms", "event_id", F.desc("inserted")).collect():
        ends[r.room] = r.occupancy
        assert r.capacity == (5 if r.room == "room0" else None)
    assert last == ends
    assert check_in.check_in(spark.createDataFrame([], ddl), {}).count() == 0


def test_idle_state_goes(spark, tmp_path):
    """After a pause longer than ``idle_ms`` a key begins anew."""
    import time

    rows = [(i, "a" if i != 2 else "b", 1000 * i, 0.1 * i, 0.0) for i in range(6)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def work(name, make, part):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/{name}")
        seen = []
        make(stream).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).outputMode("append" if name != "heat" else "update").option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start().awaitTermination()
        return seen

    try:
        for idle, want in ((None, {5000}), (3_000, set())):
            name = f"stats_{idle}"
            stats = lambda s, idle=idle: stateful.running_stats(s, idle_ms=idle)
            assert {r.ts_ms for r in work(name, stats, rows[:2])} == {1000}
            if idle:
                time.sleep(idle / 1000 + 1)
            work(name, stats, rows[2:3])  # another key; idle ones go
            assert {r.ts_ms for r in work(name, stats, rows[5:])} == want
        heat = lambda s: stateful.heat_map(s, "SUM", Grid.by_count(1, 0.0, 1.0, 0.0, 1.0), idle_ms=3_000)
        assert [(r.n_traj, r.value) for r in work("heat", heat, rows[:2])] == [(1, 1000)]
        time.sleep(4)
        assert [(r.n_traj, r.value) for r in work("heat", heat, rows[2:3])] == [(1, 0)]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_windows_by_arrival(spark, tmp_path):
    import time

    before = time.time() * 1000
    rows = spark.createDataFrame(points(20), DDL)
    counts = assign(by_arrival(rows), Windows(60_000)).groupBy("window_start").count().collect()
    assert sum(r["count"] for r in counts) == 20 and all(before - 60_000 < r.window_start <= time.time() * 1000 for r in counts)
    stream = by_arrival(arriving(spark, tmp_path, points(20), batches=1))
    got = run(spark, assign(stream, Windows(60_000)).groupBy("window").count(), "arrival", "complete").collect()
    assert sum(r["count"] for r in got) == 20


def test_files_and_measures(spark, tmp_path):
    rows = points(40)
    meter = Meter()
    spark.streams.addListener(meter)
    stream = arriving(spark, tmp_path, rows, batches=2)
    to_files(observed(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(meter)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40 and meter.rows == {"throughput": 40}
    late = with_latency(spark.sql("SELECT current_timestamp() - INTERVAL 5 SECONDS AS ingest_ts")).first()
    assert 5_000 <= late.latency_ms < 60_000
