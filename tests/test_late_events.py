import datetime

from tidegrid.operators import late_events as L
from tidegrid.streaming.lambda_store import LambdaStore

H = 3_600_000
START = 1704067200000  # a full hour
SCHEMA = "event_id bigint, oid string, ts_ms bigint, ingest_ts timestamp, n int, run int"


def at(ms):
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)


def rows():
    end = START + H
    return [
        (1, "a", START, at(end + 120_000), 5, 5), (2, "A ", START + 1, at(end + 120_001), 5, 5), (3, '"a"', START + H - 1, at(end + 6 * H), 5, 5), (4, "a", START, at(end + 6 * H + 1), 5, 5),
        (2, "a", START + 1, at(end + 7 * H), 5, 5), (5, "a", START, None, 5, 5), (5, "a", START, at(end + 3 * H), 5, 5), (6, "a", None, at(end), 5, 5), (7, "a", 5, at(end), 5, 5),
        (None, "a", START, at(end), 5, 5), (8, None, START, at(end), 5, 5), (9, "b", START - 1, at(START - 10), 5, 5), (9, "b", START - 1, at(START - 10), 5, 5),
    ]


def test_outcomes(spark):
    log = L.event_log(spark.createDataFrame(rows(), SCHEMA), "s")
    got = {r.event_id: (r.period_start_ms, r.outcome) for r in L.ledger(log).collect()}
    assert got == {1: (START, "first"), 2: (START, "corrects"), 3: (START, "corrects"), 4: (START, "dropped"), 5: (START, "corrects"), 8: (START, "first"), 9: (START - H, "first")}
    view = {r.oid: (r.n_provisional, r.n, r.n_dropped, r.n_revisions) for r in L.lambda_view(log).collect()}
    assert view == {"a": (1, 4, 1, 3), "b": (1, 1, 0, 0)}
    early = L.lambda_view(log, as_of_ms=START + H + 120_001)
    assert {r.oid: (r.n_provisional, r.n, r.frozen) for r in early.collect()} == {"a": (1, 2, False), "b": (1, 1, False)}
    assert L.lambda_view(log.limit(0)).count() == 0


def test_store(spark, tmp_path):
    log = L.event_log(spark.createDataFrame(rows(), SCHEMA), "s").where("arrived_us is not null").collect()
    schema = L.event_log(spark.createDataFrame([], SCHEMA), "s").schema
    log.sort(key=lambda r: r.arrived_us)
    store = LambdaStore(spark, f"file://{tmp_path}/views")
    assert store.serve().count() == 0
    for i in range(0, len(log), 3):
        part = spark.createDataFrame(log[i : i + 3], schema)
        store.add(part, i)
        store.add(part, i)  # a batch that is run again
        if i % 2:
            store.recompute(log[min(i + 2, len(log) - 1)].arrived_us // 1000)
    store.recompute(START + 100 * H)
    late = spark.createDataFrame([("s", 99, "a", START, (START + 200 * H) * 1000)], schema)
    store.add(late, 10**6)
    store.recompute(START + 300 * H)
    want = {(r.oid, r.period_start_ms, r.n) for r in L.lambda_view(spark.createDataFrame(log, schema)).collect()}
    assert {(r.oid, r.period_start_ms, r.n) for r in store.serve().collect()} == want
    assert all(r.frozen for r in store.serve().collect())


def test_feeds_have_batches_of_their_own(spark, tmp_path):
    """A feed's batches count as they come, whatever the numbers of another feed's."""
    schema = L.event_log(spark.createDataFrame([], SCHEMA), "s").schema
    store = LambdaStore(spark, f"file://{tmp_path}/views")
    row = lambda s, e, p: spark.createDataFrame([(s, e, "a", START + p * H, (START + p * H) * 1000)], schema)
    store.add(row("one", 1, 0), 0, "one")
    store.add(row("two", 1, 0), 10**9, "two")
    store.recompute(START + H)
    store.add(row("one", 2, 0), 1, "one")
    got = lambda: {(r.stream_name, r.period_start_ms, r.n, r.frozen) for r in store.serve().collect()}
    assert got() == {("one", START, 2, False), ("two", START, 1, False)}
    store.recompute(START + 8 * H)  # freezes the first period
    store.add(row("one", 3, 9), 2, "one")
    store.add(row("two", 2, 0), 10**9 + 1, "two")  # too late: its period is frozen
    assert got() == {("one", START, 2, True), ("two", START, 1, True), ("one", START + 9 * H, 1, False)}
    store.recompute(START + 10 * H)
    store.recompute(START + 100 * H)
    assert got() == {("one", START, 2, True), ("two", START, 1, True), ("one", START + 9 * H, 1, True)}


def test_runs(spark):
    end = START + H
    rows = [(i, "a", START, at(end + late), 0, 0) for i, late in enumerate([0, 120_000, 120_001, 120_000 + H, 120_001 + H, 6 * H, 6 * H + 1])]
    events = L.ledger(L.event_log(spark.createDataFrame(rows, SCHEMA), "s"))
    assert {r.event_id: r.run for r in events.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 6, 6: None}
    assert {(r.run, r.n_added, r.n) for r in L.view_runs(events).collect()} == {(0, 2, 2), (1, 2, 4), (2, 1, 5), (6, 1, 6), (None, 1, None)}


def test_stream_into_store(spark, tmp_path):
    points = spark.createDataFrame(rows(), SCHEMA)
    points.repartition(3).write.parquet(f"{tmp_path}/in")
    store = LambdaStore(spark, f"file://{tmp_path}/views")
    stream = L.event_log(spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "s")
    stream.writeStream.foreachBatch(store.add).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    store.recompute(START + 100 * H)
    want = {(r.oid, r.n) for r in L.lambda_view(L.event_log(points, "s")).collect()}
    assert {(r.oid, r.n) for r in store.serve().collect()} == want
