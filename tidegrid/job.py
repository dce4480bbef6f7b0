"""A job from its settings: records in, one operator, records out. ``python -m tidegrid.job settings.yml`` runs it on Kafka."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import JobConfig, QueryConfig, load_config
from tidegrid.operators import spatial, trajectories
from tidegrid.shared import prepare, shared_path
from tidegrid.sinks import streams as sinks
from tidegrid.sources import streams

_PATH = "array<struct<x:double,y:double>>"


def query_set(spark: SparkSession, query: QueryConfig, kind: str) -> DataFrame:
    """The shapes of one kind that the settings list."""
    path = lambda vs: [(float(x), float(y)) for x, y in vs]
    if kind == "pt":
        return spark.createDataFrame(path(query.points), "x double, y double")
    if kind == "pg":
        return spark.createDataFrame([([path(p)],) for p in query.polygons], f"rings array<{_PATH}>")
    return spark.createDataFrame([(path(p),) for p in query.lines], f"path {_PATH}")


def results(spark: SparkSession, job: JobConfig, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """What the job's operator gives for records (``value``) of its first input, or of both for joins; streams or tables.

    Real-time ranges and filters come row by row, all else by window: in real time by windows of the trigger interval.
    """
    q, source = job.query, job.inputs[0]
    grid, windows = source.grid(), q.windows()
    rows = streams.shapes(first, source, q.kind)
    other = streams.shapes(second, job.inputs[1], q.query_kind) if second is not None else None
    if q.operator in ("join", "tjoin") and other is None:
        raise ValueError("a join needs two inputs")
    kinds = {"kind": q.kind, "query_kind": q.query_kind}
    by_window = windows if q.mode == "window" else None
    if q.operator == "range":
        # Shapes of a stream are held against all query shapes, so nothing need be made single again.
        own, key = (rows, None) if q.kind == "pt" else (rows.withColumn("row", F.xxhash64(*rows.columns)), "row")
        return spatial.range_query(own, query_set(spark, q, q.query_kind), q.radius, None if key and rows.isStreaming else grid, key=key, approximate=q.approximate, windows=by_window, **kinds)
    if q.operator == "knn":
        return spatial.knn_query(rows, query_set(spark, q, q.query_kind).limit(1), q.radius, q.k, grid, windows=windows, approximate=q.approximate, **kinds)
    if q.operator == "join":
        return spatial.spatial_join(rows, other, q.radius, grid, windows=windows, approximate=q.approximate, **kinds)
    if q.operator == "tfilter":
        return trajectories.tfilter(rows, q.traj_ids, by_window)
    if q.operator == "trange":
        return trajectories.trange(rows, query_set(spark, q, "pg"), grid, by_window)
    if q.operator == "tknn":
        if not q.points:
            raise ValueError("the nearest to a query point are asked for, and none is given")
        return trajectories.tknn(rows, *q.points[0], q.radius, q.k, grid, windows, every_batch=rows.isStreaming and q.mode == "realtime")
    if q.operator == "tjoin":
        return trajectories.tjoin(rows, other, q.radius, grid, windows)
    numbered = rows if "event_id" in rows.columns else rows.withColumn("event_id", F.xxhash64("oid", "ts_ms", "x", "y"))
    if q.operator == "tstats":
        if rows.isStreaming:
            from tidegrid.streaming.stateful import running_stats

            return running_stats(numbered, q.traj_ids)
        return trajectories.tstats(numbered, q.traj_ids, by_window)
    if rows.isStreaming and q.count_window:
        from tidegrid.streaming.stateful import count_windows

        return count_windows(numbered, grid, q.size_ms, q.slide_ms)
    if rows.isStreaming and q.mode == "realtime":
        from tidegrid.streaming.stateful import heat_map

        return heat_map(rows, q.aggregate, grid, q.deletion_ms)
    return trajectories.taggregate(numbered, q.aggregate, grid, windows, q.count_window)


def as_records(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects (``value``)."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def run(spark: SparkSession, job: JobConfig) -> None:
    """Runs a job from topic to topic until it is stopped."""
    prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", job.parallelism)
    inputs = [streams.kafka(spark, job.brokers, s.topic) for s in job.inputs]
    needed = inputs[:2] if job.query.operator in ("join", "tjoin") else inputs[:1]
    out = results(spark, job, *needed)
    update = job.query.mode == "realtime" and (job.query.operator == "tknn" or (job.query.operator == "taggregate" and not job.query.count_window))
    sinks.to_kafka(as_records(out), job.brokers, job.output_topic, shared_path(spark, "progress"), "update" if update else "append").awaitTermination()


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), load_config(sys.argv[1]))
