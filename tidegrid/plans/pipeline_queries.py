"""Queries of the data-pipeline operators (problems 1 to 6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.canonical import canonical_grid_id, canonical_oid, finite, usable_ms
from tidegrid.grid import BEIJING
from tidegrid.operators import heavy_keys, late_events, nested_records, reject_rows, stay_points, strip_sweep
from tidegrid.plans.tables import table
from tidegrid.shared import shared_path
from tidegrid.sources.records import read_records

SITE_RADIUS = 0.0030005


def point_keys() -> dict:
    return {"oid": canonical_oid(F.col("oid")), "grid_id": canonical_grid_id(F.col("grid_id"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_bridge(spark, d).select("record_id", "entity", "node_path", "parent_path")


def p1_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence with its own and its parent's identity and its place in it."""
    return nested_records.bridge(table(spark, d, "geojson_records"))


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.objects(table(spark, d, "geojson_records"))


def flat(entity: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested_records.flat_tables(table(spark, d, "geojson_records"))[entity]


def counts(entity: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """How often objects of a kind occur, by their fields."""
    return lambda spark, d: flat(entity)(spark, d).groupBy(*columns).agg(F.sum("n_occurrences").alias("n"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (late_events.event_log(table(spark, d, t), t) for t in ("moving_points", "zone_stream")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    events = late_events.ledger(logs(spark, d))
    return events.where(F.col("outcome") != "first").select("stream_name", "event_id", "period_start_ms", "outcome")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return late_events.lambda_view(logs(spark, d)).drop("frozen")


def parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.parse_lines(table(spark, d, "stream_lines"), table(spark, d, "stream_conf"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.rejects(parsed_lines(spark, d)).select("line_id", "fail_reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return reject_rows.loaded(parsed_lines(spark, d)).select("line_id", "stream_id", "oid", "ts_ms", "x", "y")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The well-quoted lines, written one after the other to a file or more for each stream and found there again, those
    that hold line breaks too."""
    parsed = parsed_lines(spark, d).where(~F.col("fail_reason").eqNullSafe("quoting"))
    at = f"{shared_path(spark, 'lines')}/text"
    parsed.select("stream_id", F.coalesce("raw_line", F.lit("")).alias("value")).write.partitionBy("stream_id").option("lineSep", "\n").text(at)
    return read_records(spark, at).select("stream_id", "raw_line")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_keys(table(spark, d, "moving_points"), point_keys()).select("key_kind", "key_value")


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    ts, fine = usable_ms(F.col("ts_ms")), finite(F.col("x")) & finite(F.col("y"))
    micro = lambda c: F.when(fine, F.round(F.col(c) * 1e6).cast("long"))
    aggs = {"n_timed": F.count(ts), "first_ms": F.min(ts), "last_ms": F.max(ts), "n_placed": F.count(F.when(fine, 1)), "sum_x_micro": F.sum(micro("x")), "sum_y_micro": F.sum(micro("y"))}
    return heavy_keys.key_states(table(spark, d, "moving_points"), point_keys(), aggs)


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """Per grid cell: pairs of points and sites, with the points' times and the sites' ids summed over the pairs."""
    points = table(spark, d, "moving_points").select(canonical_grid_id(F.col("grid_id")).alias("cell"), usable_ms(F.col("ts_ms")).alias("ts_ms"))
    sites = table(spark, d, "sites").where(finite(F.col("x")) & finite(F.col("y"))).select(BEIJING.cell_id(F.col("x"), F.col("y")).alias("cell"), "site_id")
    points = points.withColumn("ts_s", F.floor(F.col("ts_ms") / 1000).cast("long"))
    joined = heavy_keys.eager_join(points, sites, "cell", {"sum_ts_s": ("left", "ts_s"), "sum_site_id": ("right", "site_id")})
    # With the fixed table of sites, a hundred years of epoch seconds over 10^9 pairs still fit a bigint.
    return joined.select("cell", *(F.col(c).cast("bigint").alias(c) for c in joined.columns if c != "cell"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return stay_points.stops_and_trips(table(spark, d, "moving_points"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("oid", "seg_kind", "start_ms", "end_ms")


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("oid", "seg_kind", "start_ms", "end_ms", "duration_ms", "n_fixes", F.round("distance", 6).alias("distance"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    relations = {"near_site": strip_sweep.near(table(spark, d, "sites"), SITE_RADIUS, "site_id"), "in_zone": strip_sweep.within(table(spark, d, "zones"), "zone_id")}
    return strip_sweep.related(table(spark, d, "moving_points"), "event_id", relations).where(F.col("event_id").isNotNull()).distinct()


def p6_site_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sites at most 0.01 apart, each pair once."""
    pairs = strip_sweep.near_points(table(spark, d, "sites"), table(spark, d, "sites").withColumnRenamed("site_id", "near_id"), 0.01, "site_id", "near_id")
    return pairs.where(F.col("site_id") < F.col("near_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_bridge, p1_objects, p2_found, p2_counts, p3_found, p3_loaded, p3_records, p4_found, p4_stats, p4_joined, p5_found, p5_segments, p6_found, p6_site_pairs)
}
QUERIES |= {"p1_features": flat("feature"), "p1_geometries": flat("geometry"), "p1_rings": flat("ring"), "p1_legs": flat("leg"), "p1_calls": flat("call"), "p1_call_counts": counts("call", "site", "arr", "load_in", "load_out"), "p1_leg_counts": counts("leg", "leg", "mode")}
