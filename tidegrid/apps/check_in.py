"""Occupancy of rooms from check-in events, with missing events put in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.prefix import previous, running_sums

DAY = 86_400_000


def complete_events(events: DataFrame) -> DataFrame:
    """Events (event_id, user_id, ts_ms, device_id = ``room-in`` or ``room-out``) and those that must have been missed:
    where a user's next event is at the same device and later, the opposite one half-way (``inserted``).

    A user's events are ordered by time, then event_id. Events without user, time or device are left out.
    """
    known = events.where(F.col("user_id").isNotNull() & F.col("ts_ms").isNotNull() & F.col("device_id").isNotNull())
    own = previous(known.select("event_id", "user_id", "ts_ms", "device_id"), ["user_id"], "ts_ms", ["event_id"], ["device_id", "ts_ms"], DAY)
    room, way = F.substring_index("device_id", "-", 1), F.substring(F.col("device_id"), F.lit(2) + F.length(F.substring_index("device_id", "-", 1)), F.length("device_id"))
    opposite = F.concat(room, F.when(way == "in", F.lit("-out")).otherwise(F.lit("-in")))
    half = F.floor((F.col("last_ts_ms") + F.col("ts_ms")) / 2).cast("long")
    event = F.struct(F.lit(False).alias("inserted"), F.col("ts_ms").alias("ts_ms"), F.col("device_id").alias("device_id"))
    missed = F.struct(F.lit(True).alias("inserted"), half.alias("ts_ms"), opposite.alias("device_id"))
    again = (F.col("last_device_id") == F.col("device_id")) & (F.col("last_ts_ms") < F.col("ts_ms"))
    both = own.select("event_id", "user_id", F.explode(F.when(again, F.array(missed, event)).otherwise(F.array(event))).alias("e"))
    return both.select("event_id", "user_id", "e.inserted", "e.ts_ms", "e.device_id")


def check_in(events: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """room, capacity, occupancy after each event, ts_ms, event_id, inserted. Events at one time count in order of
    event_id, inserted ones first. Rooms of unknown capacity have a null one. A room's count is summed by stretches of
    time, so a few busy rooms don't make a few long tasks."""
    room = F.substring_index("device_id", "-", 1)
    full = complete_events(events).withColumn("room", room)
    change = F.when(F.col("device_id") == F.concat("room", F.lit("-in")), 1).otherwise(-1).cast("long")
    counted = running_sums(full.withColumn("after", ~F.col("inserted")), ["room"], "ts_ms", ["event_id", "after"], {"occupancy": change})
    known = F.create_map(*(F.lit(v) for kv in capacities.items() for v in kv)) if capacities else F.create_map().cast("map<string,int>")
    return counted.select("room", F.try_element_at(known, F.col("room")).alias("capacity"), "occupancy", "ts_ms", "event_id", "inserted")
