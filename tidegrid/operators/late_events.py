"""Aggregates by event time over late and out-of-order events, as lambda views.

The fast layer counts each event in its period as it arrives, until the period is first published. From then on a
scheduled batch recomputes every open period from the full log and replaces its value; the last one runs at the cut-off
and freezes the period, so later events are dropped.

Over a log that is complete the whole schedule is worked out at once: each event belongs to the run that first holds it
(the fast layer, a batch, or none as the period was frozen before), and the value that a run publishes is the sum over
the runs up to it. ``streaming.lambda_store`` keeps the same views up batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.canonical import canonical_oid, is_usable


@dataclass(frozen=True)
class Periods:
    """Event-time periods aligned to the epoch, and when their values change (all in milliseconds).

    ``publish_after`` and ``cutoff_after`` count from a period's end; ``batch_every`` is the schedule of the recompute.
    """

    length: int = 3_600_000
    publish_after: int = 120_000
    cutoff_after: int = 21_600_000
    batch_every: int = 3_600_000

    def start(self, ts_ms: Column) -> Column:
        return ts_ms - F.pmod(ts_ms, F.lit(self.length))

    def publish_us(self, start: Column) -> Column:
        return (start + F.lit(self.length + self.publish_after)) * 1000

    def cutoff_us(self, start: Column) -> Column:
        return (start + F.lit(self.length + self.cutoff_after)) * 1000

    def run(self, start: Column, arrived_us: Column) -> Column:
        """The run that first holds an event: 0 for the fast layer, n for the n-th batch after the first publication, of
        which the last comes at the cut-off; null if the period is frozen when the event arrives."""
        late, length = arrived_us - self.publish_us(start), self.batch_every * 1000
        nth = F.floor((late + F.lit(length - 1)) / F.lit(length)).cast("long")
        return F.when(late <= 0, F.lit(0).cast("long")).when(arrived_us <= self.cutoff_us(start), nth)


def event_log(points: DataFrame, stream_name: str) -> DataFrame:
    """One stream as log rows: stream_name, event_id, oid, ts_ms, arrived_us. Rows that can't be placed (no event_id,
    usable time or arrival) are left out by the scan; other columns are ignored."""
    placed = points.where(F.col("event_id").isNotNull() & is_usable(F.col("ts_ms")) & F.col("ingest_ts").isNotNull())
    return placed.select(
        F.lit(stream_name).alias("stream_name"), "event_id", canonical_oid(F.col("oid")).alias("oid"),
        "ts_ms", F.unix_micros(F.col("ingest_ts").cast("timestamp")).alias("arrived_us"),
    )


def ledger(log: DataFrame, periods: Periods = Periods()) -> DataFrame:
    """One row for each event that can be placed: stream_name, event_id, oid, ts_ms, arrived_us, period_start_ms,
    run (see ``Periods.run``) and outcome: ``first`` (the fast layer has it), ``corrects`` (a batch brings it in) or
    ``dropped`` (no run has it).

    Copies of an event (same stream and ``event_id``) are one event that arrives with its earliest copy; should copies
    disagree, the smallest time and oid count. Rows without ``event_id``, usable time or arrival are left out. An empty
    log gives no rows. The only shuffle is by event id, after map-side aggregation.
    """
    start, arrived, run = F.col("period_start_ms"), F.col("arrived_us"), F.col("run")
    return (
        log.where(F.col("event_id").isNotNull() & F.col("ts_ms").isNotNull() & arrived.isNotNull())
        .groupBy("stream_name", "event_id")
        .agg(F.min("arrived_us").alias("arrived_us"), F.min("ts_ms").alias("ts_ms"), F.min("oid").alias("oid"))
        .withColumn("period_start_ms", periods.start(F.col("ts_ms")))
        .withColumn("run", periods.run(start, arrived))
        .withColumn("outcome", F.when(run == 0, "first").when(run > 0, "corrects").otherwise("dropped"))
    )


def view_runs(events: DataFrame) -> DataFrame:
    """What each run publishes for each view row it changes: stream_name, oid, period_start_ms, run, n_added, n (the
    value that replaces the run's before). Dropped events form the row of run null, with no ``n``. Events of blank oid
    form no key. A key has one row per run at most, so the running sum is short."""
    key = ["stream_name", "oid", "period_start_ms"]
    added = events.where(F.col("oid").isNotNull()).groupBy(*key, "run").agg(F.count("*").alias("n_added"))
    order = Window.partitionBy(*key).orderBy(F.col("run").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return added.withColumn("n", F.when(F.col("run").isNotNull(), F.sum("n_added").over(order)))


def lambda_view(log: DataFrame, periods: Periods = Periods(), as_of_ms: int | None = None) -> DataFrame:
    """Counts per stream, oid and period, as served at ``as_of_ms`` (default: when everything has arrived).

    Columns: stream_name, oid, period_start_ms, n_provisional (the fast layer's value at publication), n (the last
    run's value, which is served), n_dropped, n_revisions (batches that replaced the value), frozen. Events of blank
    oid form no key. Before ``as_of_ms`` only events that had arrived count; those later than the last scheduled batch
    are the fast layer's increment on top of that batch.
    """
    events = ledger(log, periods)
    if as_of_ms is not None:
        events = events.where(F.col("arrived_us") <= as_of_ms * 1000)
    n, run = F.col("n"), F.col("run")
    view = view_runs(events).groupBy("stream_name", "oid", "period_start_ms").agg(
        F.coalesce(F.max(F.when(run == 0, n)), F.lit(0)).alias("n_provisional"),
        F.coalesce(F.max_by(n, run), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(run.isNull(), F.col("n_added"))), F.lit(0)).alias("n_dropped"),
        F.count(F.when(run > 0, 1)).alias("n_revisions"),
    )
    frozen = F.lit(True) if as_of_ms is None else periods.cutoff_us(F.col("period_start_ms")) < F.lit(as_of_ms * 1000)
    return view.withColumn("frozen", frozen)
