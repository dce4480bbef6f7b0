"""The lambda views of ``operators.late_events`` kept up over streams, as tables in one folder.

``add`` is the fast layer: each micro-batch goes to the log, which is partitioned by day of event time, and its counts
to the increments. ``recompute`` is the scheduled batch: it counts all open periods anew from the log's open days,
replaces their values, and freezes those past the cut-off; frozen rows are written once and not touched again.
``serve`` gives the frozen rows, the last batch's open rows and the increments since.

Several feeds (streaming queries) may write to one store, each with batch numbers of its own. Every table is written
under a name of its own and counts once it is complete, so a job that is lost half-way is simply run again.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.late_events import Periods, ledger

KEY = ["stream_name", "oid", "period_start_ms"]
DAY = 86_400_000
_LOG = "stream_name string, event_id bigint, oid string, ts_ms bigint, arrived_us bigint"
_COUNTS = "stream_name string, oid string, period_start_ms bigint, n bigint"
_RUN = "feed string, batch bigint, frozen_to bigint"


class LambdaStore:
    def __init__(self, spark: SparkSession, folder: str, periods: Periods = Periods()) -> None:
        self.spark, self.folder, self.periods = spark, folder.rstrip("/"), periods

    def _listed(self, path: str, complete: bool = True) -> list[str]:
        """Names in a folder, in order; complete tables only, or all."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in found if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}/{n}/_SUCCESS")))

    def _tables(self, paths: list[str], schema: str, base: str | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", f"{self.folder}/{base}") if base else reader).parquet(*(f"{self.folder}/{p}" for p in paths))

    def add(self, log: DataFrame, batch: int, feed: str = "events") -> None:
        """A micro-batch of log rows (see ``event_log``). Give it to ``foreachBatch``; a repeated batch replaces itself."""
        name = quote(feed, safe="")
        rows = log.select("stream_name", "event_id", "oid", "ts_ms", "arrived_us").withColumn("day", F.floor(F.col("ts_ms") / DAY).cast("long"))
        rows = rows.withColumns({"feed": F.lit(name), "batch": F.lit(batch).cast("long")}).hint("rebalance", "day")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "feed", "batch").parquet(f"{self.folder}/log")
        seen = ledger(log, self.periods).where(F.col("run").isNotNull() & F.col("oid").isNotNull())
        seen.groupBy(*KEY).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/fast/{name}/{batch:012d}")

    def _feeds(self) -> dict[str, list[int]]:
        """The complete batches of each feed."""
        return {f: [int(b) for b in self._listed(f"fast/{f}")] for f in self._listed("fast", complete=False)}

    def _last(self) -> tuple[int, dict[str, int], int | None]:
        """The newest run: its number, the last batch of each feed that it has seen, and up to where it froze."""
        names = self._listed("run")
        if not names:
            return -1, {}, None
        rows = self._tables([f"run/{names[-1]}"], _RUN).collect()
        return int(names[-1]), {r["feed"]: r["batch"] for r in rows if r["feed"] is not None}, rows[0]["frozen_to"]

    def _open_log(self, frozen_to: int | None, last: dict[str, int]) -> DataFrame:
        """The log's rows of open periods, of the batches up to ``last``; days without open periods aren't read."""
        days = [n for n in self._listed("log", complete=False) if n.startswith("day=")]
        if frozen_to is not None:
            days = [n for n in days if int(n[4:]) >= frozen_to // DAY]
        rows = self._tables([f"log/{d}" for d in days], f"{_LOG}, day bigint, feed string, batch bigint", "log")
        whole = F.lit(False)
        for feed, batch in last.items():
            whole = whole | ((F.col("feed") == feed) & (F.col("batch") <= batch))
        return rows.where(whole if frozen_to is None else whole & (F.col("ts_ms") >= frozen_to))

    def recompute(self, now_ms: int) -> None:
        """Replaces all open periods by counts over the log, and freezes those whose cut-off lies before ``now_ms``. All
        that arrived up to ``now_ms`` must have been added, or it misses its period's freezing."""
        number, _, frozen_to = self._last()
        last = {feed: batches[-1] for feed, batches in self._feeds().items() if batches}
        border = now_ms - self.periods.length - self.periods.cutoff_after
        border -= border % self.periods.length
        border = border if frozen_to is None else max(border, frozen_to)
        events = ledger(self._open_log(frozen_to, last), self.periods)
        counted = events.where(F.col("run").isNotNull() & F.col("oid").isNotNull()).groupBy(*KEY).agg(F.count("*").alias("n"))
        name = f"{number + 1:012d}"
        is_frozen = (F.col("period_start_ms") < F.lit(border)).alias("frozen")
        counted.select("*", is_frozen).write.mode("overwrite").partitionBy("frozen").parquet(f"{self.folder}/view/{name}")
        rows = [(f, b, border) for f, b in last.items()] or [(None, None, border)]
        self.spark.createDataFrame(rows, _RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/run/{name}")

    def serve(self) -> DataFrame:
        """stream_name, oid, period_start_ms, n, frozen: the frozen rows, the newest open rows and the increments since.
        Frozen periods take none. Between batches an event that came twice may count twice; the next batch corrects it."""
        number, seen, frozen_to = self._last()
        views = [n for n in self._listed("view") if int(n) <= number]
        part = lambda n, frozen: f"frozen={str(frozen).lower()}" in self._listed(f"view/{n}", complete=False)
        frozen = self._tables([f"view/{n}/frozen=true" for n in views if part(n, True)], _COUNTS).withColumn("frozen", F.lit(True))
        opened = self._tables([f"view/{n}/frozen=false" for n in views[-1:] if part(n, False)], _COUNTS)
        new = [f"fast/{f}/{b:012d}" for f, batches in self._feeds().items() for b in batches if b > seen.get(f, -1)]
        fast = self._tables(new, _COUNTS)
        if frozen_to is not None:
            fast = fast.where(F.col("period_start_ms") >= F.lit(frozen_to))
        return frozen.unionByName(opened.unionByName(fast).groupBy(*KEY).agg(F.sum("n").alias("n")).withColumn("frozen", F.lit(False)))
