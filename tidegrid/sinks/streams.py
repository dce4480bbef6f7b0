"""Streams of results: to Kafka, to files, and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def to_kafka(df: DataFrame, brokers: str, topic: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes ``value`` to a topic."""
    return df.select("value").writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode(mode).start()


def to_files(df: DataFrame, folder: str, checkpoint: str, form: str = "parquet", until_done: bool = True) -> StreamingQuery:
    """Appends to a folder; with ``until_done`` what has arrived is worked off, then the query ends."""
    writer = df.writeStream.format(form).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if until_done else writer).start()


def with_latency(df: DataFrame, ingest: str = "ingest_ts") -> DataFrame:
    """``df`` with latency_ms, the time since a row's arrival."""
    now = F.unix_millis(F.current_timestamp())
    return df.withColumn("latency_ms", now - F.unix_millis(F.col(ingest).cast("timestamp")))


def observed(df: DataFrame, name: str = "throughput") -> DataFrame:
    """``df``, whose rows are counted while they pass; see ``Meter``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


class Meter(StreamingQueryListener):
    """Keeps each batch's rows per second and what ``observed`` counted. Add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rates: list[float] = []
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rates.append(event.progress.processedRowsPerSecond)
        for name, row in (event.progress.observedMetrics or {}).items():
            self.rows[name] = self.rows.get(name, 0) + int(row["rows"])

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
