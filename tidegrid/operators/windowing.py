"""Event-time windows as two integer columns, for batches, and as Spark's windows, for streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = ["window_start", "window_end"]


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` every ``slide`` milliseconds, aligned to the epoch; late rows count up to ``lateness``."""

    size: int
    slide: int | None = None
    lateness: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or (self.slide is not None and (self.slide <= 0 or self.slide > self.size)):
            raise ValueError("a window needs a positive size and a slide up to it")

    @property
    def step(self) -> int:
        return self.slide or self.size


def assign(df: DataFrame, windows: Windows, time: str = "ts_ms") -> DataFrame:
    """``df`` with window_start and window_end (epoch ms), once for each window that holds ``time``. Rows without a time
    are in no window.

    On a stream the columns come from ``window`` over a timestamp, with a watermark ``lateness`` behind.
    """
    if df.isStreaming:
        ms = lambda n: f"{n} milliseconds"
        out = df.withColumn("__ts", F.timestamp_millis(time)).withWatermark("__ts", ms(windows.lateness))
        return out.withColumn("window", F.window("__ts", ms(windows.size), ms(windows.step))).drop("__ts")
    last = F.col(time) - F.pmod(F.col(time), F.lit(windows.step))
    if windows.step == windows.size:
        start = last
        out = df.where(F.col(time).isNotNull()).withColumn("window_start", start)
    else:
        starts = F.sequence(last, F.col(time) - F.lit(windows.size) + 1 + F.pmod(-(F.col(time) - F.lit(windows.size) + 1), F.lit(windows.step)), F.lit(-windows.step))
        out = df.where(F.col(time).isNotNull()).withColumn("window_start", F.explode(starts))
    return out.withColumn("window_end", F.col("window_start") + F.lit(windows.size))


def by_arrival(df: DataFrame, time: str = "ts_ms") -> DataFrame:
    """``df`` with ``time`` set to the clock's at processing (on a stream the batch's), so that windows over it are windows
    of processing time."""
    return df.withColumn(time, F.unix_millis(F.current_timestamp()))


def window_columns(df: DataFrame) -> list[str]:
    """The columns to group by after ``assign``."""
    return ["window"] if "window" in df.columns else list(WINDOW)
