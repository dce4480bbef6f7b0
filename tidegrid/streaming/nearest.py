"""The nearest oids of each window over a stream, with a state of k rows per window.

An oid's distance only shrinks as its points come in, and so does the k-th best; so an oid that is not among the k best
so far can only come in again by a nearer point, which then arrives. Keeping k rows is therefore exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tidegrid.operators.windowing import Windows


def best(rows: pd.DataFrame, k: int, by: list[str]) -> pd.DataFrame:
    """The ``k`` oids of least (dist, oid) of each group, each with its nearest row (of equal ones the first in time)."""
    order = ["dist", *(c for c in ("ts_ms", "x", "y") if c in rows.columns)]
    rows = rows.sort_values([*by, "oid", *order], kind="stable").drop_duplicates([*by, "oid"])
    return rows.sort_values([*by, "dist", "oid"], kind="stable").groupby(by, sort=False).head(k)


def nearest(hits: DataFrame, k: int, windows: Windows, every_batch: bool = False) -> DataFrame:
    """``hits``: oid, dist, ts_ms and further columns, of a stream. Per window: rank, oid, dist and the other columns of
    each oid's nearest row.

    Windows come out once, when the watermark has passed them (append mode); with ``every_batch``, each time a batch
    brings rows for them (update mode). Their state goes when they are closed. Batches shrink to k rows per window and
    task before they move, so a window that holds many rows is no task's burden.
    """
    ms = lambda n: f"{n} milliseconds"
    placed = hits.withColumn("__w", F.window(F.timestamp_millis("ts_ms"), ms(windows.size), ms(windows.step)))
    flat = placed.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *hits.columns)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pandas(best(batch.to_pandas(), k, ["start", "end"]), schema=batch.schema, preserve_index=False)

    few = flat.mapInArrow(partly, flat.schema)
    # A window ends up to its size after its rows, so the watermark lies so much behind the ends.
    few = few.withWatermark("end", ms(windows.size + windows.lateness))
    kept = hits.columns
    state = StructType([StructField(n, ArrayType(flat.schema[n].dataType)) for n in kept])
    out = StructType([flat.schema["start"], flat.schema["end"], StructField("rank", IntegerType()), *(flat.schema[n] for n in kept)])

    def ranked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "oid"], kind="stable")
        return pd.DataFrame({"start": [key[0]] * len(rows), "end": [key[1]] * len(rows), "rank": range(1, len(rows) + 1), **{n: rows[n].to_numpy() for n in kept}})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state_: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(kept, (list(v) for v in state_.get)))) if state_.exists else None
        if state_.hasTimedOut:
            state_.remove()
            if not every_batch:
                yield ranked(key, held)
            return
        parts = [held] if held is not None else []
        parts += [f[kept] for f in frames]
        now = best(pd.concat(parts, ignore_index=True).assign(g=0), k, ["g"])[kept]
        state_.update(tuple(now[n].tolist() for n in kept))
        if every_batch:
            yield ranked(key, now)
        state_.setTimeoutTimestamp(max(int(key[1].timestamp() * 1000) - 1, state_.getCurrentWatermarkMs() + 1))

    done = few.groupBy("start", "end").applyInPandasWithState(step, out, state, "update" if every_batch else "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.struct("start", "end").alias("window"), "rank", *kept)
