"""Operators that keep state over a stream: running statistics, heat map, count windows, check-ins.

Within a micro-batch rows are taken in order of time; a row older than what its key's state has seen is handled as each
operator says. State is partitioned by the operator's own key. With ``idle_ms`` a key's state goes when no row has come
for so long by the clock (and a batch is run after that); its next row then begins anew. Without it state is kept for
every key ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.grid import Grid
from tidegrid.operators.trajectories import AGGREGATES, _of, usable

try:
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
except ImportError:  # not in older versions
    StatefulProcessor, StatefulProcessorHandle = object, None


def _together(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _gone(state: GroupState, idle_ms: int | None) -> bool:
    """Whether a key is called because it was idle, in which case its state goes; else its time begins anew."""
    if state.hasTimedOut:
        state.remove()
        return True
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    return False


def running_stats(points: DataFrame, ids: list[str] | None = None, idle_ms: int | None = None) -> DataFrame:
    """``tstats`` over a stream: a row for each point later than all of its oid's before, but the first: oid, ts_ms,
    spatial_len, temporal_len_ms, speed. Older points are passed over."""
    names = ["oid", "ts_ms", "spatial_len", "temporal_len_ms", "speed"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        if _gone(state, idle_ms):
            return
        rows = _together(frames, "ts_ms", "event_id")
        t, x, y = rows["ts_ms"].to_numpy(np.int64), rows["x"].to_numpy(float), rows["y"].to_numpy(float)
        later = np.diff(t, prepend=t[0] - 1 if old is None else old[1]) > 0
        if old is not None:
            later &= t > old[1]
        t, x, y = t[later], x[later], y[later]
        if old is None:
            first, length = int(t[0]), 0.0
        else:
            first, length = old[0], old[4]
            t, x, y = np.append(old[1], t), np.append(old[2], x), np.append(old[3], y)
        lengths = length + np.cumsum(np.hypot(np.diff(x), np.diff(y)))
        state.update((first, int(t[-1]), float(x[-1]), float(y[-1]), float(lengths[-1]) if len(lengths) else length))
        took = t[1:] - first
        yield pd.DataFrame(dict(zip(names, (np.full(len(took), key[0], object), t[1:], lengths, took, lengths / took))))

    own = _of(points, ids).select("oid", "ts_ms", "event_id", "x", "y")
    return own.groupBy("oid").applyInPandasWithState(
        step, "oid string, ts_ms bigint, spatial_len double, temporal_len_ms bigint, speed double", "first bigint, last bigint, x double, y double, len double", "append", _timeout(idle_ms),
    )


def count_windows(points: DataFrame, grid: Grid, size: int, slide: int, idle_ms: int | None = None) -> DataFrame:
    """Sums of trajectory lengths in a cell's last ``size`` points, each time ``slide`` more have come: cx, cy, last (the
    number of the window's last point), n_traj, sum_ms. The state is the last ``size`` points of a cell."""
    names = ["cx", "cy", "last", "n_traj", "sum_ms"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, oids, times = state.get if state.exists else (0, [], [])
        if _gone(state, idle_ms):
            return
        rows = _together(frames, "ts_ms", "event_id")
        oid = np.array([*oids, *rows["oid"]], object)
        time = np.array([*times, *rows["ts_ms"]], np.int64)
        code = pd.factorize(oid)[0]
        held, out = len(oids), []
        for last in range(seen - seen % slide + slide, seen + len(rows) + 1, slide):
            end = held + last - seen
            spans = pd.Series(time[max(0, end - size) : end]).groupby(code[max(0, end - size) : end])
            total = int((spans.max() - spans.min()).sum())
            if total > 0:
                out.append((*key, last, spans.ngroups, total))
        state.update((seen + len(rows), oid[-size:].tolist(), time[-size:].tolist()))
        yield pd.DataFrame(out, columns=names)

    placed = usable(points).withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))}).where(grid.has(F.col("cx"), F.col("cy")))
    return placed.select("cx", "cy", "oid", "ts_ms", "event_id").groupBy("cx", "cy").applyInPandasWithState(
        step, "cx int, cy int, last bigint, n_traj bigint, sum_ms bigint", "seen bigint, oids array<string>, times array<bigint>", "append", _timeout(idle_ms),
    )


def missed_events(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``check_in.complete_events`` over a stream: events and those put in between: event_id, user_id, inserted, ts_ms,
    device_id. An event older than its user's last one comes out as it is and puts nothing in."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        device, last = state.get if state.exists else (None, None)
        if _gone(state, idle_ms):
            return
        rows = _together(frames, "ts_ms", "event_id")
        own = rows if last is None else rows[rows["ts_ms"] >= last]
        before = own.shift(1)
        before_device, before_ms = before["device_id"].to_numpy(object), before["ts_ms"].to_numpy(float)
        if len(own):
            before_device[0], before_ms[0] = device, np.nan if last is None else last
        # Event times in ms are whole numbers that a double holds.
        again = (before_device == own["device_id"].to_numpy(object)) & (before_ms < own["ts_ms"].to_numpy())
        missed = own[again]
        room, way = missed["device_id"].str.partition("-")[[0, 2]].to_numpy().T if len(missed) else (np.array([], object),) * 2
        half = (before_ms[again].astype(np.int64) + missed["ts_ms"].to_numpy(np.int64)) // 2
        put = pd.DataFrame({"event_id": missed["event_id"], "inserted": True, "ts_ms": half, "device_id": [f"{r}-{'out' if w == 'in' else 'in'}" for r, w in zip(room, way)]})
        if len(own):
            state.update((str(own["device_id"].iloc[-1]), int(own["ts_ms"].iloc[-1])))
        for part in (put, rows.assign(inserted=False)):
            if len(part):
                yield part.assign(user_id=key[0])[["event_id", "user_id", "inserted", "ts_ms", "device_id"]]

    known = events.where(F.col("user_id").isNotNull() & F.col("ts_ms").isNotNull() & F.col("device_id").isNotNull())
    return known.select("event_id", "user_id", "ts_ms", "device_id").groupBy("user_id").applyInPandasWithState(
        step, "event_id bigint, user_id string, inserted boolean, ts_ms bigint, device_id string", "device string, last bigint", "append", _timeout(idle_ms),
    )


def occupancy(events: DataFrame) -> DataFrame:
    """Count per room over a stream of complete events: room, occupancy (update mode)."""
    room = F.substring_index("device_id", "-", 1)
    change = F.when(F.col("device_id") == F.concat(room, F.lit("-in")), 1).otherwise(-1)
    return events.groupBy(room.alias("room")).agg(F.sum(change).alias("occupancy"))


class HeatMap(StatefulProcessor):
    """Per cell the first and last time of each oid, as map state; a row per cell that a batch touches. ``halt_ms``: an
    oid whose last point is older than the cell's newest by more is forgotten; ``idle_ms``: so is one that has sent
    nothing to the cell for so long by the clock."""

    def __init__(self, fn: str, halt_ms: int | None, idle_ms: int | None = None) -> None:
        self.fn, self.halt_ms, self.idle_ms = fn if fn in AGGREGATES else "ALL", halt_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "oid string", "first bigint, last bigint", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        for frame in rows:
            for oid, times in frame.groupby("oid")["ts_ms"]:
                first, last = int(times.min()), int(times.max())
                if self.spans.containsKey((oid,)):
                    a, z = self.spans.getValue((oid,))
                    first, last = min(a, first), max(z, last)
                self.spans.updateValue((oid,), (first, last))
        spans = {k[0]: v for k, v in self.spans.iterator()}
        if self.halt_ms is not None and spans:
            newest = max(v[1] for v in spans.values())
            for oid in [o for o, v in spans.items() if v[1] < newest - self.halt_ms]:
                self.spans.removeKey((oid,))
                del spans[oid]
        lengths = {o: v[1] - v[0] for o, v in spans.items()}
        n, total = len(lengths), sum(lengths.values())
        picked = lengths
        if self.fn in ("SUM", "AVG"):
            picked = {"": total if self.fn == "SUM" else int(total / n + 0.5)}
        elif self.fn in ("MIN", "MAX"):
            sign = 1 if self.fn == "MIN" else -1
            oid = min(lengths, key=lambda o: (sign * lengths[o], o))
            picked = {oid: lengths[oid]}
        out = sorted(picked.items())
        yield pd.DataFrame({"cx": [key[0]] * len(out), "cy": [key[1]] * len(out), "n_traj": [n] * len(out), "key": [k for k, _ in out], "value": [v for _, v in out]})

    def close(self) -> None:
        pass


def heat_map(points: DataFrame, fn: str, grid: Grid, halt_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """``taggregate_now`` over a stream (update mode): cx, cy, n_traj, key, value. Needs the RocksDB state store."""
    placed = usable(points).withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))}).where(grid.has(F.col("cx"), F.col("cy")))
    return placed.select("cx", "cy", "oid", "ts_ms").groupBy("cx", "cy").transformWithStateInPandas(
        HeatMap(fn, halt_ms, idle_ms), "cx int, cy int, n_traj bigint, key string, value bigint", "Update", "None" if idle_ms is None else "ProcessingTime",
    )
