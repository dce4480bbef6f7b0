"""How long objects stay in each cell, how many sensor readings cover it, and both together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.grid import Grid
from tidegrid.operators.prefix import previous
from tidegrid.operators.spatial import _cells
from tidegrid.operators.trajectories import usable
from tidegrid.operators.windowing import Windows, assign, window_columns

HOUR = 3_600_000


def cell_stay_time(points: DataFrame, grid: Grid, windows: Windows) -> DataFrame:
    """Per window and cell: stay_ms, and the cell's cx, cy.

    The time between an oid's neighbouring points in a window goes to their cell if it is the same; in equal parts to
    all cells between them if they share a row or column; else in equal parts to their cells and those of their bbox
    that the straight way meets. Points outside the grid don't count.
    """
    placed = usable(points).withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))}).where(grid.has(F.col("cx"), F.col("cy")))
    placed = assign(placed, windows)
    by = window_columns(placed)
    fields = ["ts_ms", "x", "y", "cx", "cy"]
    pairs = previous(placed, [*by, "oid"], "ts_ms", ["event_id"], fields, HOUR, "o_").where(F.col("o_ts_ms").isNotNull())
    c = F.col
    lo_x, hi_x, lo_y, hi_y = F.least("cx", "o_cx"), F.greatest("cx", "o_cx"), F.least("cy", "o_cy"), F.greatest("cy", "o_cy")
    box = grid.cells(lo_x, hi_x, lo_y, hi_y)

    def on_way(cell):  # noqa: ANN001, ANN202
        b = grid.bounds(cell["cx"], cell["cy"])
        end = ((cell["cx"] == c("cx")) & (cell["cy"] == c("cy"))) | ((cell["cx"] == c("o_cx")) & (cell["cy"] == c("o_cy")))
        return end | G.segment_meets_box(c("o_x"), c("o_y"), c("x"), c("y"), b["min_x"], b["min_y"], b["max_x"], b["max_y"])

    straight = (c("cx") == c("o_cx")) | (c("cy") == c("o_cy"))
    shares = pairs.withColumn("cells", F.when(straight, box).otherwise(F.filter(grid.cells_along(c("o_x"), c("o_y"), c("x"), c("y")), on_way)))
    shares = shares.withColumn("share", (c("ts_ms") - c("o_ts_ms")) / F.size("cells"))
    # Never empty; a plain explode would have the engine test that first, by making each list twice.
    return shares.select(*by, "share", F.explode_outer("cells").alias("cell")).groupBy(*by, c("cell.cx").alias("cx"), c("cell.cy").alias("cy")).agg(F.sum("share").alias("stay_ms"))


def cell_sensor_count(polygons: DataFrame, grid: Grid, windows: Windows) -> DataFrame:
    """Per window and cell: n_ts, the number of distinct times of polygons that meet the cell."""
    shaped = assign(G.with_shape(polygons.where(F.col("ts_ms").isNotNull()), "pg"), windows)
    by = window_columns(shaped)
    cells = _cells(shaped.select(*by, "ts_ms", "segs", "box"), grid, 0, "")
    b = grid.bounds(F.col("cx"), F.col("cy"))
    met = cells.where(G.polygon_meets_box(F.col("segs"), b["min_x"], b["min_y"], b["max_x"], b["max_y"]))
    return met.groupBy(*by, "cx", "cy").agg(F.count_distinct("ts_ms").alias("n_ts"))


def normalized_stay_time(points: DataFrame, polygons: DataFrame, grid: Grid, windows: Windows) -> DataFrame:
    """Per window and cell that has both: ``value``, the seconds of stay by sensor readings, times the window's seconds."""
    stay, sensors = cell_stay_time(points, grid, windows), cell_sensor_count(polygons, grid, windows)
    by = [c for c in stay.columns if c != "stay_ms"]
    value = (F.col("stay_ms") / 1000) / F.col("n_ts") * F.lit(windows.size / 1000)
    return stay.join(sensors, by).select(*by, value.alias("value"))
