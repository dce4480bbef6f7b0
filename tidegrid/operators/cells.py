"""Cells as a key: filters, replication of shapes to cells, and query shapes made from the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import geometry as G
from tidegrid.grid import Grid
from tidegrid.operators.spatial import _cells


def in_cells(df: DataFrame, cells: DataFrame, grid: Grid, kind: str = "pt") -> DataFrame:
    """Rows whose shape lies in (points) or reaches into (by bbox) one of ``cells`` (cx, cy), each once."""
    keys = cells.select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"))
    if kind == "pt":
        placed = df.withColumns({"cx": grid.cx(F.col("x")), "cy": grid.cy(F.col("y"))})
        return placed.join(keys, (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")), "left_semi").select(*df.columns)
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    hits = replicate(numbered, grid, kind).join(keys, (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")), "left_semi")
    return hits.dropDuplicates(["__row"]).select(*df.columns)


def replicate(df: DataFrame, grid: Grid, kind: str, r: float = 0.0, oid: str | None = None) -> DataFrame:
    """``df`` once for each cell (cx, cy) within ``r`` of its shape's bbox. With ``oid``, a column of that name is
    filled where it is missing, so a shape's copies can be told to belong together. All columns stay, times too."""
    if oid is not None:
        made = F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))
        df = df.withColumn(oid, F.coalesce(F.col(oid), made) if oid in df.columns else made)
    shaped = G.with_shape(df, kind)
    if kind == "pt":
        shaped = shaped.drop("segs")
    return _cells(shaped, grid, r, "").drop("lo_x", "lo_y", *({"segs", "box"} - set(df.columns)))


def cells_within(grid: Grid, x: float, y: float, r: float, spark: SparkSession) -> DataFrame:
    """Cells that can hold something within ``r`` of a place: cx, cy, layer, guaranteed (all its points are)."""
    (qx, qy), k, g = grid.index(x, y), grid.candidate_layers(r), grid.guaranteed_layers(r)
    side = lambda q: F.explode(F.sequence(F.lit(max(q - k, 0)), F.lit(min(q + k, grid.n - 1))))
    if max(qx - k, 0) > min(qx + k, grid.n - 1) or max(qy - k, 0) > min(qy + k, grid.n - 1):
        return spark.createDataFrame([], "cx int, cy int, layer int, guaranteed boolean")
    rows = spark.range(1).select(side(qx).alias("cx")).withColumn("cy", side(qy))
    layer = grid.layer(F.col("cx"), F.col("cy"), F.lit(qx), F.lit(qy))
    return rows.withColumn("layer", layer).withColumn("guaranteed", layer <= g)


def layer_cells(grid: Grid, x: float, y: float, layer: int, spark: SparkSession) -> DataFrame:
    """The ring of cells exactly ``layer`` cells away."""
    return cells_within(grid, x, y, layer * grid.cell, spark).where(F.col("layer") == layer).select("cx", "cy")


def query_polygons(spark: SparkSession, min_x: float, max_x: float, min_y: float, max_y: float, n: int, per_side: int = 100) -> DataFrame:
    """The first ``n`` squares of side ``min(width, height) / per_side`` that tile a box column by column: qid, rings."""
    side = min(max_x - min_x, max_y - min_y) / per_side
    rows = max(1, round((max_y - min_y) / side))
    i = F.col("id")
    x, y = F.lit(min_x) + F.floor(i / rows) * F.lit(side), F.lit(min_y) + F.pmod(i, F.lit(rows)) * F.lit(side)
    corner = lambda a, b: F.struct((x + F.lit(a * side)).alias("x"), (y + F.lit(b * side)).alias("y"))
    ring = F.array(*(corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return spark.range(n).select(i.cast("string").alias("qid"), F.array(ring).alias("rings"))


def query_points(spark: SparkSession, min_x: float, max_x: float, min_y: float, max_y: float, n: int, seed: int = 7) -> DataFrame:
    """``n`` points spread evenly at random over a box, the same for the same seed: qid, x, y."""
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return spark.range(n).select(F.col("id").cast("string").alias("qid"), (F.lit(min_x) + u(0) * (max_x - min_x)).alias("x"), (F.lit(min_y) + u(1) * (max_y - min_y)).alias("y"))


def stop_on_control(df: DataFrame, type_column: str, control: str = "control") -> DataFrame:
    """``df``, which fails as soon as a row of the control type comes: a stream's way to be ended by its input."""
    return df.withColumn(type_column, F.when(F.col(type_column) == control, F.raise_error(F.lit("control row"))).otherwise(F.col(type_column)))
