"""The uniform grid: cells of a square raster as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """``n`` by ``n`` cells of side ``cell`` from (min_x, min_y)."""

    min_x: float
    min_y: float
    cell: float
    n: int

    @staticmethod
    def by_count(n: int, min_x: float, max_x: float, min_y: float, max_y: float) -> Grid:
        """``n`` cells per side. The cell's side comes from x alone; so the grid is as high as it is wide."""
        if n < 1 or not max_x > min_x:
            raise ValueError("a grid needs at least one cell and a positive width")
        return Grid(min_x, min_y, (max_x - min_x) / n, n)

    @staticmethod
    def by_length(length: float, min_x: float, max_x: float, min_y: float, max_y: float) -> Grid:
        """Cells of about ``length``: the shorter axis is padded on both sides until the box is square."""
        if not length > 0:
            raise ValueError("a cell needs a positive side")
        w, h = max_x - min_x, max_y - min_y
        pad = abs(w - h) / 2
        if w > h:
            min_y = min_y - pad
        else:
            min_x = min_x - pad
        side = max(w, h)
        n = max(1, ceil(side / length))
        return Grid(min_x, min_y, side / n, n)

    def cx(self, x: Column) -> Column:
        """Column index; null where ``x`` is null, NaN or too far off to be a place."""
        return F.floor((F.when(F.abs(x) < 1e6, x) - F.lit(self.min_x)) / F.lit(self.cell)).try_cast("int")

    def cy(self, y: Column) -> Column:
        return F.floor((F.when(F.abs(y) < 1e6, y) - F.lit(self.min_y)) / F.lit(self.cell)).try_cast("int")

    def has(self, cx: Column, cy: Column) -> Column:
        return cx.between(0, self.n - 1) & cy.between(0, self.n - 1)

    def contains(self, x: Column, y: Column) -> Column:
        """Whether a point's cell is one of the grid's. Points on the upper borders lie outside."""
        return self.has(self.cx(x), self.cy(y))

    def cell_id(self, x: Column, y: Column) -> Column:
        return self.id_of(self.cx(x), self.cy(y))

    @staticmethod
    def id_of(cx: Column, cy: Column) -> Column:
        return F.format_string("%05d%05d", cx, cy)

    @staticmethod
    def indices(cell_id: Column) -> tuple[Column, Column]:
        return F.substring(cell_id, 1, 5).try_cast("int"), F.substring(cell_id, 6, 10).try_cast("int")

    def index(self, x: float, y: float) -> tuple[int, int]:
        return floor((x - self.min_x) / self.cell), floor((y - self.min_y) / self.cell)

    def candidate_layers(self, r: float) -> int:
        """Layers of cells round an object's own that can hold something within ``r``."""
        return ceil(r / self.cell)

    def guaranteed_layers(self, r: float) -> int:
        """Layers whose points are all within ``r`` of a point in the middle cell; below 0: not even its own cell's."""
        return floor(r / (self.cell * sqrt(2)) - 1)

    def bounds(self, cx: Column, cy: Column) -> dict[str, Column]:
        """Corners of a cell."""
        x, y = F.lit(self.min_x) + cx * F.lit(self.cell), F.lit(self.min_y) + cy * F.lit(self.cell)
        return {"min_x": x, "min_y": y, "max_x": x + F.lit(self.cell), "max_y": y + F.lit(self.cell)}

    @staticmethod
    def layer(cx: Column, cy: Column, qx: Column, qy: Column) -> Column:
        """How many layers lie between two cells (0: the same)."""
        return F.greatest(F.abs(cx - qx), F.abs(cy - qy))

    def near_box(self, box: Column, r: float) -> dict[str, Column]:
        """Cell ranges that can hold something within ``r`` of a bbox, clipped to the grid."""
        k = self.candidate_layers(r)
        lo, hi = F.lit(0), F.lit(self.n - 1)
        return {
            "lo_x": F.greatest(self.cx(box["minx"]) - k, lo), "hi_x": F.least(self.cx(box["maxx"]) + k, hi),
            "lo_y": F.greatest(self.cy(box["miny"]) - k, lo), "hi_y": F.least(self.cy(box["maxy"]) + k, hi),
        }

    def reach_box(self, box: Column, r: float) -> dict[str, Column]:
        """The cells, clipped to the grid, that a bbox widened by ``r`` meets: what is within ``r`` of it lies in them."""
        m = F.lit(r * (1 + 1e-9) + 1e-12 if r > 0 else 0.0)
        lo, hi = F.lit(0), F.lit(self.n - 1)
        return {
            "lo_x": F.greatest(self.cx(box["minx"] - m), lo), "hi_x": F.least(self.cx(box["maxx"] + m), hi),
            "lo_y": F.greatest(self.cy(box["miny"] - m), lo), "hi_y": F.least(self.cy(box["maxy"] + m), hi),
        }

    def cells(self, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column) -> Column:
        """All cells of an index rectangle, as array<struct<cx, cy>>; empty where a range is."""
        some = (lo_x <= hi_x) & (lo_y <= hi_y)
        xs, ys = F.sequence(F.when(some, lo_x), F.when(some, hi_x)), F.sequence(F.when(some, lo_y), F.when(some, hi_y))
        return F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: F.struct(a.alias("cx"), b.alias("cy")))))

    def cells_along(self, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        """Cells near a segment within its bbox's cells: column by column those of its stretch there and one more on
        either side, which holds all that it meets; as array<struct<cx, cy>>."""
        lo_x, hi_x, lo_y, hi_y = F.least(self.cx(ax), self.cx(bx)), F.greatest(self.cx(ax), self.cx(bx)), F.least(self.cy(ay), self.cy(by)), F.greatest(self.cy(ay), self.cy(by))
        slope = F.coalesce(F.try_divide(by - ay, bx - ax), F.lit(0.0))

        def column(cx: Column) -> Column:
            left = F.lit(self.min_x) + cx * F.lit(self.cell)
            at = lambda x: ay + (F.greatest(F.least(ax, bx), F.least(F.greatest(ax, bx), x)) - ax) * slope
            y0, y1 = at(left), at(left + F.lit(self.cell))
            lo, hi = F.greatest(self.cy(F.least(y0, y1)) - 1, lo_y), F.least(self.cy(F.greatest(y0, y1)) + 1, hi_y)
            return F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

        return F.flatten(F.transform(F.sequence(lo_x, hi_x), column))


#: The grid of the test tables.
BEIJING = Grid.by_count(100, 115.5, 117.6, 39.6, 41.1)
