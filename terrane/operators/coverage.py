"""Covered fraction of grid cells by polygons, as joins and groupings only.

A polygon's edges are cut at the rows and columns of the grid. By Green's
theorem each piece adds a part of its own cell and a strip to every cell left
of it in the row, so the fraction of a cell is its own parts plus the sum of
the strips to its right. Work follows the length of the boundary; the inside
of a zone is a run per row until it is written out as cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import edges

_NOTHING = 1e-12


class Grid:
    """Regular lon/lat grid: `lon0, lat0` is the lower left corner of cell (0, 0)."""

    def __init__(self, lon0: float, lat0: float, dx: float, dy: float):
        self.lon0, self.lat0, self.dx, self.dy = float(lon0), float(lat0), abs(float(dx)), abs(float(dy))

    @property
    def cell_area(self) -> float:
        return self.dx * self.dy

    def coarser(self, times: int) -> Grid:
        """The grid with cells 2^times as wide and high, from the same corner."""
        return Grid(self.lon0, self.lat0, self.dx * (1 << times), self.dy * (1 << times))

    def u(self, lon: Column) -> Column:
        return (lon - F.lit(self.lon0)) / F.lit(self.dx)

    def v(self, lat: Column) -> Column:
        return (lat - F.lit(self.lat0)) / F.lit(self.dy)

    def column(self, lon: Column) -> Column:
        return F.floor(self.u(lon)).cast("int")

    def row(self, lat: Column) -> Column:
        return F.floor(self.v(lat)).cast("int")


def _span(low: Column, high: Column) -> Column:
    """Unit intervals [k, k+1) met by [low, high]; a degenerate one meets its own."""
    first = F.floor(low)
    last = F.greatest(first, F.ceil(high) - 1)
    return F.explode(F.sequence(first, last))


def row_pieces(zones: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Edges cut at the grid rows: `keys, j, x1..y2` (whole edge) and `ua, ub, dv` (the piece)."""
    e = F.col("e")
    ends = zones.select(*keys, F.explode(edges(F.col("geometry"))).alias("e")).select(
        *keys, "e.x1", "e.y1", "e.x2", "e.y2",
        grid.u(e["x1"]).alias("u1"), grid.v(e["y1"]).alias("v1"),
        grid.u(e["x2"]).alias("u2"), grid.v(e["y2"]).alias("v2"),
    ).where("x1 <> x2 or y1 <> y2")
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    cut = ends.select("*", _span(low, high).alias("j"))
    a, b = F.greatest(low, F.col("j").cast("double")), F.least(high, (F.col("j") + 1).cast("double"))
    flat = F.col("v1") == F.col("v2")

    def u_at(v: Column) -> Column:
        slope = (F.col("u2") - F.col("u1")) / F.nullif(F.col("v2") - F.col("v1"), F.lit(0.0))
        return F.when(v == F.col("v1"), F.col("u1")).when(v == F.col("v2"), F.col("u2")).otherwise(
            F.col("u1") + (v - F.col("v1")) * slope)

    return cut.select(
        *keys, F.col("j").cast("int").alias("j"), "x1", "y1", "x2", "y2",
        F.when(flat, F.col("u1")).otherwise(u_at(a)).alias("ua"),
        F.when(flat, F.col("u2")).otherwise(u_at(b)).alias("ub"),
        F.when(flat, 0.0).otherwise((b - a) * F.signum(F.col("v2") - F.col("v1"))).alias("dv"),
    )


def coverage_runs(zones: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Runs `keys, j, i_from, i_to, fraction, touched` of cells met by each zone."""
    low, high = F.least("ua", "ub"), F.greatest("ua", "ub")
    cut = row_pieces(zones, grid, keys).select("*", _span(low, high).alias("i"))
    lo = F.greatest(low, F.col("i").cast("double"))
    hi = F.least(high, (F.col("i") + 1).cast("double"))
    share = F.when(high > low, (hi - lo) / (high - low)).otherwise(1.0)
    strip = F.col("dv") * share
    touched = cut.select(*keys, "j", F.col("i").cast("int").alias("i"), strip.alias("strip"),
                         (strip * ((lo + hi) / 2 - F.col("i"))).alias("part"))
    cells = touched.groupBy(*keys, "j", "i").agg(F.sum("part").alias("part"), F.sum("strip").alias("strip"))
    # One partition per zone and row: as many rows as boundary cells in it.
    from_right = Window.partitionBy(*keys, "j").orderBy(F.col("i").desc())
    right = F.coalesce(F.sum("strip").over(from_right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    swept = cells.select("*", right.alias("right"), F.lead("i").over(from_right).alias("left_i"))
    own = F.struct(
        F.col("i").alias("i_from"), F.col("i").alias("i_to"),
        F.least(F.greatest(F.col("part") + F.col("right"), F.lit(0.0)), F.lit(1.0)).alias("fraction"),
        F.lit(True).alias("touched"))
    # Between two boundary cells of a row the fraction is 0 or 1.
    inner = F.struct(
        (F.col("left_i") + 1).alias("i_from"), (F.col("i") - 1).alias("i_to"), F.lit(1.0).alias("fraction"),
        F.lit(False).alias("touched"))
    gap = (F.col("left_i") + 1 <= F.col("i") - 1) & (F.col("right") + F.col("strip") > 0.5)
    runs = swept.select(*keys, "j", F.explode(F.when(gap, F.array(own, inner)).otherwise(F.array(own))).alias("r"))
    return runs.select(*keys, "j", "r.*")


def grid_coverage(zones: DataFrame, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """`keys, i, j, fraction` of every cell with a covered part."""
    keys = keys or ["geo_code"]
    runs = coverage_runs(zones, grid, keys).where(F.col("fraction") > _NOTHING)
    return runs.select(*keys, F.explode(F.sequence("i_from", "i_to")).alias("i"), "j", "fraction")
