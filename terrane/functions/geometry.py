"""Planar geometry on arrays: polygon -> ring -> point `(x, y)`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def _edges_of_ring(ring: Column) -> Column:
    """Consecutive point pairs; an open ring is closed."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring, following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def signed_ring_area(ring: Column) -> Column:
    """Positive for a counter-clockwise ring; 0 below three points."""
    total = F.aggregate(_edges_of_ring(ring), _zero(), lambda acc, e: acc + _cross(e))
    return F.when(F.size(ring) < 3, 0.0).otherwise(total / 2)


def polygon_area(geometry: Column) -> Column:
    """Square units, holes taken off, never negative."""

    def one(polygon: Column) -> Column:
        return F.aggregate(
            F.transform(polygon, lambda ring, i: F.abs(signed_ring_area(ring)) * F.when(i == 0, 1.0).otherwise(-1.0)),
            _zero(), lambda acc, a: acc + a)

    return F.greatest(F.aggregate(F.transform(geometry, one), _zero(), lambda acc, a: acc + a), _zero())


def edges(geometry: Column) -> Column:
    """All edges, shells counter-clockwise and holes clockwise."""

    def oriented(ring: Column, index: Column) -> Column:
        right_way = (signed_ring_area(ring) >= 0) == (index == 0)
        return _edges_of_ring(F.when(right_way, ring).otherwise(F.reverse(ring)))

    return F.flatten(F.transform(geometry, lambda polygon: F.flatten(F.transform(polygon, oriented))))


def bbox(geometry: Column) -> Column:
    points = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
        F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def bbox_intersects(box: Column, west: float, south: float, east: float, north: float) -> Column:
    return ~((box["east"] < west) | (box["west"] > east) | (box["north"] < south) | (box["south"] > north))


def centroid(geometry: Column) -> Column:
    """Area-weighted centre; holes weigh negative. Null without area."""
    sums = F.aggregate(
        edges(geometry),
        F.struct(_zero().alias("a"), _zero().alias("x"), _zero().alias("y")),
        lambda acc, e: F.struct(
            (acc["a"] + _cross(e)).alias("a"),
            (acc["x"] + (e["x1"] + e["x2"]) * _cross(e)).alias("x"),
            (acc["y"] + (e["y1"] + e["y2"]) * _cross(e)).alias("y"),
        ),
    )
    return F.when(
        sums["a"] != 0,
        F.struct((sums["x"] / (3 * sums["a"])).alias("x"), (sums["y"] / (3 * sums["a"])).alias("y")),
    )


def on_an_edge(x: Column, y: Column, edge_list: Column) -> Column:
    """Whether a point lies on one of the edges."""

    def on_edge(e: Column) -> Column:
        aligned = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            aligned
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return F.exists(edge_list, on_edge)


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180; 180 itself stays."""
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def cell_bounds(lon: Column, lat: Column, dx: float, dy: float) -> Column:
    """Edges and area of the cell around a centre."""
    half_x, half_y = abs(dx) / 2, abs(dy) / 2
    return F.struct(
        (lon - half_x).alias("west"), (lat - half_y).alias("south"),
        (lon + half_x).alias("east"), (lat + half_y).alias("north"),
        F.lit(abs(dx * dy)).alias("area"),
    )


def box_geometry(west: Column, south: Column, east: Column, north: Column) -> Column:
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    ring = F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))
    return F.array(F.array(ring))


def ring_geometry(points: list[tuple[Column, Column]]) -> Column:
    """One polygon with one ring through the given points."""
    ring = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])
    return F.array(F.array(ring))
