"""Points of interest and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import bbox, bbox_intersects, centroid, polygon_area
from ..functions.zones import zone_country
from ..operators.poi import (
    any_tag, as_points, exportable, extract_country, match_specs, points_in_zones, tag_expressions, tag_pairs,
)
from ..plans.spatial import count_poi, write_poi_counts
from ..schemas import SPECS
from ..session import shared_dir
from ..sources.canonical import read_canonical
from ..sources.files import read_poi, write_poi
from .base import query, table, view
from .shapes import POI_GRID, poi, poi_specs, zone_shapes
from .zone_queries import part_specs

view("poi_hit", "poi_match", "zedge", sql="""
SELECT indicator, osm_id, c1 FROM (
  SELECT indicator, osm_id, z.c1,
         sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) AS crossings,
         bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                 AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
  FROM poi_match JOIN zedge z ON z.c0 = country GROUP BY indicator, osm_id, z.c1)
WHERE crossings % 2 = 1 AND NOT on_edge
""")
_COUNTS = """
SELECT s.indicator, c1 AS geo_code, 'NUTS1' AS level, '2001-08' AS time, CAST(coalesce(n, 0) AS DOUBLE) AS value,
       'osm_completeness_unknown' AS quality, 'extract 2001-08' AS source_date
FROM (SELECT DISTINCT c1 FROM zedge) z CROSS JOIN (VALUES ('machinery_sites'), ('home_sites'), ('building_nodes')) s(indicator)
LEFT JOIN (SELECT indicator, c1, count(*) AS n FROM poi_hit GROUP BY ALL) h USING (indicator, c1)"""


def extracts(spark, sf):
    """One extract per region; the newest month is that of the last region."""
    return table(spark, sf, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("extract"), F.concat(F.lit("R"), "r_regionkey").alias("country"),
        F.concat(F.lit("2001-0"), F.col("r_regionkey") + 4).alias("month"))


@query("poi_zone_count", "poi_hit", "zedge", sql=_COUNTS)
def poi_zone_count(spark, sf):
    return count_poi(poi(spark, sf), extracts(spark, sf), zone_shapes(spark, sf), poi_specs(spark), POI_GRID)


@query("poi_partitions_at_rest", "poi_hit", "zedge", sql="SELECT indicator, geo_code, time, value, quality, 'COUNT' AS unit, 'osm' AS source FROM (" + _COUNTS + ")")
def poi_at_rest(spark, sf):
    """Matched points to their store, counts from the store, counts into canonical partitions."""
    root = shared_dir(spark, "poi")
    write_poi(poi(spark, sf), f"{root}/poi")
    counts = count_poi(read_poi(spark, f"{root}/poi"), extracts(spark, sf), zone_shapes(spark, sf), poi_specs(spark), POI_GRID)
    write_poi_counts(counts, poi_specs(spark), f"{root}/canonical")
    return read_canonical(spark, f"{root}/canonical").select("indicator", "geo_code", "time", "value", "quality", "unit", "source")


@query("points_in_any_country", "poi", "zedge", sql="""
SELECT osm_id, c1 AS geo_code FROM (
  SELECT osm_id, z.c1, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) AS crossings,
         bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge
  FROM poi CROSS JOIN zedge z GROUP BY osm_id, z.c1) WHERE crossings % 2 = 1 AND NOT on_edge""")
def points_in_any_country(spark, sf):
    points = as_points(poi(spark, sf)).select("osm_id", "lon", "lat")
    return points_in_zones(points, zone_shapes(spark, sf), POI_GRID, same_country=False).select("osm_id", "geo_code")


@query("tag_filter_any", "poi", sql="SELECT osm_id, amenity FROM poi WHERE amenity IN ('building', 'machinery') AND osm_type IN ('node', 'relation')")
def tag_filter_any(spark, sf):
    pairs = [("amenity", "building"), ("office", "yes"), ("amenity", "machinery")]
    return poi(spark, sf).where(any_tag(F.col("tags"), pairs) & exportable(F.col("osm_type"), F.col("geom_type"), ["node", "relation"])).select(
        "osm_id", F.col("tags")["amenity"].alias("amenity"))


@query("tag_match_specs", "poi_match", sql="SELECT indicator, osm_id FROM poi_match")
def tag_match_specs(spark, sf):
    return match_specs(poi(spark, sf), poi_specs(spark)).select("indicator", "osm_id")


@query("tag_match_many_specs", "poi", sql="""
SELECT 'sites_' || p_partkey AS indicator, osm_id FROM poi JOIN part ON p_partkey IN (osm_id, osm_id // 2 * 2) AND (osm_type = 'node' OR p_size % 2 = 0)""")
def tag_match_many_specs(spark, sf):
    """A spec for each part, looked up by tags of which an element may carry two of one spec."""
    size, named = F.col("p_size"), lambda c: F.concat(F.lit("n"), c)
    elements = poi(spark, sf).withColumn("tags", F.map_concat("tags", F.create_map(
        F.lit("ref"), named(F.col("osm_id")), F.lit("operator"), named(F.floor(F.col("osm_id") / 2) * 2))))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in SPECS["extraction"].dataType}
    tag = lambda key: F.struct(F.lit(key).alias("key"), named(F.col("p_partkey")).alias("value"))
    filled = nothing | {"tags": F.array(tag("ref"), tag("operator")), "geometry": F.when(size % 2 == 0, F.array(F.lit("node"), F.lit("way"))).otherwise(F.array(F.lit("node")))}
    many = table(spark, sf, "part").select(F.concat(F.lit("sites_"), "p_partkey").alias("id"), F.struct(*[c.alias(n) for n, c in filled.items()]).alias("extraction"))
    return match_specs(elements, many, placed=True).select("indicator", "osm_id")


@query("tag_pairs_distinct", sql="SELECT DISTINCT 'amenity' AS key, lower(p_type) AS value FROM part WHERE p_type = 'ECONOMY' AND p_size % 2 <> 0")
def tag_pairs_distinct(spark, sf):
    return tag_pairs(part_specs(spark, sf))


@query("tag_expressions", sql="SELECT DISTINCT 'node' AS osm_type, 'amenity' AS key, lower(p_type) AS value FROM part WHERE p_type = 'ECONOMY' AND p_size % 2 <> 0")
def tag_expression_query(spark, sf):
    return tag_expressions(part_specs(spark, sf))


@query("poi_points", "poi", sql="SELECT osm_id, osm_type, round(lon, 6) AS lon, round(lat, 6) AS lat FROM poi")
def poi_points(spark, sf):
    return as_points(poi(spark, sf)).select("osm_id", "osm_type", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("extract_countries", sql="""
SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'EL' WHEN 1 THEN 'UK' WHEN 2 THEN 'LU' END AS country FROM supplier""")
def extract_countries(spark, sf):
    name = F.element_at(F.array(*[F.lit(f"europe/{n}") for n in ("greece", "united-kingdom", "luxembourg", "atlantis")]), F.col("s_nationkey") % 4 + 1)
    return table(spark, sf, "supplier").select("s_suppkey", extract_country(name).alias("country"))


# -------------------------------------------------------------------- polygons

@query("polygon_area", "zarea", sql="SELECT c1 AS geo_code, area FROM zarea")
def areas(spark, sf):
    return zone_shapes(spark, sf).select("geo_code", polygon_area(F.col("geometry")).alias("area"))


@query("polygon_bbox", "zedge", sql="SELECT c1 AS geo_code, min(x1) AS west, min(y1) AS south, max(x1) AS east, max(y1) AS north FROM zedge GROUP BY c1")
def boxes(spark, sf):
    return zone_shapes(spark, sf).select("geo_code", bbox(F.col("geometry")).alias("b")).select("geo_code", "b.*")


@query("polygon_centroid", "zedge", sql="""
WITH o AS (SELECT c1, ring, CASE WHEN (sum(x1 * y2 - x2 * y1) > 0) = (ring = 0) THEN 1 ELSE -1 END AS s FROM zedge GROUP BY c1, ring)
SELECT c1 AS geo_code, round(sum(s * (x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(s * (x1 * y2 - x2 * y1))), 6) AS x,
       round(sum(s * (y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(s * (x1 * y2 - x2 * y1))), 6) AS y
FROM zedge JOIN o USING (c1, ring) GROUP BY c1""".replace("WITH o AS", "SELECT * FROM (WITH o AS") + ")")
def centroids(spark, sf):
    return zone_shapes(spark, sf).select("geo_code", centroid(F.col("geometry")).alias("c")).select(
        "geo_code", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("zone_scope", "zedge", sql="""
SELECT c1 AS geo_code FROM (SELECT c1, c0, min(x1) AS w, min(y1) AS s, max(x1) AS e, max(y1) AS n FROM zedge GROUP BY c1, c0)
WHERE c0 IN ('R1', 'R2') AND NOT (e < -2 OR w > 10 OR n < 45 OR s > 60)""")
def zone_scope(spark, sf):
    shapes = zone_shapes(spark, sf).where(zone_country(F.col("geo_code")).isin("R1", "R2"))
    return shapes.where(bbox_intersects(bbox(F.col("geometry")), -2.0, 45.0, 10.0, 60.0)).select("geo_code")
