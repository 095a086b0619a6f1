"""Stores and files written from the given tables and read again: features, catalogue, raster, older partitions, extracts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..operators.poi import EU27, EXTRACT_COUNTRY, extract_table, requested_extracts
from ..plans.cubes import project_only
from ..plans.lookup import build_zone_reference
from ..schemas import CATALOGUE
from ..session import shared_dir
from ..sources.canonical import read_canonical, write_canonical
from ..sources.cubes import write_cube
from ..sources.files import catalogue_from_lines, read_features, read_raster, replace_catalogue
from .base import query, table
from .cube_queries import toc_lines
from .shapes import RASTER_GRID, canonical, cube, customers, nations, raster, specs, zone_shapes, zones


def write_features(features, path, by):
    """GeoJSON files, one document for each value of `by`: a country's features, of which there are a few hundred."""
    row = F.struct(F.lit("Feature").alias("type"), "properties", "geometry")
    docs = features.groupBy(by).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(row).alias("features"))).alias("value"))
    docs.write.partitionBy(by).text(path)


def rings(geometry):
    """Coordinates of a polygon as GeoJSON has them."""
    return F.transform(geometry, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))


@query("zone_reference_from_files", "nat", "cust", "zarea", sql="""
SELECT c1 AS geo_code, 'NUTS1' AS level, n_name AS name, c0 AS parent_code, c0 AS country, round(area, 6) AS area FROM nat JOIN zarea USING (c1)
UNION ALL SELECT DISTINCT c3 || 'C', 'CITY', 'Town ' || c3, c3, c0, NULL FROM cust""")
def zone_reference_from_files(spark, sf):
    """Features of two levels to GeoJSON files, from there to the zone table and the areas."""
    root = shared_dir(spark, "features")
    shapes = zone_shapes(spark, sf).join(nations(spark, sf).select(F.col("c1").alias("geo_code"), "c0", "n_name"), "geo_code")
    nuts = shapes.select("c0", F.create_map(F.lit("NUTS_ID"), "geo_code", F.lit("NAME_LATN"), "n_name", F.lit("CNTR_CODE"), "c0").alias("properties"),
                         F.struct(F.lit("Polygon").alias("type"), rings(F.get("geometry", F.lit(0))).alias("coordinates")).alias("geometry"))
    towns = customers(spark, sf).select("c0", "c3").distinct().select(
        "c0", F.create_map(F.lit("URAU_CODE"), F.concat("c3", F.lit("C")), F.lit("URAU_NAME"), F.concat(F.lit("Town "), "c3"), F.lit("NUTS3_2021"), "c3",
                           F.lit("CNTR_CODE"), "c0").alias("properties"), F.lit(None).cast("struct<type:string,coordinates:array<array<array<double>>>>").alias("geometry"))
    write_features(nuts, f"{root}/nuts1", "c0")
    write_features(towns, f"{root}/towns", "c0")
    read = read_features(spark, f"{root}/nuts1")
    reference = build_zone_reference({"NUTS1": read}, read_features(spark, f"{root}/towns"))
    areas = read.select(F.col("properties")["NUTS_ID"].alias("geo_code"), F.round(polygon_area(F.col("geometry")), 6).alias("area"))
    return reference.join(areas, "geo_code", "left").select("geo_code", "level", "name", "parent_code", "country", "area")


@query("catalogue_replaced", "toc", sql="""
SELECT code, title, data_start, data_end, last_update FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM toc WHERE type IN ('dataset', 'table')) WHERE rn = 1""")
def catalogue_replaced(spark, sf):
    """A catalogue at rest that is replaced as a whole: nothing of the one before stays."""
    root = shared_dir(spark, "catalogue")
    full = catalogue_from_lines(toc_lines(spark, sf))
    replace_catalogue(full.withColumn("code", F.concat(F.lit("old_"), "code")), root)
    replace_catalogue(full, root)
    return spark.read.schema(CATALOGUE).parquet(root)


@query("raster_at_rest", "raster", sql="SELECT i, j, count(*) AS n, sum(value) AS total FROM raster GROUP BY i, j")
def raster_at_rest(spark, sf):
    """A raster with longitudes from 0 to 360 and a second product, written and read back for one of them."""
    root = shared_dir(spark, "raster")
    rows = raster(spark, sf)
    east = rows.withColumn("lon", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")))
    east.unionByName(east.withColumn("product", F.lit("other"))).write.partitionBy("product").parquet(root)
    read = read_raster(spark, root, "reanalysis-orders", "quantity")
    return read.groupBy(RASTER_GRID.column(F.col("lon")).alias("i"), RASTER_GRID.row(F.col("lat")).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.nanvl("value", F.lit(None).cast("double"))).alias("total"))


@query("canonical_older_partition", "canon", sql="""
SELECT indicator, geo_code, time, value, CASE indicator WHEN 'order_value' THEN NULL ELSE quality END AS quality, unit FROM canon
WHERE indicator IN ('order_value', 'order_count')""")
def canonical_older_partition(spark, sf):
    """A partition that an older release wrote without a quality and with a note reads together with a current one."""
    root = shared_dir(spark, "canonical")
    rows = canonical(spark, sf).withColumn("ingested_at", F.lit(datetime(2001, 9, 1)).cast("timestamp_ntz"))
    write_canonical(rows, root, ["order_count"])
    rows.where("indicator = 'order_value'").drop("quality", "indicator").withColumn("note", F.lit("as of 2000")).write.parquet(f"{root}/indicator=order_value")
    return read_canonical(spark, root).select("indicator", "geo_code", "time", "value", "quality", "unit")


_EXTRACTS = ", ".join(f"('europe/{name}', '{country}', {pos})" for pos, (name, country) in enumerate(EXTRACT_COUNTRY.items()))
_UNION = ", ".join(f"'{c}'" for c in EU27)


@query("requested_extracts", sql=f"""
WITH e AS (SELECT * FROM (VALUES {_EXTRACTS}) e(extract, country, pos)),
a AS (SELECT n_nationkey AS place, ['EU27', 'europe', 'asia/' || lower(n_name), 'europe/norway', 'atlantis', ' ', 'europe/malta'][CAST((n_nationkey * 3 + 3) % 7 + 1 AS INT)] AS item FROM nation),
r AS (
  SELECT place, 0 AS pos, item AS extract, NULL AS problem FROM a WHERE contains(item, '/')
  UNION ALL SELECT place, pos, extract, NULL FROM a, e WHERE lower(item) = 'eu27' AND country IN ({_UNION})
  UNION ALL SELECT place, pos, extract, NULL FROM a, e WHERE lower(item) = 'europe' AND country IN ('NO', 'IS', 'AL')
  UNION ALL SELECT place, 0, item, 'unknown_extract' FROM a WHERE item = 'atlantis')
SELECT extract, problem, CAST(row_number() OVER (ORDER BY min((place, pos)), extract) AS BIGINT) AS turn FROM r GROUP BY extract, problem""")
def extracts_requested(spark, sf):
    """Keywords, extracts by name and unknown ones, in the order of first mention."""
    items = F.array(F.lit("EU27"), F.lit("europe"), F.concat(F.lit("asia/"), F.lower("n_name")), F.lit("europe/norway"), F.lit("atlantis"), F.lit(" "), F.lit("europe/malta"))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.get(items, (F.col("n_nationkey") * 3 + 3) % 7).alias("item"))
    known = spark.createDataFrame([("NO",), ("IS",), ("AL",)], "country string")
    found = requested_extracts(asked, extract_table(spark), known).coalesce(1)
    return found.select("extract", "problem", (F.monotonically_increasing_id() + 1).alias("turn"))


@query("project_only", "canon", sql="SELECT indicator, geo_code, time, value, quality, unit FROM canon WHERE source = 'eurostat'")
def project_again(spark, sf):
    """All cube specs from the native store, without looking at any file that landed."""
    root = shared_dir(spark, "store")
    write_cube(cube(spark, sf), f"{root}/native")
    project_only(spark, f"{root}/native", specs(spark).where("source = 'eurostat'"), zones(spark, sf), None, f"{root}/canonical")
    return read_canonical(spark, f"{root}/canonical").select("indicator", "geo_code", "time", "value", "quality", "unit")
