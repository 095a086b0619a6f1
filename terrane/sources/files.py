"""Catalogue, GeoJSON, spec and state tables."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATALOGUE, GEOMETRY, POI, RASTER, SPECS, STATE

TAB = "\t"


def _unquote(cell: object) -> object:
    return F.trim(F.btrim(cell, F.lit('"')))


def catalogue_from_lines(lines: DataFrame) -> DataFrame:
    """Catalogue rows from `(place, line)`, `place` ordering the lines of the file.

    Quoted tab-separated lines; only datasets and tables stay, short lines
    drop, and the first line of a code wins.
    """
    header = F.element_at(F.split(F.lower(F.replace("line", F.lit('"'), F.lit(""))), TAB), 1) == "title"
    names = lines.where(header).select(F.min_by(F.transform(F.split(F.lower("line"), TAB), _unquote), "place")).scalar()
    cells = F.transform(F.split("line", TAB), _unquote)
    rows = lines.where(~header).select("place", cells.alias("cells"), names.alias("names"))

    def field(name: str, otherwise: int):
        at = F.array_position("names", F.lit(name)).cast("int") - 1
        return F.get("cells", F.when(at >= 0, at).otherwise(otherwise))

    wanted = rows.where(F.size("cells") >= F.size("names")).select(
        "place", field("type", 2).alias("type"), field("code", 1).alias("code"), field("title", 0).alias("title"),
        field("data start", 5).alias("data_start"), field("data end", 6).alias("data_end"),
        field("last update of data", 3).alias("last_update"),
    ).where(F.col("type").isin("dataset", "table"))
    return first_per_key(wanted, "code", "place").select(*CATALOGUE.names)


def first_per_key(df: DataFrame, key: str, place: str) -> DataFrame:
    """The first row of each key by `place`; combines on the map side."""
    others = [c for c in df.columns if c not in (key, place)]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), place).alias("r")).select(
        key, *[F.col(f"r.{c}").alias(c) for c in others])


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from its text file. A line's place is its split's offset, then its order in it."""
    text = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("line"))
    return catalogue_from_lines(text.select(place.alias("place"), F.col("value").alias("line")))


def replace_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.select(*CATALOGUE.names).write.mode("overwrite").parquet(path)


def catalogue_period(catalogue: DataFrame) -> DataFrame:
    """Start and end of a dataset when both are known."""
    known = (F.coalesce("data_start", F.lit("")) != "") & (F.coalesce("data_end", F.lit("")) != "")
    return catalogue.where(known).select("code", "data_start", "data_end")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: `properties` as a map, `geometry` as polygons.

    One row per feature. A file is one JSON document and is read by one task;
    the files of a level, vintage or country are read in parallel.
    """
    ring = "array<array<array<double>>>"
    raw = spark.read.text(path, wholetext=True)
    docs = raw.select(F.explode(F.from_json(
        F.get_json_object("value", "$.features"),
        "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")).alias("f"))
    polygon = F.array(F.from_json("f.geometry.coordinates", ring))
    multi = F.from_json("f.geometry.coordinates", f"array<{ring}>")

    def points(polygons):
        return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(
            r, lambda xy: F.struct(F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y")))))

    kind = F.col("f.geometry.type")
    return docs.select(
        F.col("f.properties").alias("properties"),
        F.when(kind == "Polygon", points(polygon)).when(kind == "MultiPolygon", points(multi)).cast(GEOMETRY).alias("geometry"))


def load_specs(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """Spec table from a folder of YAML or JSON files (configuration, a few hundred at most).

    Adds `file`, the file name without its ending, for validation.
    """
    rows = []
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml")) + glob.glob(os.path.join(folder, "*.json"))):
        with open(path, encoding="utf-8") as handle:
            if path.endswith(".json"):
                payload = json.load(handle)
            else:
                try:
                    import yaml
                except ImportError as exc:
                    raise RuntimeError("YAML specs need PyYAML; JSON specs work without it") from exc
                payload = yaml.safe_load(handle)
        rows.append({**(payload or {}), "file": os.path.splitext(os.path.basename(path))[0]})
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")
    flat = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SPECS) + ", file string"
    specs = text.select(F.from_json("json", flat).alias("s"), "json").select(
        "s.*", F.array_sort(F.array_except(F.json_object_keys("json"), F.array(
            *[F.lit(n) for n in [*SPECS.names, "file"]]))).alias("extra_fields"))
    return specs if source is None else specs.where(F.col("source") == source)


def upsert_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """The latest value per source and key; a later `updated_at` wins."""
    both = state.select(*STATE.names).unionByName(new.select(*STATE.names))
    return both.groupBy("source", "key").agg(
        F.max_by("value", F.struct("updated_at", F.coalesce("value", F.lit("")))).alias("value"),
        F.max("updated_at").alias("updated_at"))


def read_state(state: DataFrame, source: str) -> DataFrame:
    return state.where(F.col("source") == source).select("key", "value")


def write_poi(points: DataFrame, root: str) -> None:
    """Replace the extracts present in `points`; a large extract is spread over tasks."""
    points.hint("rebalance", "extract").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("extract").parquet(root)


def read_poi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POI).parquet(path)


def read_raster(spark: SparkSession, path: str, product: str = "", variable: str = "") -> DataFrame:
    """Long raster rows, longitudes in -180..180."""
    from ..functions.geometry import wrap_longitude

    df = spark.read.schema(RASTER).parquet(path)
    if product:
        df = df.where(F.col("product") == product)
    if variable:
        df = df.where(F.col("variable") == variable)
    return df.withColumn("lon", wrap_longitude(F.col("lon")))
