"""Point counts and raster indicators, written as canonical partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rasters import AFFINE_STATS, unit_offset
from ..operators.coverage import Grid
from ..operators.incremental import merge_years
from ..operators.poi import count_in_zones, exportable, match_specs
from ..operators.zonal import merge_partials, monthly_partials, select_months, statistic, zonal_statistics
from ..schemas import ELEMENT_TYPES
from ..sources.canonical import canonical_rows, write_canonical


def count_poi(elements: DataFrame, extracts: DataFrame, zones: DataFrame, specs: DataFrame, grid: Grid) -> DataFrame:
    """Measured rows `indicator, geo_code, level, time, value, quality, source_date` of all point specs.

    `extracts`: `extract, country, month`. The newest month stamps the batch.
    """
    kept = elements.where(exportable(F.col("osm_type"), F.col("geom_type"), list(ELEMENT_TYPES)))
    matched = match_specs(kept, specs, placed=True)
    counts = count_in_zones(matched, zones, specs, grid, extracts.select("country"))
    month = extracts.select(F.max("month")).scalar()
    return counts.select("indicator", "geo_code", "level", month.alias("time"), "value", "quality",
                         F.concat(F.lit("extract "), month).alias("source_date"))


def write_poi_counts(counts: DataFrame, specs: DataFrame, root: str, ingested_at: datetime | None = None) -> int:
    ids = [r.id for r in specs.select("id").collect()]
    named = counts.join(specs.select(F.col("id").alias("indicator"), "unit", "source"), "indicator")
    return write_canonical(canonical_rows(named, F.col("indicator"), F.col("unit"), F.col("source"),
                                          F.col("source_date"), ingested_at), root, ids)


def zonal_indicator(raster: DataFrame, zones: DataFrame, spec: dict, grid: Grid, source_unit: str = "",
                    base_quality: str = "") -> DataFrame:
    """Measured rows of one raster spec, one per zone and year of the raster.

    Time is aggregated per cell and month first, which is the only pass over the raw
    rows; the coverage join then sees one row per cell and year. `plans.rasters` runs a whole spec table.
    """
    agg = spec.get("temporal_agg") or {}
    dated = raster.select(F.year("ts").cast("string").alias("time"), "ts", "value",
                          grid.column(F.col("lon")).alias("i"), grid.row(F.col("lat")).alias("j"))
    chosen = select_months(monthly_partials(dated, ["time", "i", "j"]), list(agg.get("months") or []), ["time"])
    cells = merge_partials(chosen, ["time", "i", "j"]).select("time", "i", "j", statistic(F.lit(agg.get("stat", "mean"))).alias("value"))
    stat = spec.get("zonal_stat", "mean")
    out = zonal_statistics(cells, zones.where(F.col("level").isin(spec["geo_levels"])), grid, stat, ["time"], base_quality)
    top = cells.groupBy("time").agg(F.max("value").alias("sample_max"))
    shift = unit_offset(F.lit(spec["unit"]), F.lit(source_unit), F.col("sample_max"))
    affine = F.lit(stat in AFFINE_STATS)
    return out.join(top, "time").select(
        F.lit(spec["id"]).alias("indicator"), "geo_code", "level", "time",
        F.when(affine, F.col("value") + shift).otherwise(F.col("value")).alias("value"), "quality")


def write_zonal(existing: DataFrame | None, fresh: DataFrame, spec: dict, root: str, source_date: str,
                ingested_at: datetime | None = None) -> int:
    """Replace an indicator by its kept years plus the fresh ones; one source date stamps all."""
    rows = fresh.select("indicator", "geo_code", "time", "value", "quality")
    if existing is not None:
        from ..session import cut_lineage

        kept = existing.select("indicator", "geo_code", "time", "value", "quality")
        # The partition being read is the one replaced, so the merge is written aside first.
        rows = cut_lineage(merge_years(kept, rows))
    return write_canonical(canonical_rows(rows, spec["id"], spec["unit"], spec["source"], source_date, ingested_at),
                           root, [spec["id"]])
