"""Rasters: time aggregation and zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.rasters import COVERAGE_TOLERANCE, apply_offset
from ..schemas import TEMPORAL_STATS, ZONAL_STATS
from .coverage import Grid, grid_coverage

#: Buckets of the values of a zone, of about as many distinct values each.
_BUCKETS = 256


def _clean(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def time_statistics(raster: DataFrame, by: list[str]) -> DataFrame:
    """`rows, n, total, low, high` of `value` per group in one grouping, NaN and null skipped."""
    value = _clean(F.col("value"))
    return raster.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), F.sum(value).alias("total"),
                                   F.min(value).alias("low"), F.max(value).alias("high"))


def monthly_partials(raster: DataFrame, by: list[str]) -> DataFrame:
    """`by`, month of `ts`, and `rows, n, total, low, high` of the values: statistics that merge over months.

    The only pass over raw rows, which are summed up where they are read; NaN and null count as rows only.
    """
    return time_statistics(raster.withColumn("month", F.month("ts")), [*by, "month"])


def merge_partials(partials: DataFrame, by: list[str]) -> DataFrame:
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", "n", "total")], F.min("low").alias("low"), F.max("high").alias("high"))


def statistic(stat: Column) -> Column:
    """mean / min / max / sum of merged partials; null without a value."""
    return F.when(stat == "min", F.col("low")).when(stat == "max", F.col("high")).when(stat == "sum", F.col("total")).when(
        (stat == "mean") & (F.col("n") > 0), F.col("total") / F.col("n"))


def month_choice(months: Column, present: Column) -> tuple[Column, Column]:
    """The months to take of those `present`, and whether any of `months` is: without one, or if none is asked, all."""
    kept = F.array_intersect(F.coalesce(months, F.array().cast("array<int>")), present)
    matched = (F.coalesce(F.size(months), F.lit(0)) <= 0) | (F.size(kept) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(present), matched


def select_months(partials: DataFrame, months: list[int], by: list[str]) -> DataFrame:
    """Partials of `months` per group; a group without any such month keeps all. Adds `months_matched`."""
    present = partials.groupBy(*by).agg(F.collect_set("month").alias("_present"))
    chosen, matched = month_choice(F.array(*[F.lit(m) for m in months]).cast("array<int>"), F.col("_present"))
    asked = present.select(*by, chosen.alias("_chosen"), matched.alias("months_matched"))
    return partials.join(asked, by).where(F.array_contains("_chosen", F.col("month"))).drop("_chosen")


def aggregate_time(raster: DataFrame, stat: str, by: list[str]) -> DataFrame:
    """mean / min / max / sum of `value` per group, NaN and null skipped."""
    if stat not in TEMPORAL_STATS:
        raise ValueError(f"unsupported temporal statistic: {stat}")
    value = _clean(F.col("value"))
    how = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[stat]
    return raster.groupBy(*by).agg(how(value).alias("value"))


def crop(raster: DataFrame, west: float, south: float, east: float, north: float, margin: float) -> DataFrame:
    """Rows within the box widened by `margin`; the frame as it is when nothing overlaps. Decided when it runs."""
    inside = F.col("lon").between(west - margin, east + margin) & F.col("lat").between(south - margin, north + margin)
    found = raster.where(inside).limit(1).agg(F.count(F.lit(1))).scalar()
    return raster.where(inside | (found == 0))


def covered_cells(cells: DataFrame, zones: DataFrame, grid: Grid) -> DataFrame:
    """`geo_code, level, fraction` added to cells `i, j, value`, one row per zone and cell met."""
    weights = grid_coverage(zones.select("geo_code", "level", "geometry"), grid, ["geo_code", "level"])
    usable = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.join(weights, ["i", "j"])


def weighted_median(covered: DataFrame, keys: list[str]) -> DataFrame:
    """Interpolated weighted `median` of `value` by `fraction`, and the weight `covered`.

    Exact, and in bounded groups.

    Sorted values x_k with weights w_k sit at s_k = k w_k + (n - 1) (w_0 + .. +
    w_{k-1}); the median is read at half of the last s. Equal values are merged
    first: within a run of equal values only its two ends can bound the median.
    Positions come from sums per value bucket plus a window inside a bucket, so
    no group is ever sorted as a whole. Buckets end at quantiles of a mergeable
    sketch, so an outlier does not crowd the rest into one of them.
    """
    merged = covered.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fraction").alias("w"),
        F.min("fraction").alias("w_min"), F.max("fraction").alias("w_max"))
    shares = F.array(*[F.lit(k / _BUCKETS) for k in range(1, _BUCKETS)])
    span = merged.groupBy(*keys).agg(
        F.percentile_approx("value", shares, 8 * _BUCKETS).alias("ends"), F.sum("n").alias("n_all"), F.sum("w").alias("w_all"))
    bucketed = merged.join(span, keys).withColumn(
        "bucket", F.size(F.filter("ends", lambda end: end < F.col("value")))).drop("ends")
    per_bucket = bucketed.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.sum("w").alias("bw"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "bucket", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bw").over(before), F.lit(0.0)).alias("w_before"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.join(offsets, [*keys, "bucket"]).select(
        *keys, "value", "n", "w", "w_min", "w_max", "n_all", "w_all",
        (F.col("n_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("k"),
        (F.col("w_before") + F.coalesce(F.sum("w").over(inside), F.lit(0.0))).alias("c"))
    m = F.col("n_all") - 1
    first = F.col("k") * F.col("w_min") + m * F.col("c")
    last = (F.col("k") + F.col("n") - 1) * F.col("w_max") + m * (F.col("c") + F.col("w") - F.col("w_max"))
    ends = placed.select(*keys, "value", "w_all", (m * F.col("w_all") * 0.5).alias("target"), F.explode(F.array(first, last)).alias("s"))
    below, above = F.col("s") <= F.col("target"), F.col("s") > F.col("target")
    found = ends.groupBy(*keys).agg(
        F.max(F.when(below, F.struct("s", "value"))).alias("a"),
        F.min(F.when(above, F.struct("s", "value"))).alias("b"),
        F.max("target").alias("t"), F.max("w_all").alias("covered"))
    a, b = F.col("a"), F.col("b")
    slope = (b["value"] - a["value"]) / F.nullif(b["s"] - a["s"], F.lit(0.0))
    return found.select(*keys, F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(
        a["value"] + (F.col("t") - a["s"]) * F.coalesce(slope, F.lit(0.0))).alias("median"), "covered")


def zonal_by_spec(cells: DataFrame, zones: DataFrame, grid: Grid, specs: DataFrame, medians: bool = True) -> DataFrame:
    """Statistics of many specs at once: `indicator, geo_code, level, time, value, covered, expected`.

    `cells`: `indicator, time, i, j, value`; `specs`: `indicator, zonal_stat, geo_levels`, a small table. All specs meet
    the zones in one join and share a grouping; only medians need another.
    """
    keys = ["indicator", "geo_code", "level", "time"]
    covered = covered_cells(cells, zones, grid).join(specs.select("indicator", "zonal_stat", "geo_levels"), "indicator").where(
        F.array_contains("geo_levels", F.col("level")))
    v, w, stat = F.col("value"), F.col("fraction"), F.col("zonal_stat")
    sums = covered.where(stat != "median").groupBy(*keys, "zonal_stat").agg(
        F.sum(v * w).alias("vw"), F.sum(w).alias("covered"), F.min(v).alias("low"), F.max(v).alias("high"))
    value = F.when(stat == "mean", F.col("vw") / F.col("covered")).when(stat == "sum", F.col("vw")).when(stat == "count", F.col("covered")).when(
        stat == "min", F.col("low")).when(stat == "max", F.col("high"))
    found = sums.select(*keys, value.alias("value"), "covered")
    if medians:
        middle = weighted_median(covered.where(stat == "median"), keys).withColumnRenamed("median", "value")
        found = found.unionByName(middle.select(*keys, "value", "covered"))
    area = zones.select("geo_code", "level", (polygon_area(F.col("geometry")) / grid.cell_area).alias("expected"))
    return found.join(area, ["geo_code", "level"]).select(*keys, "value", "covered", "expected")


def coverage_quality(base: Column) -> Column:
    """`partial_coverage` instead of the base quality where the valid cells cover less than the zone."""
    share = F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(1.0)
    return F.when(share < COVERAGE_TOLERANCE, "partial_coverage").otherwise(base)


def zonal_statistics(cells: DataFrame, zones: DataFrame, grid: Grid, stat: str = "mean",
                     by: list[str] | None = None, base_quality: str = "",
                     offset: Column | float = 0.0) -> DataFrame:
    """Coverage-weighted statistic per zone (and `by`): `geo_code, level, value, quality`.

    `cells` holds `i, j, value` and the `by` columns. A zone whose valid cells
    cover less than its area is marked `partial_coverage`, which replaces the
    base quality. Zones without any valid cell give no row.
    """
    if stat not in ZONAL_STATS:
        raise ValueError(f"unsupported zonal statistic: {stat}")
    keys = ["geo_code", "level", *(by or [])]
    covered = covered_cells(cells, zones, grid)
    v, w = F.col("value"), F.col("fraction")
    if stat == "median":
        stats = weighted_median(covered, keys).withColumnRenamed("median", "value")
    else:
        simple = {"mean": F.sum(v * w) / F.sum(w), "sum": F.sum(v * w), "count": F.sum(w), "min": F.min(v), "max": F.max(v)}
        stats = covered.groupBy(*keys).agg(simple[stat].alias("value"), F.sum(w).alias("covered"))
    area = zones.select("geo_code", "level", (polygon_area(F.col("geometry")) / grid.cell_area).alias("expected"))
    shift = offset if isinstance(offset, Column) else F.lit(float(offset))
    return stats.join(area, ["geo_code", "level"]).select(
        *keys, apply_offset(F.col("value"), F.lit(stat), shift).alias("value"),
        coverage_quality(F.lit(base_quality)).alias("quality"), "covered", "expected")
