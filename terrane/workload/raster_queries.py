"""Rasters: time steps, units, coverage and zonal statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.geometry import cell_bounds, wrap_longitude
from ..functions.rasters import feed_of, pick_variable, sampled_steps, unit_offset
from ..operators.coverage import grid_coverage
from ..operators.zonal import crop, monthly_partials, select_months, time_statistics, zonal_statistics
from ..plans.rasters import Feed, sync_rasters
from ..plans.spatial import write_zonal, zonal_indicator
from ..schemas import SPECS, STATE
from ..session import shared_dir
from ..sources.canonical import read_canonical
from .base import query, table, view
from .shapes import RASTER_GRID, SOUTH, WEST, raster, raster_cells, raster_spec, zone_shapes


@query("raster_year_mean", "cells", sql="SELECT time, i, j, round(value, 6) AS value FROM cells")
def raster_year_mean(spark, sf):
    return raster_cells(spark, sf).select("time", "i", "j", F.round("value", 6).alias("value"))


@query("raster_time_stats", "raster", sql="""
SELECT i, j, min(value) AS low, max(value) AS high, sum(value) AS total FROM raster GROUP BY i, j""")
def raster_time_stats(spark, sf):
    placed = raster(spark, sf).select("value", RASTER_GRID.column(F.col("lon")).alias("i"), RASTER_GRID.row(F.col("lat")).alias("j"))
    return time_statistics(placed, ["i", "j"]).select("i", "j", "low", "high", "total")


@query("raster_month_selection", "raster", sql="""
SELECT y AS time, count(*) AS n, sum(value) AS total, bool_and(has) AS matched FROM (
  SELECT *, CAST(year(ts) AS VARCHAR) AS y, bool_or(month(ts) IN (10, 11)) OVER (PARTITION BY year(ts)) AS has FROM raster)
WHERE month(ts) IN (10, 11) OR NOT has GROUP BY y""")
def raster_month_selection(spark, sf):
    """A year without any of the months keeps all of its steps."""
    dated = raster(spark, sf).withColumn("time", F.year("ts").cast("string"))
    chosen = select_months(monthly_partials(dated, ["time"]), [10, 11], ["time"])
    return chosen.groupBy("time").agg(F.sum("rows").alias("n"), F.sum("total").alias("total"), F.bool_and("months_matched").alias("matched"))


_STEPS = """
SELECT DISTINCT strftime(make_date(y, m, CAST(least(greatest(round_even((k + 0.5) * d / 4, 0), 1), d) AS INT)), '%Y-%m-%d') || 'T' || lpad(CAST((k % 4) * 6 AS VARCHAR), 2, '0') || ':00:00' AS step, y
FROM (SELECT y, m, k, day(last_day(make_date(y, m, 1))) AS d FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y FROM lineitem), (SELECT unnest([6, 7, 8]) AS m), (SELECT unnest(range(4)) AS k))"""


@query("raster_sampled_steps", sql=f"SELECT y AS year, step FROM ({_STEPS})")
def raster_sampled_steps(spark, sf):
    years = raster(spark, sf).select(F.year("ts").alias("year")).distinct()
    return years.select("year", F.explode(sampled_steps(F.col("year"), F.array(F.lit(6), F.lit(7), F.lit(8)))).alias("step"))


@query("raster_sampled", "raster", sql=f"""
SELECT i, j, year(ts) AS year, sum(value) AS total, count(*) AS n FROM raster
WHERE strftime(ts, '%Y-%m-%d') IN (SELECT left(step, 10) FROM ({_STEPS})) GROUP BY ALL""")
def raster_sampled(spark, sf):
    """Observations on the sampled days: the raster is dated by day, so the hour is left out."""
    rows = raster(spark, sf)
    years = rows.select(F.year("ts").alias("year")).distinct()
    days = years.select(F.explode(sampled_steps(F.col("year"), F.array(F.lit(6), F.lit(7), F.lit(8)))).alias("step")).select(
        F.left("step", F.lit(10)).alias("day"))
    kept = rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(days, "day", "left_semi")
    return kept.groupBy(RASTER_GRID.column(F.col("lon")).alias("i"), RASTER_GRID.row(F.col("lat")).alias("j"), F.year("ts").cast("bigint").alias("year")).agg(
        F.sum(F.nanvl("value", F.lit(None).cast("double"))).alias("total"), F.count(F.lit(1)).alias("n"))


@query("raster_crop", "raster", sql="""
SELECT i, j, count(*) AS n FROM raster WHERE -20 + (i + 0.5) * 0.5 BETWEEN -0.5 AND 10.5 AND 35 + (j + 0.5) * 0.5 BETWEEN 44.5 AND 50.5 GROUP BY i, j""")
def raster_crop(spark, sf):
    return crop(raster(spark, sf), 0.0, 45.0, 10.0, 50.0, 0.5).groupBy(
        RASTER_GRID.column(F.col("lon")).alias("i"), RASTER_GRID.row(F.col("lat")).alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query("longitude_wrap", "raster", sql="""
SELECT DISTINCT i, CASE WHEN i * 3.0 > 180 THEN CAST(i * 3.0 AS DOUBLE) - 360 ELSE CAST(i * 3.0 AS DOUBLE) END AS lon,
       CAST(-20 + i * 0.5 AS DOUBLE) AS west, CAST(-19.5 + i * 0.5 AS DOUBLE) AS east, CAST(0.25 AS DOUBLE) AS area FROM raster""")
def longitude_wrap(spark, sf):
    rows = raster(spark, sf).select(RASTER_GRID.column(F.col("lon")).alias("i"), "lon", "lat")
    box = cell_bounds(F.col("lon"), F.col("lat"), 0.5, 0.5)
    return rows.select("i", wrap_longitude(F.col("i") * 3.0).alias("lon"), box["west"].alias("west"), box["east"].alias("east"),
                       box["area"].alias("area")).distinct()


@query("unit_offsets", sql="""
SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN 0.0::DOUBLE WHEN p_size % 3 = 0 THEN -273.15::DOUBLE WHEN p_size % 3 = 1 THEN 0.0::DOUBLE
       WHEN p_size * 5 > 100 THEN -273.15::DOUBLE ELSE 0.0::DOUBLE END AS shift,
       CASE WHEN p_size % 2 = 0 THEN 'reanalysis' ELSE 'local' END AS feed,
       CASE p_size % 4 WHEN 0 THEN 'skt' WHEN 1 THEN 'skin_temperature' WHEN 2 THEN 'only' END AS variable FROM part""")
def unit_offsets(spark, sf):
    size = F.col("p_size")
    target = F.when(F.col("p_type") == "ECONOMY", "DEG_C").otherwise("PERCENT")
    unit = F.when(size % 3 == 0, " Kelvin ").when(size % 3 == 1, "degC").otherwise("")
    product = F.when(size % 2 == 0, "reanalysis-era5-land").otherwise("imperviousness")
    present = (F.when(size % 4 == 0, F.array(F.lit("skt"), F.lit("t2m"))).when(size % 4 == 1, F.array(F.lit("skt"), F.lit("skin_temperature")))
               .when(size % 4 == 2, F.array(F.lit("only"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    return table(spark, sf, "part").select(
        "p_partkey", unit_offset(target, unit, size * 5).alias("shift"), feed_of(product).alias("feed"),
        pick_variable(F.lit("skin_temperature"), present).alias("variable"))


# ------------------------------------------------------------------- coverage

@query("zonal_coverage", "coverage", "raster", sql="""
SELECT c1 AS geo_code, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(fraction, 6) AS fraction
FROM coverage SEMI JOIN (SELECT DISTINCT i, j FROM raster) USING (i, j)""")
def zonal_coverage(spark, sf):
    """Covered fraction of every cell that has observations."""
    seen = raster_cells(spark, sf).select("i", "j").distinct()
    covered = grid_coverage(zone_shapes(spark, sf), RASTER_GRID).where("fraction > 1e-9").join(seen, ["i", "j"], "left_semi")
    return covered.select("geo_code", "i", "j", F.round("fraction", 6).alias("fraction"))


view("covered", "coverage", "cells", sql="""
SELECT c1, time, c.i, c.j, value, fraction FROM cells c JOIN coverage v ON v.i = c.i AND v.j = c.j WHERE value IS NOT NULL
""")
_STAT_SQL = """
SELECT c1 AS geo_code, time, round({stat}, 8) AS value,
       CASE WHEN sum(fraction) / (any_value(area) / 0.25) < 0.999 THEN 'partial_coverage' ELSE 'sampled' END AS quality
FROM covered JOIN zarea USING (c1) GROUP BY c1, time"""


def _stat(stat):
    def run(spark, sf):
        out = zonal_statistics(raster_cells(spark, sf), zone_shapes(spark, sf), RASTER_GRID, stat, ["time"], "sampled")
        return out.select("geo_code", "time", F.round("value", 8).alias("value"), "quality")

    return run


for _name, _sql in {"mean": "sum(value * fraction) / sum(fraction)", "sum": "sum(value * fraction)", "count": "sum(fraction)",
                    "min": "min(value)", "max": "max(value)"}.items():
    query(f"zonal_{_name}", "covered", "zarea", sql=_STAT_SQL.format(stat=_sql))(_stat(_name))


@query("zonal_median", "covered", "zarea", sql="""
SELECT geo_code, time, round(CASE WHEN b IS NULL THEN a.v ELSE a.v + (t - a.s) * coalesce((b.v - a.v) / nullif(b.s - a.s, 0), 0) END, 8) AS value, quality FROM (
  SELECT c1 AS geo_code, time, any_value(t) AS t, max(CASE WHEN s <= t THEN {'s': s, 'v': value} END) AS a, min(CASE WHEN s > t THEN {'s': s, 'v': value} END) AS b,
         CASE WHEN any_value(w) / (any_value(area) / 0.25) < 0.999 THEN 'partial_coverage' ELSE 'sampled' END AS quality FROM (
    SELECT *, k * fraction + (n - 1) * before AS s, (n - 1) * w / 2 AS t FROM (
      SELECT *, row_number() OVER o - 1 AS k, coalesce(sum(fraction) OVER (PARTITION BY c1, time ORDER BY value, fraction, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             count(*) OVER (PARTITION BY c1, time) AS n, sum(fraction) OVER (PARTITION BY c1, time) AS w
      FROM covered WINDOW o AS (PARTITION BY c1, time ORDER BY value, fraction, i, j))) JOIN zarea USING (c1) GROUP BY c1, time)""")
def zonal_median(spark, sf):
    return _stat("median")(spark, sf)


_SPEC = {"id": "quantity_mean", "unit": "DEG_C", "source": "copernicus", "geo_levels": ["NUTS1"],
         "temporal_agg": {"months": [6, 7, 8], "stat": "mean"}, "zonal_stat": "mean"}


@query("zonal_indicator_years", "coverage", "raster", "zarea", sql="""
SELECT 'quantity_mean' AS indicator, geo_code, time, round(CASE WHEN time < '1999' THEN value + 1 ELSE value END - 273.15, 8) AS value, quality, 'DEG_C' AS unit FROM (
  SELECT c1 AS geo_code, time, sum(value * fraction) / sum(fraction) AS value,
         CASE WHEN sum(fraction) / (any_value(area) / 0.25) < 0.999 THEN 'partial_coverage' ELSE '' END AS quality
  FROM (SELECT y AS time, i, j, avg(value) AS value FROM (
          SELECT *, CAST(year(ts) AS VARCHAR) AS y, bool_or(month(ts) IN (6, 7, 8)) OVER (PARTITION BY year(ts)) AS has FROM raster)
        WHERE month(ts) IN (6, 7, 8) OR NOT has GROUP BY ALL) c
  JOIN coverage v ON v.i = c.i AND v.j = c.j JOIN zarea USING (c1) WHERE value IS NOT NULL GROUP BY c1, time)""")
def zonal_indicator_years(spark, sf):
    """Two runs of a raster spec: the second adds its years to those at rest."""
    root = shared_dir(spark, "zonal")
    shapes, rows = zone_shapes(spark, sf), raster(spark, sf)
    early = zonal_indicator(rows.where(F.year("ts") < 1999), shapes, _SPEC, RASTER_GRID, "K").withColumn("value", F.col("value") + 1)
    write_zonal(None, early, _SPEC, root, "first run")
    late = zonal_indicator(rows.where(F.year("ts") >= 1999), shapes, _SPEC, RASTER_GRID, "K")
    write_zonal(read_canonical(spark, root, [_SPEC["id"]]), late, _SPEC, root, "second run")
    return read_canonical(spark, root).select("indicator", "geo_code", "time", F.round("value", 8).alias("value"), "quality", "unit")


# ------------------------------------------------------------- the whole sync

view("taxes", sql="""
SELECT l_shipdate AS ts, CAST(l_partkey * 7919 % 120 AS INT) AS i, CAST(l_suppkey * 104729 % 70 AS INT) AS j, l_tax * 100 AS value FROM lineitem""")

# indicator, unit, product, variable, months, temporal and zonal statistic
_SPEC_TABLE = [
    ("warm_mean", "DEG_C", "reanalysis-orders", "quantity", [6, 7, 8], "mean", "mean"),
    ("late_peak", "COUNT", "reanalysis-orders", "quantity", [12], "max", "max"),
    ("whole_total", "COUNT", "reanalysis-orders", "quantity", [], "sum", "sum"),
    ("early_middle", "COUNT", "reanalysis-orders", "quantity", [1, 2], "mean", "median"),
    ("spring_floor", "COUNT", "reanalysis-orders", "quantity", [3, 4, 5], "min", "min"),
    ("tax_cells", "COUNT", "land-tax", "skin_temperature", None, "mean", "count"),
    ("absent", "COUNT", "reanalysis-nothing", "quantity", [], "mean", "mean"),
    ("odd_statistic", "COUNT", "reanalysis-orders", "quantity", [], "mode", "mean"),
    ("up_to_date", "COUNT", "reanalysis-orders", "quantity", [], "mean", "mean"),
]
_SPEC_VALUES = ", ".join(f"('{i}', '{u}', '{p}', {m or '[]'}::INT[], '{t}', '{z}')" for i, u, p, _, m, t, z in _SPEC_TABLE[:6])
view("spec_cells", "raster", "taxes", sql=f"""
SELECT indicator, unit, zstat, CAST(y AS VARCHAR) AS time, i, j,
       CASE tstat WHEN 'mean' THEN avg(value) WHEN 'max' THEN max(value) WHEN 'min' THEN min(value) ELSE sum(value) END AS value
FROM (SELECT *, bool_or(list_contains(months, m)) OVER (PARTITION BY indicator, y) AS has FROM (
        SELECT s.*, year(ts) AS y, month(ts) AS m, i, j, value FROM (VALUES {_SPEC_VALUES}) s(indicator, unit, product, months, tstat, zstat)
        JOIN (SELECT 'reanalysis-orders' AS product, * FROM raster UNION ALL SELECT 'land-tax', * FROM taxes) r ON r.product = s.product
        WHERE -20 + (i + 0.5) * 0.5 BETWEEN -18.5 AND 30.5 AND 35 + (j + 0.5) * 0.5 BETWEEN 35.5 AND 60.5))
WHERE list_contains(months, m) OR NOT coalesce(has, false) GROUP BY indicator, unit, zstat, tstat, y, i, j
""")
view("spec_covered", "spec_cells", "coverage", "zpts", sql="""
SELECT indicator, unit, zstat, time, c1, c.i, c.j, value, fraction FROM spec_cells c JOIN coverage v ON v.i = c.i AND v.j = c.j
WHERE value IS NOT NULL AND c1 IN (SELECT c1 FROM zpts WHERE c0 IN ('R0', 'R1', 'R2', 'R3') GROUP BY c1
                                   HAVING NOT (max(x) < -18.0 OR min(x) > 30.0 OR max(y) < 36.0 OR min(y) > 60.0))
""")
view("spec_median", "spec_covered", sql="""
SELECT indicator, c1, time, CASE WHEN b IS NULL THEN a.v ELSE a.v + (t - a.s) * coalesce((b.v - a.v) / nullif(b.s - a.s, 0), 0) END AS value FROM (
  SELECT indicator, c1, time, any_value(t) AS t, max(CASE WHEN s <= t THEN {'s': s, 'v': value} END) AS a, min(CASE WHEN s > t THEN {'s': s, 'v': value} END) AS b FROM (
    SELECT *, k * fraction + (n - 1) * before AS s, (n - 1) * w / 2 AS t FROM (
      SELECT *, row_number() OVER o - 1 AS k,
             coalesce(sum(fraction) OVER (PARTITION BY indicator, c1, time ORDER BY value, fraction, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             count(*) OVER (PARTITION BY indicator, c1, time) AS n, sum(fraction) OVER (PARTITION BY indicator, c1, time) AS w
      FROM spec_covered WHERE zstat = 'median' WINDOW o AS (PARTITION BY indicator, c1, time ORDER BY value, fraction, i, j))) GROUP BY indicator, c1, time)
""")
view("spec_rows", "spec_covered", "spec_median", "zarea", sql="""
SELECT s.indicator, s.c1 AS geo_code, s.time, unit, quality, CASE WHEN unit = 'DEG_C' THEN coalesce(m.value, s.value) - 273.15 ELSE coalesce(m.value, s.value) END AS value FROM (
  SELECT indicator, c1, time, unit,
         CASE zstat WHEN 'mean' THEN sum(value * fraction) / sum(fraction) WHEN 'sum' THEN sum(value * fraction) WHEN 'count' THEN sum(fraction)
                    WHEN 'min' THEN min(value) WHEN 'max' THEN max(value) END AS value,
         CASE WHEN sum(fraction) / (any_value(area) / 0.25) < 0.999 THEN 'partial_coverage' WHEN indicator = 'tax_cells' THEN 'sampled' ELSE '' END AS quality
  FROM spec_covered JOIN zarea USING (c1) GROUP BY indicator, c1, time, unit, zstat) s
LEFT JOIN spec_median m ON m.indicator = s.indicator AND m.c1 = s.c1 AND m.time = s.time
""")


def _synced(spark, sf):
    """Two runs over all specs: three years, then a longer list, of which the first years are kept as they are."""
    root = shared_dir(spark, "zonal-specs")
    orders = raster(spark, sf)
    taxes = table(spark, sf, "lineitem").select(
        F.lit("land-tax").alias("product"), F.lit("skt").alias("variable"), F.col("l_shipdate").alias("ts"),
        (F.lit(SOUTH) + (F.col("l_suppkey") * 104729 % 70 + 0.5) * 0.5).alias("lat"), (F.lit(WEST) + (F.col("l_partkey") * 7919 % 120 + 0.5) * 0.5).alias("lon"),
        (F.col("l_tax") * 100).alias("value"))

    def about(product, units, day, quality):
        return spark.createDataFrame([(product, units, day, quality)], "product string, units string, source_date string, quality string")

    feeds = {"reanalysis": Feed(orders, RASTER_GRID, about("reanalysis-orders", "K", "feed of 2001-12-01", "")),
             "local": Feed(taxes, RASTER_GRID, about("land-tax", "", "raster of 2001-11-01", "sampled"))}
    specs = spark.createDataFrame([raster_spec(*r) for r in _SPEC_TABLE], SPECS)
    state = spark.createDataFrame([("copernicus", "up_to_date:last_year", "2001", datetime(2001, 1, 1))], STATE)
    for years in ("1995-1997", "1995, 1996-2001"):
        outcomes, state = sync_rasters(spark, feeds, zone_shapes(spark, sf), specs, years, root, state, "copernicus", datetime(2002, 1, 1),
                                       countries=("R0", "r1", "R2", "R3"), box=(-18.0, 36.0, 30.0, 60.0))
    return read_canonical(spark, root), outcomes, state


@query("zonal_specs", "spec_rows", sql="""
SELECT indicator, geo_code, time, unit, quality, round(value, 8) AS value,
       CASE WHEN indicator = 'tax_cells' THEN 'raster of 2001-11-01' ELSE 'feed of 2001-12-01' END AS source_date FROM spec_rows""")
def zonal_specs(spark, sf):
    """What is at rest after both runs."""
    return _synced(spark, sf)[0].select("indicator", "geo_code", "time", "unit", "quality", F.round("value", 8).alias("value"), "source_date")


@query("zonal_specs_outcomes", "spec_rows", sql="""
SELECT indicator AS key, 'updated' AS status, CAST(NULL AS VARCHAR) AS reason, count(*) AS rows, '1998, 1999, 2000, 2001' AS years, '2001' AS last_year FROM spec_rows GROUP BY indicator
UNION ALL SELECT 'absent', 'failed', 'no_raster', 0, NULL, NULL UNION ALL SELECT 'odd_statistic', 'failed', 'temporal_stat', 0, NULL, NULL
UNION ALL SELECT 'up_to_date', 'unchanged', NULL, 0, NULL, '2001'""")
def zonal_specs_outcomes(spark, sf):
    """The report of the second run with the state it leaves; a spec that fails doesn't stop the others."""
    _, outcomes, state = _synced(spark, sf)
    last = state.select(F.regexp_replace("key", ":last_year$", "").alias("key"), F.col("value").alias("last_year"))
    return outcomes.join(last, "key", "left").select("key", "status", "reason", "rows", "years", "last_year")
