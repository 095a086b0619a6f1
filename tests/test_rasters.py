"""The raster sync over a spec table: months, statistics, feeds, scope, years, failures."""

from datetime import datetime

import pytest
from conftest import PHARMACIES
from pyspark.sql import functions as F
from test_spatial import box, shapes

from terrane.operators.coverage import Grid
from terrane.operators.zonal import merge_partials, monthly_partials, select_months, statistic
from terrane.plans.rasters import Feed, feed_partials, scope, sync_rasters
from terrane.schemas import STATE
from terrane.session import shared_dir
from terrane.sources.canonical import read_canonical

GRID = Grid(0, 0, 1, 1)
NOW = datetime(2025, 5, 1)


def raster(spark, years=(2021, 2022), products=(("reanalysis-soil", "skt", 280.0), ("tree-cover", "cover", 10.0))):
    """A value of 4x4 cells for each month: base + column + 10 * row + month."""
    rows = [(p, v, f"{y}-{m:02d}-15", j + 0.5, i + 0.5, base + i + 10 * j + m) for p, v, base in products
            for y in years for m in range(1, 13) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "product string, variable string, day string, lat double, lon double, value double").select(
        "product", "variable", F.col("day").cast("timestamp_ntz").alias("ts"), "lat", "lon", "value")


def spec(id, product, variable, months=(), stat="mean", zonal="mean", unit="X", levels=("NUTS1",)):
    return dict(id=id, source="copernicus", frequency="A", levels=list(levels), product=product, variable=variable, temporal_agg=(list(months), stat), zonal_stat=zonal)


ZONES = [("LV1", "NUTS1", [box(0, 0, 2, 2)]), ("LV2", "NUTS1", [box(2, 0, 4, 4)]), ("EE1", "NUTS1", [box(3, 3, 6, 6)]), ("LV", "NUTS0", [box(0, 0, 4, 4)])]


@pytest.fixture
def job(spark, make_specs):
    root = shared_dir(spark, "rasters")
    products = spark.createDataFrame([("reanalysis-soil", "K", "soil 2025-01", ""), ("tree-cover", "", "trees 2024", "modelled")],
                                     "product string, units string, source_date string, quality string")
    state = spark.createDataFrame([], STATE)

    def run(specs, years, rows=None, zones=ZONES, state=state, units=None, **settings):
        frame = raster(spark) if rows is None else rows
        feeds = {"reanalysis": Feed(frame, GRID, products), "local": Feed(frame, GRID, products)}
        table = make_specs(*specs)
        if units:
            table = table.withColumn("unit", F.lit(units))
        outcomes, after = sync_rasters(spark, feeds, shapes(spark, zones), table, years, root, state, "copernicus", NOW, **settings)
        return {r.key: (r.status, r.reason, r.rows, r.years) for r in outcomes.collect()}, after

    run.root = root
    return run


def at_rest(spark, run):
    return {(r.indicator, r.geo_code, r.time): (round(r.value, 6), r.quality, r.source_date) for r in read_canonical(spark, run.root).collect()}


SPECS = [spec("warm", "reanalysis-soil", "skin_temperature", [6, 7]), spec("top", "reanalysis-soil", "skt", [6, 7], "max", "max"),
         spec("trees", "tree-cover", "anything", [], "mean", "median", levels=["NUTS0"]), spec("all", "reanalysis-soil", "skt", [13], "sum", "count")]


def test_specs_share_a_run(spark, job):
    got, state = job(SPECS, [2021], units="DEG_C")
    assert got == {"warm": ("updated", None, 3, "2021"), "top": ("updated", None, 3, "2021"), "trees": ("updated", None, 1, "2021"), "all": ("updated", None, 3, "2021")}
    rows = at_rest(spark, job)
    # mean of columns 0, 1 and rows 0, 1 is 5.5, of June and July 6.5
    assert rows["warm", "LV1", "2021"] == (pytest.approx(280 + 5.5 + 6.5 - 273.15), "", "soil 2025-01")
    assert rows["top", "LV1", "2021"][0] == pytest.approx(280 + 11 + 7 - 273.15)
    assert rows["warm", "EE1", "2021"][1] == "partial_coverage" and rows["all", "LV2", "2021"][0] == 8
    assert rows["trees", "LV", "2021"] == (pytest.approx(10 + 16.5 + 6.5), "modelled", "trees 2024")
    assert {(r.key, r.value) for r in state.collect()} == {(f"{k}:last_year", "2021") for k in got}


def test_years_go_on(spark, job):
    _, state = job(SPECS[:1], "2021")
    assert job(SPECS[:1], "2021", state=state)[0] == {"warm": ("unchanged", None, 0, None)}
    got, state = job(SPECS[:1], "2020-2022", state=state)
    assert got == {"warm": ("updated", None, 6, "2022")}
    assert {k[2] for k in at_rest(spark, job)} == {"2021", "2022"}
    later = raster(spark, (2022,)).withColumn("value", F.col("value") + 1)
    before = at_rest(spark, job)
    assert job(SPECS[:1], [2022], rows=later, state=state, full=True)[0] == {"warm": ("updated", None, 6, "2022")}
    after = at_rest(spark, job)
    assert all(after[k][0] == pytest.approx(v[0] + (k[2] == "2022")) for k, v in before.items())


def test_failures_stay_alone(spark, job):
    two = [("reanalysis-soil", "skt", 280.0), ("reanalysis-soil", "t2m", 270.0)]
    specs = [SPECS[0], spec("wind", "reanalysis-soil", "wind_speed"), spec("none", "reanalysis-snow", "depth"), spec("mode", "reanalysis-soil", "skt", [], "mode"),
             spec("spread", "reanalysis-soil", "skt", [], "mean", "range"), PHARMACIES]
    got, state = job(specs, [2021, 2030], rows=raster(spark, (2021, 2022), two))
    assert got == {"warm": ("failed", "no_raster", 0, None), "wind": ("failed", "no_variable", 0, None), "none": ("failed", "no_raster", 0, None),
                   "mode": ("failed", "temporal_stat", 0, None), "spread": ("failed", "zonal_stat", 0, None)}
    assert at_rest(spark, job) == {} and state.count() == 0
    got, state = job(specs, [2021], rows=raster(spark, (2021,), two))
    assert got["warm"] == ("updated", None, 3, "2021") and got["wind"][0] == "failed"
    # a zone beyond the raster: the year has no row, and what is at rest stays
    assert job(SPECS[:1], [2022], zones=[("FI1", "NUTS1", [box(50, 50, 51, 51)])], state=state)[0]["warm"][:2] == ("failed", "no_raster")
    assert len(at_rest(spark, job)) == 3


def test_scope_and_years(spark, job):
    assert job(SPECS[:1], "2021-x")[0] == {"warm": ("failed", "years", 0, None)}
    assert job(SPECS[:1], [2021], countries=("FI",))[0] == {"warm": ("failed", "scope", 0, None)}
    assert job(SPECS[:1], [2021], box=(20, 20, 30, 30))[0] == {"warm": ("failed", "scope", 0, None)}
    assert job(SPECS[:1], [2021], countries=(" lv ",))[0]["warm"] == ("updated", None, 2, "2021")
    assert job(SPECS[:1], [], full=True)[0] == {"warm": ("unchanged", None, 0, None)}
    assert job(SPECS[:1], [2021], override="ftp")[0] == {"warm": ("failed", "no_feed", 0, None)}
    kept = scope(shapes(spark, ZONES), ["NUTS1"], (), (5, 5, 9, 9))
    assert [r.geo_code for r in kept.collect()] == ["EE1"]


def test_sampled_steps_only(spark):
    """Of hourly rows, a feed with sampled steps reads four a month."""
    hours = spark.range(31 * 24).select(F.lit("reanalysis-soil").alias("product"), F.lit("skt").alias("variable"), F.lit(0.5).alias("lat"), F.lit(0.5).alias("lon"),
                                        F.expr("timestampadd(HOUR, id, timestamp_ntz'2022-07-01 00:00:00')").alias("ts"), F.col("id").cast("double").alias("value"))
    nothing = spark.createDataFrame([], "product string, units string, source_date string, quality string")
    got = feed_partials(Feed(hours, GRID, nothing, 4), ["reanalysis-soil"], [2022], (0, 0, 1, 1)).first()
    days = [(4, 0), (12, 6), (19, 12), (27, 18)]  # half even of (k + 0.5) * 31 / 4, hours by turns
    assert (got["n"], got["month"]) == (4, 7) and got["total"] == sum((d - 1) * 24 + h for d, h in days)
    assert feed_partials(Feed(hours, GRID, nothing), ["reanalysis-soil"], [2022], (40, 40, 41, 41)).count() == 0


def test_months_are_settled_after_summing_up(spark):
    rows = spark.createDataFrame([("2020-06-01", 1.0), ("2020-06-02", None), ("2020-07-01", float("nan")), ("2020-07-02", 5.0), ("2021-01-01", 7.0), ("2021-02-01", 9.0)], "d string, value double")
    dated = rows.select(F.col("d").cast("timestamp_ntz").alias("ts"), "value", F.left("d", F.lit(4)).alias("time"))
    partials = monthly_partials(dated, ["time"])
    got = {r.time: (r.months_matched, r.rows, r.total) for r in select_months(partials, [6], ["time"]).groupBy("time", "months_matched").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total")).collect()}
    assert got == {"2020": (True, 2, 1.0), "2021": (False, 2, 16.0)}
    assert select_months(partials, [], ["time"]).where("not months_matched").count() == 0
    merged = merge_partials(partials, ["time"])
    for stat, want in (("mean", {"2020": 3.0, "2021": 8.0}), ("min", {"2020": 1.0, "2021": 7.0}), ("max", {"2020": 5.0, "2021": 9.0}), ("sum", {"2020": 6.0, "2021": 16.0})):
        assert {r.time: r.v for r in merged.select("time", statistic(F.lit(stat)).alias("v")).collect()} == want


def test_one_scan_and_no_exchange_of_raw_rows(spark, tmp_path):
    raster(spark).write.parquet(f"{tmp_path}/raster")
    nothing = spark.createDataFrame([], "product string, units string, source_date string, quality string")
    partials = feed_partials(Feed(spark.read.parquet(f"{tmp_path}/raster"), GRID, nothing), ["reanalysis-soil"], [2021], (0, 0, 4, 4))
    plan = partials._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "EqualTo(product," in plan and "IsNotNull(lat), IsNotNull(ts)" in plan
