"""Canonical table: schema, replacement, windows, pivot, snapshots, reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrane.functions.cells import format_value, merge_quality
from terrane.functions.periods import in_window, month_stamp, period_key, period_order, year_list
from terrane.plans.indicators import query_indicators
from terrane.operators.reports import bounded, indicator_profile, levels_present
from terrane.schemas import CANONICAL
from terrane.session import shared_dir
from terrane.sources.canonical import canonical_rows, drop_indicator, materialized_ids, read_canonical, write_indicator

WAGES, HOMES, PHARMS = "wage_index", "dwellings", "pharmacies"
SPEC = {"id": WAGES, "unit": "INDEX", "source": "eurostat"}


def cells(answer):
    return [tuple(r) for r in answer.table.collect()]


def test_last_three_periods_pivoted(canonical):
    got = cells(query_indicators(canonical, [WAGES, HOMES], ["CZ06", "HU22"]))
    assert got[0] == ("CZ06", "2022", "118.4 [e]", "812400")
    assert [t for z, t, *_ in got if z == "CZ06"] == ["2022", "2021", "2020"]


@pytest.mark.parametrize("bounds, periods", [(("2020", "2021"), ["2021", "2020"]), (("2021", ""), ["2022", "2021"])])
def test_inclusive_window(canonical, bounds, periods):
    got = cells(query_indicators(canonical, [WAGES], ["CZ06"], *bounds))
    assert [r[1] for r in got] == periods


def test_window_covers_subperiods(spark):
    rows = spark.createDataFrame([("2017-Q2",), ("2017-Q3",), ("2018-Q2",)], "time string")
    kept = rows.where(in_window(F.col("time"), "2017", "2017")).orderBy("time")
    assert [r.time for r in kept.collect()] == ["2017-Q2", "2017-Q3"]


def test_period_order(spark):
    order = ["2017", "2017-02", "2017-06", "2017-S2", "2017-Q4", "2017-11", "2018-Q1"]
    rows = spark.createDataFrame([(p,) for p in sorted(order)], "time string")
    assert [r.time for r in rows.orderBy(period_order(F.col("time"))).collect()] == order


@pytest.mark.parametrize("text, key", [("2016", (2016, 0, 0)), ("2016-S1", (2016, 1, 1)), ("2016-Q3", (2016, 7, 2)),
                                       ("2016-08", (2016, 8, 3)), ("2016-W41", (2016, 0, 9)), ("soon", (0, 0, 0)), ("2016-S", (2016, 0, 9))])
def test_period_key(spark, text, key):
    assert tuple(spark.range(1).select(period_key(F.lit(text)).alias("k")).first().k) == key


def test_unknown_zone_or_indicator_is_empty(canonical):
    assert cells(query_indicators(canonical, [WAGES], ["ZZ99"])) == []
    assert cells(query_indicators(canonical, ["never"], ["CZ06"])) == []


def test_snapshot_repeats_on_period_rows(canonical):
    got = cells(query_indicators(canonical, [WAGES, PHARMS], ["CZ06"], snapshots=[PHARMS]))
    assert len(got) == 3 and {r[3] for r in got} == {"214 [snapshot 2025-03]"}
    got = cells(query_indicators(canonical, [WAGES, PHARMS], ["CZ06"], "2019", "2020", snapshots=[PHARMS]))
    assert [(r[1], r[3]) for r in got] == [("2020", "214 [snapshot 2025-03]"), ("2019", "214 [snapshot 2025-03]")]


def test_snapshot_alone_keeps_its_date(canonical):
    got = cells(query_indicators(canonical, [PHARMS], ["CZ06", "CZ08"], snapshots=[PHARMS]))
    assert got == [("CZ06", "2025-03", "214 [osm_completeness_unknown]"), ("CZ08", "2025-03", "187 [osm_completeness_unknown]")]


def test_snapshot_only_where_known(canonical):
    got = cells(query_indicators(canonical, [WAGES, PHARMS], ["CZ08", "HU22"], snapshots=[PHARMS]))
    assert {(r[0], r[3]) for r in got} == {("CZ08", "187 [snapshot 2025-03]"), ("HU22", "")}


def test_companion_reports(canonical):
    answer = query_indicators(canonical, [WAGES, HOMES, PHARMS, "never"], ["CZ06"], "2021", "2021", snapshots=[PHARMS])
    assert {r.indicator: (r.time_min, r.time_max) for r in answer.missing.collect()} == {HOMES: ("2022", "2022"), "never": (None, None)}
    assert {r.source: r.dates for r in answer.by_source.collect()} == {"eurostat": "03.02.2025", "osm": "extract 2025-03"}
    note = answer.snapshots.first()
    assert (note.snapshot_time, note.qualities, note.repeated) == ("2025-03", "osm_completeness_unknown", True)
    both = query_indicators(canonical, [WAGES, HOMES], ["CZ06"]).by_source.first()
    assert both.dates == "dwellings 14.01.2025, wage_index 03.02.2025"


def test_profile_and_levels(canonical):
    p = indicator_profile(canonical.where(F.col("indicator") == WAGES)).first()
    assert (p.rows, p.time_min, p.time_max, p.source_date) == (7, "2019", "2022", "03.02.2025")
    assert {r.level for r in levels_present(canonical).collect()} == {"NUTS2"}


def test_truncation(canonical):
    got = bounded(canonical.select("time", "geo_code", "value"), F.col("time"), F.col("geo_code"), F.col("value"), limit=5).collect()
    assert len(got) == 5 and all(r.truncated for r in got)
    assert not bounded(canonical.limit(3), F.col("time"), limit=5).first().truncated


def test_write_replaces_only_its_partition(spark, canonical):
    root = shared_dir(spark, "test")
    rows = canonical.where(F.col("indicator") == WAGES).select("geo_code", "time", "value", "quality")
    assert write_indicator(rows, root, SPEC, "03.02.2025", datetime(2025, 4, 2)) == 7
    assert write_indicator(rows.limit(2).drop("quality"), root, SPEC | {"id": HOMES}, "x") == 2
    assert read_canonical(spark, root).schema.names == CANONICAL.names
    assert write_indicator(rows.limit(1), root, SPEC, "04.02.2025") == 1
    assert {(r.indicator, r["count"]) for r in read_canonical(spark, root).groupBy("indicator").count().collect()} == {(WAGES, 1), (HOMES, 2)}
    assert read_canonical(spark, root, [HOMES]).first().quality == ""
    assert materialized_ids(spark, root) == [HOMES, WAGES]
    write_indicator(rows.where("false"), root, SPEC, "05.02.2025")
    assert materialized_ids(spark, root) == [HOMES]
    assert drop_indicator(spark, root, HOMES) and not drop_indicator(spark, root, HOMES)


def test_reading_one_indicator_prunes_partitions(spark, canonical):
    root = shared_dir(spark, "test")
    canonical.write.partitionBy("indicator").parquet(root)
    plan = read_canonical(spark, root, [WAGES]).where("geo_code = 'CZ06'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(indicator" in plan and "PushedFilters: [IsNotNull(geo_code), EqualTo(geo_code,CZ06)]" in plan


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="time, value"):
        canonical_rows(spark.createDataFrame([("CZ",)], "geo_code string"), "a", "b", "c", "d")


@pytest.mark.parametrize("value", [0.0, 3.0, -2.0, 12345.65, 0.1234565, 1234567.8, 1e15, 1.5e-7, 0.00012345, 2.5, 112946.26, 0.5000005, 99999.95, -1234.565])
def test_value_text_equals_c_formatting(spark, value):
    want = str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.6g}"
    assert spark.range(1).select(format_value(F.lit(value)).alias("t")).first().t == want


def test_value_text_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r.t for r in rows.select(format_value(F.col("v")).alias("t")).collect()] == ["", "", "inf"]


def test_quality_merge(spark):
    rows = spark.createDataFrame([(True, "p"), (True, " "), (False, None)], "r boolean, f string")
    assert [r.q for r in rows.select(merge_quality(F.col("r"), F.col("f")).alias("q")).collect()] == ["recoded,p", "recoded", ""]


def test_years_and_stamps(spark):
    one = spark.range(1)
    assert one.select(year_list(F.lit("2011-2013,2016")).alias("y")).first().y == [2011, 2012, 2013, 2016]
    assert one.select(year_list(F.lit("2011-x")).alias("y")).first().y is None
    for text, want in [("2019-11-05T04:17:59Z\n", "2019-11"), ("", None), ("soon", None), ("2019-11-05", None)]:
        assert one.select(month_stamp(F.lit(text)).alias("m")).first().m == want
