"""Canonical table: projection, windows, pivots, snapshots, reports, writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.cells import format_value, merge_quality
from ..functions.periods import in_window, period_key
from ..operators.incremental import materialization_status
from ..operators.pivot import last_periods, latest_per_zone, pivot_indicators
from ..operators.projection import duplicate_keys, project_indicators, recode, recode_verdict, restrict_to_zones
from ..operators.reports import indicator_profile, levels_present
from ..plans.indicators import query_indicators, request_indicators
from ..session import cut_lineage, shared_dir
from ..sources.canonical import drop_indicator, materialized_ids, read_canonical, write_canonical
from .base import query, table
from .shapes import CHANGES_SQL, canonical, changes, cube, cube_columns, specs, zones

TEXT = """CASE WHEN value = floor(value) AND abs(value) < 1e15 THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
          ELSE printf('%.6g', value) END"""
CELL = f"({TEXT}) || CASE WHEN quality <> '' THEN ' [' || quality || ']' ELSE '' END"
PERIOD_SQL = """
CASE WHEN regexp_matches(time, '^[0-9]{4}$') THEN 0 WHEN regexp_matches(time, '-S[0-9]+$') THEN 1
     WHEN regexp_matches(time, '-Q[0-9]+$') THEN 2 ELSE 3 END"""
MONTH_SQL = """
CASE WHEN regexp_matches(time, '^[0-9]{4}$') THEN 0
     WHEN regexp_matches(time, '-Q[0-9]+$') THEN (CAST(right(time, 1) AS INT) - 1) * 3 + 1 ELSE CAST(right(time, 2) AS INT) END"""
IDS = ["order_value", "order_count", "order_count_q"]


def at_rest(spark, sf):
    """The canonical table written as partitions, then read back: ingestion, then query."""
    root = shared_dir(spark, "canonical")
    write_canonical(canonical(spark, sf), root, [*IDS, "supplier_count"])
    return read_canonical(spark, root)


@query("project_order_value", "canon", sql="""
SELECT geo_code, time, value, quality FROM canon WHERE indicator = 'order_value'""")
def project_order_value(spark, sf):
    wanted = specs(spark).where(F.col("id") == "order_value")
    return project_indicators(cube(spark, sf), wanted, zones(spark, sf)).select("geo_code", "time", "value", "quality")


@query("project_all_specs", "canon", sql="""
SELECT indicator, geo_code, time, value, quality, unit, source FROM canon WHERE source = 'eurostat'""")
def project_all_specs(spark, sf):
    return project_indicators(cube(spark, sf), specs(spark), zones(spark, sf)).drop("source_date")


@query("recode_vintage", "cube", "zones", sql=f"""
SELECT freq, unit, coalesce(new_code, geo) AS geo_code, time, value,
       concat_ws(',', CASE WHEN new_code IS NOT NULL THEN 'recoded' END, nullif(trim(flag), '')) AS quality
FROM cube LEFT JOIN (SELECT old_code, new_code FROM {CHANGES_SQL} WHERE bijective = 1 AND new_code <> old_code) m ON geo = old_code
WHERE coalesce(new_code, geo) IN (SELECT geo_code FROM zones WHERE level IN ('NUTS0', 'NUTS1'))""")
def recode_vintage(spark, sf):
    rows = cube_columns(spark, sf).withColumnRenamed("geo", "geo_code")
    moved = restrict_to_zones(recode(rows, changes(spark), 2021), zones(spark, sf), ["NUTS0", "NUTS1"])
    return moved.select("freq", "unit", "geo_code", "time", "value", merge_quality(F.col("recoded"), F.col("flag")).alias("quality"))


@query("recode_duplicates", "cube", sql=f"""
SELECT indicator, geo_code, time, count(*) AS rows FROM (
  SELECT 'orders_' || lower(unit) AS indicator, coalesce(new_code, geo) AS geo_code, time FROM cube
  LEFT JOIN (SELECT old_code, new_code FROM {CHANGES_SQL} WHERE bijective = 1 AND new_code <> old_code) m ON geo = old_code)
GROUP BY indicator, geo_code, time HAVING count(*) > 1""")
def recode_duplicates(spark, sf):
    rows = cube_columns(spark, sf).withColumnRenamed("geo", "geo_code")
    return duplicate_keys(recode(rows, changes(spark), 2021).withColumn("indicator", F.concat(F.lit("orders_"), F.lower("unit"))))


@query("recode_verdicts", "zones", sql=f"""
SELECT geo_code, CASE WHEN ch.old_code IS NULL THEN geo_code ELSE new_code END AS new_code,
       coalesce(bijective = 1, true) AS bijective FROM zones LEFT JOIN {CHANGES_SQL} ON geo_code = ch.old_code""")
def recode_verdicts(spark, sf):
    return recode_verdict(zones(spark, sf).select("geo_code"), changes(spark), 2021)


@query("period_window", "canon", sql="""
SELECT indicator, geo_code, time, value FROM canon
WHERE time >= '1996-Q2' AND (time <= '1998' OR time LIKE '1998-%')""")
def period_window(spark, sf):
    return canonical(spark, sf).where(in_window(F.col("time"), "1996-Q2", "1998")).select("indicator", "geo_code", "time", "value")


@query("period_order", "cube", sql=f"""
SELECT DISTINCT time, CAST(left(time, 4) AS INT) AS year, CAST({MONTH_SQL} AS INT) AS month, CAST({PERIOD_SQL} AS INT) AS grain FROM cube""")
def period_order_query(spark, sf):
    key = period_key(F.col("time"))
    return cube_columns(spark, sf).select("time").distinct().select(
        "time", key["year"].alias("year"), key["month"].alias("month"), key["grain"].alias("grain"))


@query("last_n_periods", "canon", sql=f"""
SELECT indicator, geo_code, time, value FROM canon WHERE source = 'eurostat' AND time IN (
  SELECT time FROM (SELECT DISTINCT time FROM canon WHERE source = 'eurostat')
  ORDER BY CAST(left(time, 4) AS INT) DESC, {MONTH_SQL} DESC, {PERIOD_SQL} DESC, time DESC LIMIT 3)""")
def last_n(spark, sf):
    rows = canonical(spark, sf).where("source = 'eurostat'")
    return last_periods(rows, 3).select("indicator", "geo_code", "time", "value")


_PIVOT = ", ".join(f"coalesce(max(CASE WHEN indicator = '{i}' THEN {CELL} END), '') AS {i}" for i in [*IDS, "never_built"])


@query("pivot_indicators", "canon", sql=f"""
SELECT geo_code, time, {_PIVOT} FROM canon WHERE source = 'eurostat' GROUP BY geo_code, time""")
def pivot(spark, sf):
    return pivot_indicators(canonical(spark, sf).where(F.col("indicator").isin(IDS)), [*IDS, "never_built"])


@query("latest_snapshot", "canon", sql="""
SELECT indicator, geo_code, time, value, quality FROM canon
WHERE indicator = 'supplier_count' AND time = (SELECT max(time) FROM canon c WHERE c.indicator = 'supplier_count')""")
def latest_snapshot(spark, sf):
    return latest_per_zone(canonical(spark, sf).where("indicator = 'supplier_count'")).select(
        "indicator", "geo_code", "time", "value", "quality")


_SPREAD = f"""
p AS (SELECT * FROM canon WHERE indicator IN ('order_value', 'order_count') AND {{keep}}),
s AS (SELECT geo_code, time AS st, ({TEXT}) || ' [snapshot ' || time || ']' AS again, {CELL} AS own
      FROM canon WHERE indicator = 'supplier_count' AND time = '2001-08'),
w AS (SELECT geo_code, time, max(CASE WHEN indicator = 'order_value' THEN {CELL} END) AS order_value,
      max(CASE WHEN indicator = 'order_count' THEN {CELL} END) AS order_count FROM p GROUP BY geo_code, time)
SELECT geo_code, coalesce(time, st) AS time, coalesce(order_value, '') AS order_value,
       coalesce(CASE WHEN time IS NULL THEN own ELSE again END, '') AS supplier_count, coalesce(order_count, '') AS order_count
FROM w FULL JOIN s USING (geo_code)"""


def _spread_sql(keep: str) -> str:
    # The views come first, so the local ones continue the same WITH clause.
    return "SELECT * FROM (WITH " + _SPREAD.format(keep=keep).strip() + ")"


@query("snapshot_spread", "canon", sql=_spread_sql(
    "time IN (SELECT DISTINCT time FROM canon WHERE indicator IN ('order_value', 'order_count') ORDER BY time DESC LIMIT 3)"))
def snapshot_spread(spark, sf):
    return query_indicators(at_rest(spark, sf), ["order_value", "supplier_count", "order_count"],
                            snapshots=["supplier_count"]).table


@query("snapshot_own_rows", "canon", sql=_spread_sql("time >= '2001' AND geo_code < 'R2'"))
def snapshot_own_rows(spark, sf):
    """Zones without period rows in the window keep their snapshot on its own date."""
    rows = at_rest(spark, sf).where("geo_code < 'R2' OR indicator = 'supplier_count'")
    return query_indicators(rows, ["order_value", "supplier_count", "order_count"], time_from="2001",
                            snapshots=["supplier_count"]).table


@query("cell_text", sql=f"""
SELECT o_orderkey, {TEXT.replace('value', 'o_totalprice')} AS price, {TEXT.replace('value', '(o_totalprice / 700000)')} AS share FROM orders""")
def cell_text(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", format_value(F.col("o_totalprice")).alias("price"),
        format_value(F.col("o_totalprice") / 700000).alias("share"))


@query("indicator_profile", "canon", sql="""
SELECT indicator, count(*) AS rows, max(source) AS source, max(source_date) AS source_date, min(time) AS time_min, max(time) AS time_max
FROM canon GROUP BY indicator""")
def profile(spark, sf):
    return indicator_profile(canonical(spark, sf)).drop("ingested_at")


@query("provenance", "canon", sql="""
SELECT indicator, max(source) AS source, max(source_date) AS source_date FROM canon GROUP BY indicator""")
def provenance_query(spark, sf):
    ids = [*IDS, "supplier_count"]
    return query_indicators(canonical(spark, sf), ids, time_from="1900", snapshots=["supplier_count"]).provenance.drop("ingested_at")


@query("provenance_by_source", "canon", sql="""
SELECT source, CASE WHEN min(d) = max(d) THEN max(d) ELSE string_agg(indicator || ' ' || d, ', ' ORDER BY indicator) END AS dates,
       count(*) AS indicators FROM (SELECT indicator, source, max(source_date) AS d FROM canon GROUP BY ALL) GROUP BY source""")
def by_source(spark, sf):
    ids = [*IDS, "supplier_count"]
    return query_indicators(canonical(spark, sf), ids, time_from="1900", snapshots=["supplier_count"]).by_source


@query("missing_in_window", "canon", sql="""
SELECT q.indicator, min(time) AS time_min, max(time) AS time_max
FROM (VALUES ('order_value'), ('order_count_q'), ('never_built')) q(indicator) LEFT JOIN canon USING (indicator)
WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.indicator = q.indicator AND c.time >= '2001-Q1') GROUP BY q.indicator""")
def missing(spark, sf):
    return query_indicators(at_rest(spark, sf), ["order_value", "order_count_q", "never_built"], time_from="2001-Q1").missing


@query("snapshot_summary", "canon", sql="""
SELECT 'supplier_count' AS indicator, max(time) AS snapshot_time, 'osm_completeness_unknown' AS qualities,
       bool_or(geo_code IN (SELECT geo_code FROM canon WHERE indicator = 'order_value')) AS repeated
FROM canon WHERE indicator = 'supplier_count'""")
def snapshot_notes(spark, sf):
    return query_indicators(at_rest(spark, sf), ["order_value", "supplier_count"], snapshots=["supplier_count"]).snapshots


@query("levels_present", "canon", sql="""
SELECT DISTINCT indicator, CASE length(geo_code) WHEN 2 THEN 'NUTS0' WHEN 3 THEN 'NUTS1' WHEN 4 THEN 'NUTS2' END AS level FROM canon""")
def levels(spark, sf):
    return levels_present(canonical(spark, sf))


@query("materialization_status", "canon", sql="""
SELECT id, id IN (SELECT indicator FROM canon) AS materialized
FROM (VALUES ('order_value'), ('order_count'), ('order_count_q'), ('supplier_count'), ('never_built')) s(id)""")
def status(spark, sf):
    return materialization_status(specs(spark), canonical(spark, sf)).select("id", "materialized")


@query("bounded_result", "canon", sql=f"""
SELECT geo_code, time, order_value, order_count, order_count_q, n > 400 AS truncated, n AS total FROM (
  SELECT *, row_number() OVER (ORDER BY geo_code, CAST(left(time, 4) AS INT) DESC, {MONTH_SQL} DESC, {PERIOD_SQL} DESC, time DESC) AS rn, count(*) OVER () AS n
  FROM (SELECT geo_code, time, {_PIVOT} FROM canon WHERE source = 'eurostat' GROUP BY geo_code, time)) WHERE rn <= 400""")
def bounded_result(spark, sf):
    return query_indicators(canonical(spark, sf), IDS, time_from="1900").head()


@query("indicator_request", "canon", "zones", sql=f"""
SELECT c.geo_code, time, order_value, coalesce(supplier_count, '') AS supplier_count
FROM (SELECT geo_code, time, {CELL} AS order_value FROM canon WHERE indicator = 'order_value' AND time >= '1997' AND time <= '2000') c
JOIN zones z ON z.geo_code = c.geo_code AND z.level = 'NUTS1'
LEFT JOIN (SELECT geo_code AS g, ({TEXT}) || ' [snapshot 2001-08]' AS supplier_count FROM canon WHERE indicator = 'supplier_count' AND time = '2001-08') s ON g = c.geo_code""")
def indicator_request(spark, sf):
    """A checked request over all zones of a level; that one of its indicators is a snapshot follows from the specs."""
    places = zones(spark, sf)
    codes = [r.geo_code for r in places.where("level = 'NUTS1'").select("geo_code").collect()]
    answer = request_indicators(canonical(spark, sf), specs(spark), places, [" order_value", "supplier_count"], [c.lower() for c in codes], "1997", "2000")
    return answer.table


_MIDDLE = "(SELECT min(geo_code) FROM zones WHERE level = 'NUTS2')"


@query("indicator_request_errors", "zones", sql=f"""
SELECT * FROM (VALUES ('order_value', 'R0AX9', 'unknown_zone'), ('order_value', 'GR12', 'unknown_zone'), ('order_value', {_MIDDLE}, 'level_not_offered'),
  ('never_built', {_MIDDLE}, 'level_not_offered'), ('order_valu', {_MIDDLE}, 'unknown_indicator'), ('never_built', 'R0AX9', 'unknown_zone'), ('never_built', 'GR12', 'unknown_zone'),
  ('order_valu', 'R0AX9', 'unknown_indicator'), ('order_valu', 'GR12', 'unknown_indicator'), (NULL, NULL, 'too_many_indicators'), (NULL, NULL, 'too_many_zones'),
  (NULL, NULL, 'no_indicators'), (NULL, NULL, 'no_zones'), ('never_built', (SELECT min(geo_code) FROM zones WHERE level = 'NUTS3'), 'not_materialized')) e(indicator, zone, error_code)""")
def indicator_request_errors(spark, sf):
    """What is wrong with several requests; none of them gets a table."""
    rows, places, known = canonical(spark, sf), zones(spark, sf), specs(spark)
    finest, middle = (places.where(F.col("level") == level).agg(F.min("geo_code")).first()[0] for level in ("NUTS3", "NUTS2"))
    asked = [(["order_value", "never_built", "order_valu"], ["r0ax9", "GR12", middle.lower()]), ([f"i{k}" for k in range(6)], ["R0"]), (["order_value"], [f"Z{k}" for k in range(101)]),
             ([" "], ["R0"]), (["order_value"], []), (["never_built"], [finest])]
    out = None
    for indicators, codes in asked:
        answer = request_indicators(rows, known, places, indicators, codes)
        found = answer.errors.select("indicator", "zone", "error_code")
        out = found if out is None else out.unionByName(found)
    return out


@query("write_replace_partition", "canon", sql="""
SELECT indicator, geo_code, time, value, quality FROM canon WHERE indicator IN ('order_value', 'supplier_count')
UNION ALL SELECT indicator, geo_code, time, value * 2, quality FROM canon WHERE indicator = 'order_count' AND time >= '1998'""")
def write_replace(spark, sf):
    """Write all, replace one indicator, empty another, then read what is at rest."""
    root = shared_dir(spark, "canonical")
    rows = canonical(spark, sf).withColumn("ingested_at", F.lit(datetime(2001, 9, 1)).cast("timestamp_ntz"))
    write_canonical(rows, root, [*IDS, "supplier_count"])
    again = read_canonical(spark, root, ["order_count"]).where("time >= '1998'").withColumn("value", F.col("value") * 2)
    write_canonical(cut_lineage(again), root, ["order_count"])
    write_canonical(rows.limit(0), root, ["order_count_q"])
    drop_indicator(spark, root, "not_there")
    return read_canonical(spark, root, materialized_ids(spark, root)).select("indicator", "geo_code", "time", "value", "quality")
