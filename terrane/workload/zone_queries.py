"""Zone reference, code rules and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import month_stamp, year_list
from ..functions.zones import (
    code_hint, is_aggregate, is_bijective, level_depth, level_hint, level_of_code, parent_code, zone_country,
)
from ..operators.incremental import merge_years, run_report, year_delta
from ..operators.validate import duplicate_ids, validate_requests, validate_specs
from ..operators.zones import build_changes, city_zones, levels_available, list_zones, nuts_zones, zone_reference
from ..plans.lookup import zones_page
from ..schemas import SPECS
from ..session import cut_lineage
from .base import query, similar_sql, table, view
from .shapes import canonical, cust_requests, nations, specs, zones

_LISTED = "SELECT geo_code, name, level, parent_code FROM zones WHERE "


@query("zone_children", "zones", sql=_LISTED + "level = 'NUTS3' AND geo_code LIKE 'R1%' AND geo_code <> 'R1'")
def zone_children(spark, sf):
    return list_zones(zones(spark, sf), "nuts3", parent="r1")


@query("zone_city_children", "zones", sql=_LISTED + "level = 'CITY' AND parent_code LIKE 'R2%'")
def zone_city_children(spark, sf):
    return list_zones(zones(spark, sf), "CITY", parent="R2")


@query("zone_contains_folded", "zones", sql=_LISTED + "level = 'NUTS2' AND (contains(strip_accents(lower(name)), 'ile r0') OR contains(lower(geo_code), 'ile r0'))")
def zone_contains(spark, sf):
    return list_zones(zones(spark, sf), "NUTS2", contains="ÎLE r0")


@query("zones_page", "zones", sql="""
SELECT geo_code, name, level, parent_code, n > 60 AS truncated, n AS total FROM (
  SELECT *, row_number() OVER (ORDER BY geo_code) AS rn, count(*) OVER () AS n FROM zones WHERE level = 'NUTS3') WHERE rn <= 60""")
def zone_page(spark, sf):
    return zones_page(zones(spark, sf), "NUTS3", limit=60)


@query("zone_levels", "zones", sql="SELECT DISTINCT level FROM zones")
def zone_levels(spark, sf):
    return levels_available(zones(spark, sf))


@query("zone_code_rules", "zones", sql="""
SELECT geo_code, CASE length(geo_code) WHEN 2 THEN 'NUTS0' WHEN 3 THEN 'NUTS1' WHEN 4 THEN 'NUTS2' WHEN 5 THEN 'NUTS3' WHEN 6 THEN 'CITY' END AS level_by_length,
       CASE WHEN length(geo_code) > 2 THEN left(geo_code, -1) END AS parent, left(geo_code, 2) AS country, length(geo_code) - 2 AS depth
FROM zones""")
def zone_code_rules(spark, sf):
    code = F.col("geo_code")
    return zones(spark, sf).select(
        "geo_code", level_of_code(code).alias("level_by_length"), parent_code(code).alias("parent"),
        zone_country(code).alias("country"), level_depth(F.col("level")).cast("bigint").alias("depth"))


view("odd_codes", "zones", sql="""
SELECT DISTINCT code FROM (SELECT unnest([geo_code, 'GR' || right(geo_code, 2), 'UK' || left(geo_code, 1), 'EU27_' || geo_code, 'EA1' || geo_code, 'EAX', 'GB', 'EFTA']) AS code FROM zones)
""")


@query("zone_hints", "odd_codes", sql="""
SELECT code, CASE WHEN starts_with(code, 'GR') THEN 'use:EL' || substr(code, 3) WHEN code = 'GB' OR starts_with(code, 'UK') THEN 'outside_nomenclature'
       WHEN regexp_matches(code, '^(EU|EA|EEA|EFTA)($|[12_])') THEN 'aggregate:use_cube' END AS hint,
       regexp_matches(code, '^(EU|EA|EEA|EFTA)($|[12_])') AS aggregate FROM odd_codes""")
def zone_hints(spark, sf):
    c = F.col("geo_code")
    made = F.array(c, F.concat(F.lit("GR"), F.right(c, F.lit(2))), F.concat(F.lit("UK"), F.left(c, F.lit(1))), F.concat(F.lit("EU27_"), c),
                   F.concat(F.lit("EA1"), c), F.lit("EAX"), F.lit("GB"), F.lit("EFTA"))
    codes = zones(spark, sf).select(F.explode(made).alias("code")).distinct()
    return codes.select("code", code_hint(F.col("code")).alias("hint"), is_aggregate(F.col("code")).alias("aggregate"))


@query("zone_level_hints", "zones", sql="""
SELECT geo_code, CASE level WHEN 'NUTS0' THEN 'list:NUTS1<' || geo_code WHEN 'NUTS1' THEN 'list:NUTS2<' || geo_code
       WHEN 'NUTS3' THEN 'ancestor:' || left(geo_code, 4) WHEN 'CITY' THEN 'list:NUTS2' ELSE 'ancestor:' || left(geo_code, 4) END AS hint
FROM zones WHERE level <> 'NUTS2'""")
def zone_level_hints(spark, sf):
    offered = F.array(F.lit("NUTS2"), F.lit("NUTS1"))
    return zones(spark, sf).where("level <> 'NUTS2'").select(
        "geo_code", level_hint(F.col("geo_code"), F.col("level"), offered).alias("hint"))


@query("zone_reference_build", "nat", "cust", sql="""
SELECT c1 AS geo_code, 'NUTS1' AS level, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE c1 END AS name, c0 AS parent_code, CAST(2024 AS INT) AS valid_from, c0 AS country FROM nat
UNION ALL SELECT * FROM (SELECT c3, 'CITY', 'City ' || c3, CASE WHEN c_custkey % 2 = 0 THEN c2 ELSE c1 END, 2024, c0
  FROM (SELECT *, row_number() OVER (PARTITION BY c3 ORDER BY CASE WHEN c_custkey % 2 = 0 THEN c2 ELSE c1 END DESC) AS rn FROM cust) WHERE rn = 1)""")
def zone_reference_build(spark, sf):
    """Reference rows from feature properties; nations appear twice and the later part wins."""
    from .shapes import customers

    nat = nations(spark, sf)

    def properties(**fields):
        return F.map_filter(F.create_map(*[v for k, c in fields.items() for v in (F.lit(k), c)]), lambda _, v: v.isNotNull())

    early = nat.select(properties(NUTS_ID=F.col("c1"), NUTS_NAME=F.lit("old"), CNTR_CODE=F.col("c0")).alias("properties"))
    late = nat.select(properties(
        NUTS_ID=F.col("c1"), NAME_LATN=F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(""),
        CNTR_CODE=F.col("c0")).alias("properties"))
    even = F.col("c_custkey") % 2 == 0
    city = customers(spark, sf).select(properties(
        URAU_CODE=F.col("c3"), URAU_NAME=F.concat(F.lit("City "), "c3"), CNTR_CODE=F.col("c0"),
        NUTS3_2024=F.when(even, F.col("c2")), NUTS3_2021=F.col("c1")).alias("properties"))
    return zone_reference([nuts_zones(early, "NUTS1"), nuts_zones(late, "NUTS1"), city_zones(city)])


@query("code_changes_build", sql="""
WITH t AS (SELECT CASE WHEN p_size % 7 = 0 THEN '' ELSE 'A' || p_partkey END AS o, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'B' || p_partkey END AS n,
  CASE p_type WHEN 'ECONOMY' THEN 'Code change' WHEN 'STANDARD' THEN 'Merged' WHEN 'PROMO' THEN 'Name change' ELSE '' END AS ch FROM part)
SELECT nullif(o, '') AS old_code, nullif(n, '') AS new_code, CAST(2021 AS INT) AS vintage_from, CAST(2024 AS INT) AS vintage_to,
       CAST(o <> '' AND n <> '' AND ch <> 'Merged' AS INT) AS bijective, nullif(ch, '') AS change FROM t WHERE o <> '' OR n <> ''""")
def code_changes_build(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    rows = table(spark, sf, "part").select(
        F.when(size % 7 == 0, "").otherwise(F.concat(F.lit("A"), "p_partkey")).alias("old_code"),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("B"), "p_partkey")).alias("new_code"),
        F.when(kind == "ECONOMY", "Code change").when(kind == "STANDARD", "Merged").when(kind == "PROMO", "Name change").otherwise("").alias("change"))
    return build_changes(rows)


# -------------------------------------------------------------------- requests

view("requests", "cust", sql="""
SELECT 'q' || (o_custkey % 50) AS request_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'order_value' WHEN 1 THEN 'order_count' WHEN 2 THEN 'order_count_q' WHEN 3 THEN 'supplier_count' WHEN 4 THEN 'never_built'
            ELSE CASE WHEN o_custkey % 50 < 25 THEN 'order_value' ELSE 'gdp' END END AS indicator,
       CASE o_orderkey % 5 WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN CASE WHEN o_custkey % 50 < 40 THEN c1 ELSE 'GR30' END ELSE CASE WHEN o_custkey % 50 < 30 THEN c0 ELSE 'EU27_2020' END END AS zone
FROM orders JOIN cust ON o_custkey = c_custkey
""")


@query("validate_requests", "requests", "zones", sql="""
SELECT request_id, indicator, zone, error_code,
  CASE error_code WHEN 'unknown_zone' THEN CASE WHEN zone LIKE 'GR%' THEN 'use:EL' || substr(zone, 3) WHEN zone LIKE 'EU27%' THEN 'aggregate:use_cube' || CASE WHEN indicator IN ('order_value', 'order_count', 'order_count_q', 'never_built') THEN ':orders_cube' ELSE '' END END
  WHEN 'level_not_offered' THEN CASE indicator
      WHEN 'supplier_count' THEN CASE level WHEN 'NUTS0' THEN 'list:NUTS1<' || zone ELSE 'ancestor:' || left(zone, 3) END
      WHEN 'never_built' THEN 'list:NUTS3<' || zone ELSE 'ancestor:' || left(zone, 3) END END AS hint
FROM (SELECT r.*, level, CASE WHEN ni > 5 THEN 'too_many_indicators' WHEN nz > 100 THEN 'too_many_zones'
    WHEN indicator = 'gdp' THEN 'unknown_indicator' WHEN level IS NULL THEN 'unknown_zone'
    WHEN NOT CASE indicator WHEN 'order_value' THEN level IN ('NUTS0', 'NUTS1') WHEN 'order_count' THEN level IN ('NUTS0', 'NUTS1', 'NUTS2')
         WHEN 'order_count_q' THEN level IN ('NUTS0', 'NUTS1') WHEN 'supplier_count' THEN level = 'NUTS1' ELSE level = 'NUTS3' END THEN 'level_not_offered'
    WHEN indicator = 'never_built' THEN 'not_materialized' END AS error_code
  FROM requests r JOIN (SELECT request_id, count(DISTINCT indicator) AS ni, count(DISTINCT zone) AS nz FROM requests GROUP BY request_id) USING (request_id)
  LEFT JOIN zones ON geo_code = zone)""")
def validate(spark, sf):
    present = cut_lineage(canonical(spark, sf).select("indicator").distinct())
    return validate_requests(cust_requests(spark, sf), specs(spark), zones(spark, sf), present)


view("misspelt", sql="""
SELECT DISTINCT 'q' || c_custkey AS request_id,
       CASE c_custkey % 4 WHEN 0 THEN 'order_valeu' WHEN 1 THEN 'ordercount' WHEN 2 THEN 'suplier_counts' ELSE 'rainfall' END AS indicator,
       'R' || (c_custkey % 9) || chr(65 + CAST(c_custkey % 7 AS INT)) || substr('ABFHMZ', CAST(c_custkey % 6 + 1 AS INT), 1) || CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE '' END AS zone
FROM customer
""")


@query("request_suggestions", "misspelt", "zones", sql=f"""
SELECT request_id, indicator, zone, 'unknown_indicator' AS error_code, 'closest:' || closest AS hint FROM misspelt LEFT JOIN (
  SELECT word, string_agg(lower(term), ',' ORDER BY ratio DESC, term) AS closest FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, term) AS place FROM (
      {similar_sql("SELECT indicator AS x FROM misspelt", "SELECT unnest(['order_value', 'order_count', 'order_count_q', 'supplier_count', 'never_built']) AS x", (3, 5))})) WHERE place <= 3 GROUP BY word) s
  ON s.word = upper(indicator)
UNION ALL SELECT request_id, 'order_value', zone, CASE WHEN level IS NULL THEN 'unknown_zone' WHEN level NOT IN ('NUTS0', 'NUTS1') THEN 'level_not_offered' END,
       CASE WHEN level IS NULL THEN 'closest:' || closest WHEN level NOT IN ('NUTS0', 'NUTS1') THEN 'ancestor:' || left(zone, 3) END
FROM (SELECT DISTINCT request_id, zone FROM misspelt) m LEFT JOIN zones ON geo_code = zone LEFT JOIN (
  SELECT word, string_agg(term, ',' ORDER BY ratio DESC, term) AS closest FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY ratio DESC, term) AS place FROM (
      {similar_sql("SELECT zone AS x FROM misspelt WHERE zone NOT IN (SELECT geo_code FROM zones)", "SELECT geo_code AS x FROM zones", (1, 2))})) WHERE place <= 3 GROUP BY word) s ON s.word = zone""")
def request_suggestions(spark, sf):
    """Requests with misspelt ids, and with zones of which some don't exist: what they may have meant."""
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, "order_valeu").when(key % 4 == 1, "ordercount").when(key % 4 == 2, "suplier_counts").otherwise("rainfall")
    letter = F.substr(F.lit("ABFHMZ"), (key % 6 + 1).cast("int"), F.lit(1))
    zone = F.concat(F.lit("R"), key % 9, F.char(F.lit(65) + key % 7), letter, F.when(key % 5 == 0, "X").otherwise(""))
    asked = table(spark, sf, "customer").select(F.concat(F.lit("q"), "c_custkey").alias("request_id"), name.alias("indicator"), zone.alias("zone")).distinct()
    # a request has one indicator here, so each is checked by itself
    first = validate_requests(asked, specs(spark), zones(spark, sf), canonical(spark, sf))
    second = validate_requests(asked.withColumn("indicator", F.lit("order_value")), specs(spark), zones(spark, sf), canonical(spark, sf))
    return first.unionByName(second)


view("partspecs", sql="""
SELECT CASE WHEN p_size = 13 THEN 'bad id ' || p_partkey ELSE 'spec_' || (p_partkey // 2) END AS id,
       CASE WHEN p_type = 'PROMO' THEN 'census' WHEN p_type = 'ECONOMY' THEN 'osm' ELSE 'eurostat' END AS source,
       CASE WHEN p_size % 4 = 0 THEN 'D' ELSE 'A' END AS frequency, CASE WHEN p_size % 6 = 0 THEN 'LAU' ELSE 'NUTS2' END AS level,
       CASE WHEN p_size % 9 = 0 THEN 2016 ELSE 2021 END AS vintage, p_size FROM part
""")


@query("validate_specs", "partspecs", sql="""
SELECT id, 'id_malformed' AS problem FROM partspecs WHERE id LIKE 'bad%'
UNION ALL SELECT id, 'source_unknown' FROM partspecs WHERE source = 'census'
UNION ALL SELECT id, 'frequency_unknown' FROM partspecs WHERE frequency = 'D'
UNION ALL SELECT id, 'level_unknown' FROM partspecs WHERE level = 'LAU'
UNION ALL SELECT id, 'vintage_unknown' FROM partspecs WHERE vintage = 2016
UNION ALL SELECT id, 'dataset_missing' FROM partspecs WHERE source = 'eurostat' AND p_size % 8 = 0
UNION ALL SELECT id, 'tags_empty' FROM partspecs WHERE source = 'osm' AND p_size % 2 = 0
UNION ALL SELECT id, 'id_duplicated' FROM partspecs GROUP BY id HAVING count(*) > 1""")
def validate_all_specs(spark, sf):
    return validate_specs(part_specs(spark, sf))


@query("duplicate_ids", "partspecs", sql="SELECT id, count(*) AS times FROM partspecs GROUP BY id HAVING count(*) > 1")
def duplicates(spark, sf):
    return duplicate_ids(part_specs(spark, sf))


def part_specs(spark, sf):
    """Parts as a large spec table with deliberate faults."""
    size, kind = F.col("p_size"), F.col("p_type")
    source = F.when(kind == "PROMO", "census").when(kind == "ECONOMY", "osm").otherwise("eurostat")
    points = source == "osm"
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in SPECS["extraction"].dataType}
    filled = nothing | {
        "dataset": F.when((source == "eurostat") & (size % 8 != 0), "d1"),
        "tags": F.when(points & (size % 2 != 0), F.array(F.struct(F.lit("amenity").alias("key"), F.lower("p_type").alias("value")))),
        "geometry": F.when(points, F.array(F.lit("node"))),
    }
    ident = F.when(size == 13, F.concat(F.lit("bad id "), "p_partkey")).otherwise(
        F.concat(F.lit("spec_"), F.floor(F.col("p_partkey") / 2)))
    return table(spark, sf, "part").select(
        ident.alias("id"), F.col("p_name").alias("label"), F.lit("COUNT").alias("unit"), source.alias("source"),
        F.when(size % 4 == 0, "D").otherwise("A").alias("frequency"),
        F.array(F.when(size % 6 == 0, "LAU").otherwise("NUTS2")).alias("geo_levels"),
        F.when(size % 9 == 0, 2016).otherwise(2021).alias("nuts_vintage"), F.lit(None).cast("string").alias("description"),
        F.struct(*[c.alias(n) for n, c in filled.items()]).alias("extraction"))


# ----------------------------------------------------------------- small rules

@query("year_lists", sql="""
SELECT DISTINCT text, years FROM (SELECT (1990 + p_size) || '-' || (1992 + p_size) || ', ' || (2060 - p_size) AS text,
  (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT DISTINCT unnest([1990 + p_size, 1991 + p_size, 1992 + p_size, 2060 - p_size]) AS y)) AS years FROM part)""")
def year_lists(spark, sf):
    size = F.col("p_size")
    text = F.concat((size + 1990).cast("string"), F.lit("-"), (size + 1992).cast("string"), F.lit(", "), (2060 - size).cast("string"))
    return table(spark, sf, "part").select(text.alias("text")).distinct().select(
        "text", F.array_join(year_list(F.col("text")), ",").alias("years"))


@query("month_stamps", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m') END AS month FROM events""")
def month_stamps(spark, sf):
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), day, F.lit("T"), clock, F.lit("Z\n"))).when(
        F.col("event_id") % 3 == 1, day).otherwise("")
    return table(spark, sf, "events").select("event_id", month_stamp(text.cast("string")).alias("month"))


@query("bijective_verdicts", sql="""
SELECT p_partkey, p_size % 5 <> 0 AND p_type IN ('ECONOMY', 'PROMO') AS bijective FROM part""")
def bijective_verdicts(spark, sf):
    change = F.when(F.col("p_type") == "ECONOMY", "Code change").when(F.col("p_type") == "PROMO", F.lit(None).cast("string")).otherwise("Split")
    new = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string")).otherwise("X")
    return table(spark, sf, "part").select("p_partkey", is_bijective(F.lit("A"), new, change).alias("bijective"))


# ------------------------------------------------------------------ increments

@query("year_delta", "canon", sql="""
SELECT indicator, CAST(y AS INT) AS year FROM
  (SELECT indicator, max(CAST(left(time, 4) AS INT)) - CASE indicator WHEN 'order_value' THEN 2 ELSE 0 END AS last FROM canon GROUP BY indicator) l,
  (SELECT unnest([1999, 2000, 2001, 2002]) AS y) WHERE y > last""")
def years_due(spark, sf):
    year = F.left("time", F.lit(4)).cast("int")
    last = canonical(spark, sf).groupBy("indicator").agg(
        (F.max(year) - F.when(F.col("indicator") == "order_value", 2).otherwise(0)).alias("last_year"))
    return year_delta(last.select("indicator"), [2002, 1999, 2000, 2001], last)


@query("merge_years", "canon", sql="""
SELECT indicator, geo_code, time, CASE WHEN time >= '2000' THEN value + 1 ELSE value END AS value FROM canon WHERE indicator = 'order_count'
UNION ALL SELECT indicator, geo_code, time, value FROM canon WHERE indicator = 'order_value'""")
def merge(spark, sf):
    rows = canonical(spark, sf).select("indicator", "geo_code", "time", "value")
    fresh = rows.where("indicator = 'order_count' AND time >= '2000'").withColumn("value", F.col("value") + 1)
    return merge_years(rows.where(F.col("indicator").isin("order_count", "order_value")), fresh)


@query("run_report", sql="""
SELECT event_type AS source, CASE WHEN value > 40 THEN 'failed' WHEN value > 20 THEN 'updated' ELSE 'unchanged' END AS status, count(*) AS items,
       coalesce(string_agg(DISTINCT CASE WHEN value > 40 THEN 'code ' || (user_id % 3) END, '; ' ORDER BY CASE WHEN value > 40 THEN 'code ' || (user_id % 3) END), '') AS reasons
FROM events GROUP BY ALL""")
def report(spark, sf):
    v = F.col("value")
    return run_report(table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.when(v > 40, "failed").when(v > 20, "updated").otherwise("unchanged").alias("status"),
        F.concat(F.lit("code "), F.col("user_id") % 3).alias("reason")))
