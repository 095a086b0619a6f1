"""Zones, cubes, points, rasters and calls derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box_geometry
from ..functions.zones import level_of_code
from ..operators.coverage import Grid
from ..operators.projection import project_indicators
from ..schemas import CHANGES, SPECS
from .base import table, view

# ---------------------------------------------------------------------- zones

view("nat", sql="""
SELECT n_nationkey, n_name, 'R' || n_regionkey AS c0,
       'R' || n_regionkey || chr(65 + n_nationkey // 5) AS c1 FROM nation
""")
view("cust", "nat", sql="""
SELECT c_custkey, c0, c1, c1 || left(c_mktsegment, 1) AS c2,
       c1 || left(c_mktsegment, 1) || (c_custkey % 4) AS c3, c_mktsegment
FROM customer JOIN nat ON c_nationkey = n_nationkey
""")
view("zones", "nat", "cust", sql="""
SELECT 'R' || r_regionkey AS geo_code, 'NUTS0' AS level, r_name AS name,
       CAST(NULL AS VARCHAR) AS parent_code, 'R' || r_regionkey AS country FROM region
UNION ALL SELECT c1, 'NUTS1', replace(n_name, 'NATION', 'Région'), c0, c0 FROM nat
UNION ALL SELECT DISTINCT c2, 'NUTS2', 'Île ' || c2, c1, c0 FROM cust
UNION ALL SELECT DISTINCT c3, 'NUTS3', 'Forêt ' || c3, c2, c0 FROM cust
UNION ALL SELECT c1 || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || 'C', 'CITY', min(s_name),
       c1 || 'A' || (min(s_suppkey) % 4), c0
  FROM supplier JOIN nat ON s_nationkey = n_nationkey GROUP BY c1, c0, s_suppkey % 100
""")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.concat(F.lit("R"), "n_regionkey").alias("c0"),
        F.concat(F.lit("R"), "n_regionkey", F.char(F.lit(65) + F.floor(F.col("n_nationkey") / 5))).alias("c1"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c2 = F.concat("c1", F.left("c_mktsegment", F.lit(1)))
    return table(spark, sf, "customer").join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c0", "c1", c2.alias("c2"), F.concat(c2, F.col("c_custkey") % 4).alias("c3"), "c_mktsegment")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    nat, cust = nations(spark, sf), customers(spark, sf)
    empty = F.lit(None).cast("string")
    region = F.concat(F.lit("R"), "r_regionkey")

    def rows(df: DataFrame, code, level: str, name, parent, country) -> DataFrame:
        return df.select(F.lit(level).alias("level"), code.alias("geo_code"), name.alias("name"),
                         parent.alias("parent_code"), F.lit(2024).alias("valid_from"), country.alias("country"))

    c = F.col
    cities = table(spark, sf, "supplier").join(nat, c("s_nationkey") == c("n_nationkey")).groupBy(
        "c1", "c0", (c("s_suppkey") % 100).alias("k")).agg(F.min("s_name").alias("name"), F.min("s_suppkey").alias("first"))
    return (
        rows(table(spark, sf, "region"), region, "NUTS0", c("r_name"), empty, region)
        .unionByName(rows(nat, c("c1"), "NUTS1", F.replace("n_name", F.lit("NATION"), F.lit("Région")), c("c0"), c("c0")))
        .unionByName(rows(cust.select("c2", "c1", "c0").distinct(), c("c2"), "NUTS2", F.concat(F.lit("Île "), "c2"), c("c1"), c("c0")))
        .unionByName(rows(cust.select("c3", "c2", "c0").distinct(), c("c3"), "NUTS3", F.concat(F.lit("Forêt "), "c3"), c("c2"), c("c0")))
        .unionByName(rows(cities, F.concat("c1", F.lpad(c("k").cast("string"), 2, "0"), F.lit("C")), "CITY", c("name"),
                          F.concat("c1", F.lit("A"), c("first") % 4), c("c0")))
    )


# ----------------------------------------------------------------------- cube

view("cube_base", "cust", sql="""
SELECT c0, c1, c2, strftime(o_orderdate, '%Y-%m') AS ym, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v,
       count(*) AS n, max(o_orderstatus) AS st
FROM orders JOIN cust ON o_custkey = c_custkey GROUP BY ALL
""")
view("cube_agg", "cube_base", sql="""
SELECT freq, geo, CASE freq WHEN 'A' THEN left(ym, 4)
         WHEN 'Q' THEN left(ym, 4) || '-Q' || ((CAST(right(ym, 2) AS INT) + 2) // 3) ELSE ym END AS time,
       sum(v) AS v, sum(n) AS n, max(st) AS st
FROM (SELECT *, unnest(['A', 'Q', 'M']) AS freq FROM
        (SELECT *, unnest([c0, c1, c2, 'EU27_2020']) AS geo FROM cube_base)) GROUP BY ALL
""")
view("cube", "cube_agg", sql="""
SELECT freq, 'VAL' AS unit, geo, time, CAST(v AS DOUBLE) AS value, CASE WHEN st = 'P' THEN 'p' ELSE '' END AS flag FROM cube_agg
UNION ALL
SELECT freq, 'CNT', geo, time, CAST(n AS DOUBLE), CASE WHEN st = 'P' THEN 'p' ELSE '' END FROM cube_agg
""")

CUBE_DIMS = ["freq", "unit", "geo"]
DATASET = "orders_cube"


def cube_columns(spark: SparkSession, sf: str) -> DataFrame:
    """`freq, unit, geo, time, value, flag`: orders by zone, period and measure.

    Orders are summed once at the finest grain; the levels and frequencies are
    rolled up from that.
    """
    base = table(spark, sf, "orders").join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c0", "c1", "c2", F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    year = F.left("ym", F.lit(4))
    quarter = F.concat(year, F.lit("-Q"), F.floor((F.right("ym", F.lit(2)).cast("int") + 2) / 3))
    periods = F.array(*[F.struct(F.lit(f).alias("freq"), t.alias("time")) for f, t in
                        (("A", year), ("Q", quarter), ("M", F.col("ym")))])
    geos = F.array(F.col("c0"), F.col("c1"), F.col("c2"), F.lit("EU27_2020"))
    rolled = base.select("v", "n", "open", F.explode(periods).alias("p"), geos.alias("geos")).select(
        "v", "n", "open", "p.freq", "p.time", F.explode("geos").alias("geo")).groupBy("freq", "geo", "time").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), F.bool_or("open").alias("open"))
    measures = F.array(F.struct(F.lit("VAL").alias("unit"), F.col("v").cast("double").alias("value")),
                       F.struct(F.lit("CNT").alias("unit"), F.col("n").cast("double").alias("value")))
    return rolled.select("freq", "geo", "time", F.when(F.col("open"), "p").otherwise("").alias("flag"),
                         F.explode(measures).alias("m")).select("freq", "m.unit", "geo", "time", "m.value", "flag")


def cube(spark: SparkSession, sf: str) -> DataFrame:
    """The same cube as long rows with a map of dimensions."""
    pairs = [x for d in CUBE_DIMS for x in (F.lit(d), F.col(d))]
    dataset = F.concat(F.lit("orders_"), F.when(F.col("freq").isin("A", "Q", "M"), "cube").otherwise("other"))
    return cube_columns(spark, sf).select(dataset.alias("dataset"), F.create_map(*pairs).alias("dims"), "time", "value", "flag")


def _spec(id: str, unit: str, source: str, frequency: str, levels: list[str], vintage: int = 2024, **extraction) -> T.Row:
    fields = {f: None for f in SPECS["extraction"].dataType.names} | extraction
    return (id, id.replace("_", " "), unit, source, frequency, levels, vintage, None, fields)


def specs(spark: SparkSession) -> DataFrame:
    eu = dict(dataset=DATASET, value_dim="geo", time_dim="time")
    return spark.createDataFrame([
        _spec("order_value", "EUR", "eurostat", "A", ["NUTS0", "NUTS1"], filters={"freq": "A", "unit": "VAL"}, **eu),
        _spec("order_count", "COUNT", "eurostat", "A", ["NUTS0", "NUTS1", "NUTS2"], filters={"freq": "A", "unit": "CNT"}, **eu),
        _spec("order_count_q", "COUNT", "eurostat", "Q", ["NUTS0", "NUTS1"], filters={"freq": "Q", "unit": "CNT"}, **eu),
        _spec("supplier_count", "COUNT", "osm", "SNAPSHOT", ["NUTS1"], tags=[("office", "supplier")], geometry=["node"], aggregation="count"),
        _spec("never_built", "COUNT", "eurostat", "A", ["NUTS3"], filters={"freq": "A", "unit": "NONE"}, **eu),
    ], SPECS)


# -------------------------------------------------------------- canonical rows

_PROJECTED = """
SELECT '{id}' AS indicator, geo AS geo_code, time, value, '{unit}' AS unit, flag AS quality, 'eurostat' AS source,
       '{day}' AS source_date FROM cube JOIN zones z ON z.geo_code = geo
WHERE freq = '{freq}' AND unit = '{measure}' AND level IN ({levels})
"""
view("canon", "cube", "zones", "nat", sql=" UNION ALL ".join([
    _PROJECTED.format(id="order_value", unit="EUR", day="2001-08-02", freq="A", measure="VAL", levels="'NUTS0','NUTS1'"),
    _PROJECTED.format(id="order_count", unit="COUNT", day="2001-08-03", freq="A", measure="CNT", levels="'NUTS0','NUTS1','NUTS2'"),
    _PROJECTED.format(id="order_count_q", unit="COUNT", day="2001-08-03", freq="Q", measure="CNT", levels="'NUTS0','NUTS1'"),
    """SELECT 'supplier_count', c1, month, CAST(n AS DOUBLE), 'COUNT', 'osm_completeness_unknown', 'osm', 'extract 2001-08'
       FROM (SELECT c1, '2001-07' AS month, count(*) FILTER (WHERE s_acctbal > 0) AS n FROM supplier JOIN nat ON s_nationkey = n_nationkey GROUP BY c1
             UNION ALL SELECT c1, '2001-08', count(*) FROM supplier JOIN nat ON s_nationkey = n_nationkey GROUP BY c1)""",
]))


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """`indicator, geo_code, time, value, quality, unit, source, source_date, ingested_at`."""
    days = F.when(F.col("indicator") == "order_value", "2001-08-02").otherwise("2001-08-03")
    cubes = project_indicators(cube(spark, sf), specs(spark), zones(spark, sf)).withColumn("source_date", days)
    held = table(spark, sf, "supplier").join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("c1").agg(
        F.count_if(F.col("s_acctbal") > 0).alias("before"), F.count(F.lit(1)).alias("now"))
    months = F.array(F.struct(F.lit("2001-07").alias("time"), F.col("before").cast("double").alias("value")),
                     F.struct(F.lit("2001-08").alias("time"), F.col("now").cast("double").alias("value")))
    snapshots = held.select(F.col("c1").alias("geo_code"), F.explode(months).alias("m")).select(
        F.lit("supplier_count").alias("indicator"), "geo_code", "m.time", "m.value",
        F.lit("osm_completeness_unknown").alias("quality"), F.lit("COUNT").alias("unit"), F.lit("osm").alias("source"),
        F.lit("extract 2001-08").alias("source_date"))
    return cubes.unionByName(snapshots).withColumn("ingested_at", F.lit("2001-09-01 00:00:00").cast("timestamp_ntz"))


# ------------------------------------------------------------------- geometry

# Corner offsets within a 12 x 7 degree tile: a box with a hole, a triangle, an L.
SHAPES = {
    0: [[(0, 0), (12, 0), (12, 7), (0, 7)], [(4, 2), (8, 2), (8, 5), (4, 5)]],
    1: [[(0, 0), (12, 0), (0, 7)]],
    2: [[(0, 0), (12, 0), (12, 3), (5, 3), (5, 7), (0, 7)]],
}
WEST, SOUTH, TILE_X, TILE_Y = -20.0, 35.0, 12, 7


def _shape_sql() -> str:
    cases = []
    for kind, rings in SHAPES.items():
        points = ", ".join(f"{{'ring': {r}, 'seq': {s}, 'dx': {x}, 'dy': {y}}}"
                           for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring))
        cases.append(f"WHEN {kind} THEN [{points}]")
    return f"CASE n_nationkey % 3 {' '.join(cases)} END"


view("zpts", "nat", sql=f"""
SELECT c1, c0, p.ring AS ring, p.seq AS seq,
       CAST({WEST} AS DOUBLE) + (n_nationkey % 5) * {TILE_X} + p.dx AS x,
       CAST({SOUTH} AS DOUBLE) + (n_nationkey // 5) * {TILE_Y} + p.dy AS y
FROM (SELECT *, unnest({_shape_sql()}) AS p FROM nat)
""")
view("zedge", "zpts", sql="""
SELECT c1, c0, ring, x AS x1, y AS y1,
       coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
FROM zpts WINDOW w AS (PARTITION BY c1, ring ORDER BY seq)
""")
view("zarea", "zedge", sql="""
SELECT c1, sum(a * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS area FROM
  (SELECT c1, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM zedge GROUP BY c1, ring) GROUP BY c1
""")


def zone_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """`geo_code, level, geometry`: one tile per nation."""
    x0 = F.lit(WEST) + (F.col("n_nationkey") % 5) * TILE_X
    y0 = F.lit(SOUTH) + F.floor(F.col("n_nationkey") / 5) * TILE_Y
    shape = None
    for kind, rings in SHAPES.items():
        geometry = F.array(F.array(*[
            F.array(*[F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y")) for dx, dy in ring])
            for ring in rings]))
        test = F.col("n_nationkey") % 3 == kind
        shape = F.when(test, geometry) if shape is None else shape.when(test, geometry)
    return nations(spark, sf).select(F.col("c1").alias("geo_code"), level_of_code(F.col("c1")).alias("level"), shape.alias("geometry"))


# ------------------------------------------------------------------------ poi

view("poi", "cust", sql="""
SELECT c_custkey AS osm_id, c0 AS country, lower(c_mktsegment) AS amenity,
       CASE WHEN is_way THEN 'way' ELSE 'node' END AS osm_type,
       CASE WHEN is_way THEN lon + 0.005 ELSE lon END AS lon, CASE WHEN is_way THEN lat + 0.005 ELSE lat END AS lat
FROM (SELECT *, c_custkey % 3 = 1 AS is_way, -20 + (c_custkey * 7919 % 6000) / 100 AS lon,
             35 + (c_custkey * 104729 % 3500) / 100 AS lat FROM cust)
""")
POI_GRID = Grid(WEST, SOUTH, 1.0, 1.0)


def poi(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as map elements: nodes, and ways drawn as small squares."""
    lon = F.lit(-20) + (F.col("c_custkey") * 7919 % 6000) / 100
    lat = F.lit(35) + (F.col("c_custkey") * 104729 % 3500) / 100
    way = F.col("c_custkey") % 3 == 1
    square = box_geometry(F.col("lon") - 0.005, F.col("lat") - 0.005, F.col("lon") + 0.015, F.col("lat") + 0.015)
    return customers(spark, sf).select("*", lon.alias("lon"), lat.alias("lat"), way.alias("is_way")).select(
        F.col("c0").alias("extract"), F.col("c0").alias("country"), F.when(F.col("is_way"), "way").otherwise("node").alias("osm_type"),
        F.col("c_custkey").alias("osm_id"), F.create_map(F.lit("amenity"), F.lower("c_mktsegment")).alias("tags"),
        F.when(F.col("is_way"), "POLYGON").otherwise("POINT").alias("geom_type"), "lon", "lat",
        F.when(F.col("is_way"), square).alias("geometry"))


def poi_specs(spark: SparkSession) -> DataFrame:
    osm = dict(aggregation="count")
    return spark.createDataFrame([
        _spec("machinery_sites", "COUNT", "osm", "SNAPSHOT", ["NUTS1"], tags=[("amenity", "machinery")], geometry=["node", "way", "relation"], **osm),
        _spec("home_sites", "COUNT", "osm", "SNAPSHOT", ["NUTS1"], tags=[("amenity", "household"), ("amenity", "furniture")], geometry=["node", "way"], **osm),
        _spec("building_nodes", "COUNT", "osm", "SNAPSHOT", ["NUTS1"], tags=[("amenity", "building"), ("office", "any")], geometry=["node"], **osm),
    ], SPECS)


view("poi_match", "poi", sql="""
SELECT 'machinery_sites' AS indicator, * FROM poi WHERE amenity = 'machinery'
UNION ALL SELECT 'home_sites', * FROM poi WHERE amenity IN ('household', 'furniture')
UNION ALL SELECT 'building_nodes', * FROM poi WHERE amenity = 'building' AND osm_type = 'node'
""")

# --------------------------------------------------------------------- raster

RASTER_GRID = Grid(WEST, SOUTH, 0.5, 0.5)
view("raster", sql="""
SELECT l_shipdate AS ts, CAST(l_partkey * 7919 % 120 AS INT) AS i, CAST(l_suppkey * 104729 % 70 AS INT) AS j,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS value FROM lineitem
""")
view("cells", "raster", sql="""
SELECT CAST(year(ts) AS VARCHAR) AS time, i, j, avg(value) AS value FROM raster GROUP BY ALL
""")
view("coverage", "zedge", sql="""
SELECT c1, i, j, fraction FROM (
  SELECT c1, i, j, sum(CASE WHEN b <= a THEN 0 WHEN abs(ub - ua) < 1e-12 THEN s * (b - a) * least(greatest(ua, 0), 0.5)
      ELSE s * (b - a) * ((CASE WHEN ub < 0 THEN 0 WHEN ub < 0.5 THEN ub * ub / 2 ELSE 0.5 * ub - 0.125 END)
                        - (CASE WHEN ua < 0 THEN 0 WHEN ua < 0.5 THEN ua * ua / 2 ELSE 0.5 * ua - 0.125 END)) / (ub - ua) END) / 0.25 AS fraction
  FROM (SELECT *, x1 + (a - y1) * (x2 - x1) / (y2 - y1) - cx AS ua, x1 + (b - y1) * (x2 - x1) / (y2 - y1) - cx AS ub FROM
    (SELECT *, greatest(least(y1, y2), cy) AS a, least(greatest(y1, y2), cy + 0.5) AS b,
            CAST(CASE WHEN y2 > y1 THEN 1 ELSE -1 END * orient AS DOUBLE) AS s FROM
      (SELECT e.*, o.orient, i, j, CAST(-20 AS DOUBLE) + i * 0.5 AS cx, CAST(35 AS DOUBLE) + j * 0.5 AS cy
       FROM zedge e
       JOIN (SELECT c1, ring, CASE WHEN (sum(x1 * y2 - x2 * y1) > 0) = (ring = 0) THEN 1 ELSE -1 END AS orient FROM zedge GROUP BY c1, ring) o
         ON o.c1 = e.c1 AND o.ring = e.ring
       JOIN (SELECT c1, min(x1) AS w, max(x1) AS r, min(y1) AS lo, max(y1) AS hi FROM zedge GROUP BY c1) bb ON bb.c1 = e.c1
       JOIN (SELECT unnest(range(120)) AS i) gi ON -20 + i * 0.5 < r AND -20 + (i + 1) * 0.5 > w
       JOIN (SELECT unnest(range(70)) AS j) gj ON 35 + j * 0.5 < hi AND 35 + (j + 1) * 0.5 > lo
       WHERE e.y1 <> e.y2)))
  GROUP BY c1, i, j) WHERE fraction > 1e-9
""")


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raster observations on a half degree grid; undiscounted ones are without data."""
    i = F.col("l_partkey") * 7919 % 120
    j = F.col("l_suppkey") * 104729 % 70
    return table(spark, sf, "lineitem").select(
        F.lit("reanalysis-orders").alias("product"), F.lit("quantity").alias("variable"), F.col("l_shipdate").alias("ts"),
        (F.lit(SOUTH) + (j + 0.5) * 0.5).alias("lat"), (F.lit(WEST) + (i + 0.5) * 0.5).alias("lon"),
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_quantity")).alias("value"))


def raster_spec(id: str, unit: str, product: str, variable: str, months: list[int] | None, stat: str, zonal_stat: str) -> T.Row:
    return _spec(id, unit, "copernicus", "A", ["NUTS1"], product=product, variable=variable, temporal_agg=(months, stat), zonal_stat=zonal_stat)


def raster_cells(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.zonal import aggregate_time

    placed = raster(spark, sf).select(F.year("ts").cast("string").alias("time"), "value",
                                      RASTER_GRID.column(F.col("lon")).alias("i"), RASTER_GRID.row(F.col("lat")).alias("j"))
    return aggregate_time(placed, "mean", ["time", "i", "j"])


# ---------------------------------------------------------------------- calls

view("calls", sql="""
SELECT event_id AS call_id, ts, event_type AS tool, user_id,
       CASE WHEN user_id % 10 = 0 THEN 'pro' WHEN user_id % 10 < 4 THEN 'free' WHEN user_id % 10 < 6 THEN 'shared' ELSE 'anon' END AS tier,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 1 END AS weight, 'u' || user_id AS client, value
FROM events
""")


def calls(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf, "events") if events is None else events
    group = F.col("user_id") % 10
    tier = F.when(group == 0, "pro").when(group < 4, "free").when(group < 6, "shared").otherwise("anon")
    return events.select(
        F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("tool"), "user_id", tier.alias("tier"),
        F.when(F.col("event_type").isin("purchase", "signup"), 2).otherwise(1).alias("weight"),
        F.concat(F.lit("u"), "user_id").alias("client"), "value")


def changes(spark: SparkSession) -> DataFrame:
    """Renamed, merged and moved codes of the derived zones."""
    return spark.createDataFrame([
        ("R0A", "R0Z", 2021, 2024, 1, "Code change"), ("R1B", "R1C", 2021, 2024, 1, "Code change"),
        ("R2C", None, 2021, 2024, 0, "Merged"), ("R3A", "R3A", 2021, 2024, 1, "Name change"),
        ("R4D", "R4E", 2021, 2024, 0, "Boundary shift"),
    ], CHANGES)


CHANGES_SQL = """(VALUES ('R0A','R0Z',1), ('R1B','R1C',1), ('R2C',NULL,0), ('R3A','R3A',1), ('R4D','R4E',0)) AS ch(old_code, new_code, bijective)"""


def cust_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as requested (indicator, zone) pairs, some of them wrong."""
    key, who = F.col("o_orderkey"), F.col("o_custkey") % 50
    names = ["order_value", "order_count", "order_count_q", "supplier_count", "never_built"]
    indicator = F.when(who < 25, "order_value").otherwise("gdp")
    for k, name in enumerate(names):
        indicator = F.when(key % 6 == k, name).otherwise(indicator)
    zone = (
        F.when(key % 5 == 0, F.col("c0")).when(key % 5 == 1, F.col("c1")).when(key % 5 == 2, F.col("c2"))
        .when(key % 5 == 3, F.when(who < 40, F.col("c1")).otherwise("GR30"))
        .otherwise(F.when(who < 30, F.col("c0")).otherwise("EU27_2020"))
    )
    return table(spark, sf, "orders").join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("q"), who).alias("request_id"), indicator.alias("indicator"), zone.alias("zone"))
