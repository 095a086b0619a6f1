"""Native cubes: wide files, JSON-stat, code lists, catalogue, filtered reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.incremental import freshness_delta
from ..operators.lookup import codes_filter, list_codes, structure_summary, unknown_codes
from ..operators.projection import missing_dimensions
from ..plans.cubes import ingest_cubes, query_cube, sync_cubes
from ..session import cut_lineage, shared_dir
from ..sources.cubes import read_cube, read_wide_cubes, spread_dims, to_wide, write_cube, write_wide
from ..sources.files import catalogue_from_lines, catalogue_period, upsert_state
from ..sources.jsonstat import explode_jsonstat, explode_structure
from .base import query, similar_sql, table, view
from .shapes import CUBE_DIMS, DATASET, cube, cube_columns, zones


def periods(rows):
    """All periods of a cube, as columns of a wide file: configuration-sized."""
    return [r[0] for r in rows.select("time").distinct().orderBy("time").collect()]


@query("wide_cube_roundtrip", "cube", sql="""
SELECT freq, unit, geo, time, value, flag FROM cube""")
def wide_roundtrip(spark, sf):
    """All series to wide text files, back to long rows, into the native store and out."""
    root = shared_dir(spark, "cubes")
    rows = cube_columns(spark, sf)
    wide = to_wide(rows, CUBE_DIMS, periods(rows))
    write_wide(wide, f"{root}/landing/dataset={DATASET}")
    write_cube(read_wide_cubes(spark, f"{root}/landing"), f"{root}/store")
    return spread_dims(read_cube(spark, f"{root}/store", [DATASET]), CUBE_DIMS).drop("dataset")


@query("cube_ingest_delta", "cube", sql="""
SELECT 'orders_' || left(geo, 2) AS dataset, freq, unit, geo, time, value FROM cube
WHERE left(geo, 2) IN (SELECT 'R' || r_regionkey FROM region) AND left(geo, 2) <> 'R0'""")
def ingest_delta(spark, sf):
    """One wide dataset per region; the one whose signal is known already is skipped."""
    root = shared_dir(spark, "ingest")
    rows = cube_columns(spark, sf)
    named = to_wide(rows, CUBE_DIMS, periods(rows))
    key = F.col(f"`{named.columns[0]}`")
    dataset = F.concat(F.lit("orders_"), F.left(F.split_part(key, F.lit(","), F.lit(3)), F.lit(2)))
    named.withColumn("dataset", dataset).write.partitionBy("dataset").option("sep", "\t").option("header", True).option(
        "quote", "").option("escape", "").csv(f"{root}/landing")
    remote = zones(spark, sf).where("level = 'NUTS0'").select(
        F.concat(F.lit("orders_"), "geo_code").alias("key"), F.lit("2001-08-02").alias("signal"))
    state = remote.where("key = 'orders_R0'").select("key", F.col("signal").alias("value"))
    ingest_cubes(spark, f"{root}/landing", f"{root}/store", remote, state)
    return spread_dims(read_cube(spark, f"{root}/store"), CUBE_DIMS).select("dataset", *CUBE_DIMS, "time", "value")


view("syncable", "cube", "zones", sql="""
SELECT 'orders_' || geo_code AS key, (SELECT count(*) FROM cube WHERE left(geo, 2) = geo_code) AS n FROM zones WHERE level = 'NUTS0'""")


@query("cube_sync_twice", "syncable", sql="""
SELECT 1 AS run, key, CASE key WHEN 'orders_R0' THEN 'unchanged' ELSE 'updated' END AS status, CAST(NULL AS VARCHAR) AS reason,
       CASE key WHEN 'orders_R0' THEN 0 ELSE n END AS rows FROM syncable
UNION ALL SELECT 2, key, 'unchanged', NULL, 0 FROM syncable
UNION ALL SELECT run, 'orders_none', 'failed', 'no_file', 0 FROM (VALUES (1), (2)) r(run)""")
def sync_twice(spark, sf):
    """One dataset per region, one known already and one that never lands; the second run finds nothing to do."""
    root = shared_dir(spark, "sync")
    rows = cube_columns(spark, sf)
    named = to_wide(rows, CUBE_DIMS, periods(rows))
    key = F.col(f"`{named.columns[0]}`")
    named.withColumn("dataset", F.concat(F.lit("orders_"), F.left(F.split_part(key, F.lit(","), F.lit(3)), F.lit(2)))).write.partitionBy(
        "dataset").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(f"{root}/landing")
    remote = zones(spark, sf).where("level = 'NUTS0'").select(F.concat(F.lit("orders_"), "geo_code").alias("key")).unionByName(
        spark.createDataFrame([("orders_none",)], "key string")).withColumn("signal", F.lit("2001-08-02"))
    state = remote.where("key = 'orders_R0'").select(
        F.lit("cube").alias("source"), "key", F.col("signal").alias("value"), F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz").alias("updated_at"))
    first, state = sync_cubes(spark, f"{root}/landing", f"{root}/store", remote, state, "cube", datetime(2001, 8, 2))
    first, state = cut_lineage(first), cut_lineage(state)
    second, _ = sync_cubes(spark, f"{root}/landing", f"{root}/store", remote, state, "cube", datetime(2001, 8, 3))
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))).select("run", "key", "status", "reason", "rows")


@query("cube_sync_bad_file", "syncable", "cube", sql="""
SELECT key, CASE key WHEN 'orders_R1' THEN 'failed' ELSE 'updated' END AS status, CASE key WHEN 'orders_R1' THEN 'bad_file' END AS reason,
       CASE key WHEN 'orders_R1' THEN 0 WHEN 'orders_R2' THEN n - (SELECT count(*) FROM cube WHERE left(geo, 2) = 'R2' AND time = '1997') ELSE n END AS rows FROM syncable
UNION ALL SELECT 'orders_R1', 'quarantine', 'no_header', 1
UNION ALL SELECT 'orders_R2', 'quarantine', 'number', (SELECT count(*) FROM cube WHERE left(geo, 2) = 'R2' AND time = '1997')""")
def sync_bad_file(spark, sf):
    """A dataset whose file has no header and one with unreadable cells: both are reported, and all others are ingested."""
    root = shared_dir(spark, "sync")
    rows = cube_columns(spark, sf)
    wide = to_wide(rows, CUBE_DIMS, periods(rows))
    key = F.col(f"`{wide.columns[0]}`")
    named = wide.withColumn("dataset", F.concat(F.lit("orders_"), F.left(F.split_part(key, F.lit(","), F.lit(3)), F.lit(2))))
    odd = F.when((F.col("dataset") == "orders_R2") & (F.col("1997") != ":"), F.concat(F.lit("about "), "1997")).otherwise(F.col("1997"))
    named = named.withColumn("1997", odd)
    how = {"sep": "\t", "quote": "", "escape": ""}
    named.where("dataset <> 'orders_R1'").write.partitionBy("dataset").options(header=True, **how).csv(f"{root}/landing")
    named.where("dataset = 'orders_R1'").drop("dataset").coalesce(1).write.options(header=False, **how).csv(f"{root}/landing/dataset=orders_R1")
    remote = zones(spark, sf).where("level = 'NUTS0'").select(F.concat(F.lit("orders_"), "geo_code").alias("key"), F.lit("2001-08-02").alias("signal"))
    state = remote.limit(0).select(F.lit("cube").alias("source"), "key", F.col("signal").alias("value"), F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz").alias("updated_at"))
    outcomes, _ = sync_cubes(spark, f"{root}/landing", f"{root}/store", remote, state, "cube", datetime(2001, 8, 2), quarantine=f"{root}/quarantine")
    bad = spark.read.parquet(f"{root}/quarantine").groupBy(F.col("dataset").alias("key"), "reason").agg(F.count(F.lit(1)).alias("rows"))
    return outcomes.select("key", "status", "reason", "rows").unionByName(bad.select("key", F.lit("quarantine").alias("status"), "reason", "rows"))


_QUERY_SQL = """
SELECT freq, unit, geo, time, value, flag, n > 400 AS truncated, n AS total FROM (
  SELECT *, row_number() OVER (ORDER BY time, freq, unit, geo) AS rn, count(*) OVER () AS n FROM cube
  WHERE freq IN ('Q', 'M') AND unit IN ('CNT') AND time >= '1997' AND (time <= '1999' OR time LIKE '1999-%')) WHERE rn <= 400"""


@query("cube_query", "cube", sql=_QUERY_SQL)
def cube_query(spark, sf):
    return query_cube(cube_columns(spark, sf), CUBE_DIMS, {"freq": "Q+M", "unit": "CNT++"}, "1997", "1999")


@query("cube_multi_code_filter", "cube", sql="""
SELECT freq, unit, geo, time, value FROM cube WHERE freq IN ('A', 'M') AND unit = 'VAL' AND geo IN ('R0', 'R1A', 'EU27_2020')""")
def multi_code(spark, sf):
    keep = codes_filter({"freq": "A+M", "unit": "VAL", "geo": "R0+R1A+EU27_2020"}, F.col("dims"))
    return spread_dims(cube(spark, sf).where(keep), CUBE_DIMS).select(*CUBE_DIMS, "time", "value")


# ------------------------------------------------------------------ code lists

view("codelist", "cube", "zones", sql="""
SELECT 'orders_cube' AS dataset, dim, CAST(row_number() OVER (PARTITION BY dim ORDER BY code) - 1 AS INT) AS pos, code, coalesce(name, code) AS label
FROM (SELECT DISTINCT unnest([{'d': 'freq', 'c': freq}, {'d': 'unit', 'c': unit}, {'d': 'geo', 'c': geo}]) AS x FROM cube) t,
     LATERAL (SELECT x.d AS dim, x.c AS code) y LEFT JOIN zones ON geo_code = code AND dim = 'geo'
""")


def codelist(spark, sf):
    """Codes of the cube's dimensions, labelled from the zone names."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("code")) for d in CUBE_DIMS])
    codes = cube_columns(spark, sf).select(F.explode(pairs).alias("x")).select("x.dim", "x.code").distinct()
    labels = zones(spark, sf).select(F.lit("geo").alias("dim"), F.col("geo_code").alias("code"), "name")
    place = F.row_number().over(Window.partitionBy("dim").orderBy("code")) - 1
    return codes.join(labels, ["dim", "code"], "left").select(
        F.lit(DATASET).alias("dataset"), "dim", F.col("dim").alias("dim_label"), place.alias("pos"), "code",
        F.coalesce("name", "code").alias("label"))


_RANK = """CASE WHEN starts_with(strip_accents(lower(code)), '{n}') THEN 0 WHEN contains(strip_accents(lower(code)), '{n}') THEN 1
           WHEN contains(strip_accents(lower(label)), '{n}') THEN 2 END"""


@query("code_lookup_ranked", "codelist", sql=f"""
SELECT dataset, dim, CAST(place AS INT) AS place, code, label, CAST(rank AS INT) AS rank, greatest(n - 20, 0) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, dim ORDER BY rank, CASE WHEN rank = 0 THEN length(code) ELSE 0 END, pos, code) AS place,
         count(*) OVER (PARTITION BY dataset, dim) AS n
  FROM (SELECT *, {_RANK.format(n='r1')} AS rank FROM codelist) WHERE rank IS NOT NULL) WHERE place <= 20""")
def code_lookup(spark, sf):
    return list_codes(codelist(spark, sf), "R1", limit=20)


@query("code_lookup_folded", "codelist", sql=f"""
SELECT dim, code, label, CAST(rank AS INT) AS rank FROM (SELECT *, {_RANK.format(n='ile r0')} AS rank,
  row_number() OVER (ORDER BY {_RANK.format(n='ile r0')}, pos) AS place FROM codelist WHERE {_RANK.format(n='ile r0')} IS NOT NULL) WHERE place <= 60""")
def code_lookup_folded(spark, sf):
    return list_codes(codelist(spark, sf), "île R0").select("dim", "code", "label", "rank")


@query("structure_summary", "codelist", sql="""
SELECT dataset, dim, dim AS dim_label, CAST(place AS INT) AS place, code, label, greatest(n - 25, 0) AS remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, dim ORDER BY pos) AS place, count(*) OVER (PARTITION BY dataset, dim) AS n FROM codelist)
WHERE place <= 25""")
def structure(spark, sf):
    return structure_summary(codelist(spark, sf))


_WRONG = "(VALUES ('freq', 'W'), ('geo', 'R0AX'), ('geo', 'EU27_2O20'), ('geo', 'ZZZZZZ'), ('unit', 'VALU'), ('sex', 'T'), ('geos', 'R0'))"


@query("unknown_codes", "codelist", sql=f"""
SELECT f.dim, f.code, CASE WHEN f.dim IN (SELECT dim FROM codelist) THEN 'unknown_code' ELSE 'unknown_dimension' END AS problem,
       CASE WHEN f.dim IN (SELECT dim FROM codelist) THEN (SELECT string_agg(code, ',' ORDER BY ratio DESC, code) FROM (
              SELECT c.code, ratio FROM ({similar_sql(f"SELECT code AS x FROM {_WRONG} w(dim, code)", "SELECT code AS x FROM codelist", (3, 5))}) s
              JOIN codelist c ON c.code = s.term WHERE c.dim = f.dim AND s.word = f.code ORDER BY ratio DESC, c.code LIMIT 3))
            ELSE (SELECT string_agg(lower(term), ',' ORDER BY ratio DESC, term) FROM ({similar_sql(f"SELECT dim AS x FROM {_WRONG} w(dim, code)", "SELECT dim AS x FROM codelist", (3, 5))}) s
              WHERE s.word = upper(f.dim)) END AS closest
FROM {_WRONG} f(dim, code)""")
def unknown(spark, sf):
    """Known entries pass; the others come with what may have been meant."""
    return unknown_codes({"freq": "A+W", "geo": "R0+R0AX+EU27_2O20+ZZZZZZ", "unit": "VALU", "sex": "T", "geos": "R0"}, codelist(spark, sf))


@query("missing_dimensions", sql="""
SELECT indicator, dataset, dim FROM (VALUES ('wrong_filter', 'orders_cube', 'sex'), ('wrong_place', 'orders_cube', 'city')) m(indicator, dataset, dim)
WHERE (SELECT count(*) FROM orders) > 0""")
def missing_dims(spark, sf):
    from ..schemas import SPECS
    from .shapes import _spec

    dims = cube(spark, sf).select("dataset", F.explode(F.map_keys("dims")).alias("dim")).distinct()
    asked = spark.createDataFrame([
        _spec("right", "EUR", "eurostat", "A", ["NUTS0"], dataset=DATASET, value_dim="geo", filters={"freq": "A"}),
        _spec("wrong_filter", "EUR", "eurostat", "A", ["NUTS0"], dataset=DATASET, value_dim="geo", filters={"sex": "T"}),
        _spec("wrong_place", "EUR", "eurostat", "A", ["NUTS0"], dataset=DATASET, value_dim="city", filters={}),
    ], SPECS)
    return missing_dimensions(dims, asked)


# ------------------------------------------------------------------- JSON-stat

def jsonstat_docs(spark, sf):
    """One JSON-stat document per zone: unit x period, sparse for even zones, dense for odd ones."""
    rows = cube_columns(spark, sf).withColumn("pos", F.dense_rank().over(Window.partitionBy("geo").orderBy("time")) - 1)
    times = rows.groupBy("geo").agg(F.array_sort(F.collect_set("time")).alias("times"))
    size = F.size("times")
    every = times.select("geo", size.alias("n"), F.explode(F.sequence(F.lit(0), 2 * size - 1)).alias("i"))
    placed = rows.select("geo", "unit", "pos", "value")
    cells = every.withColumn("unit", F.when(F.col("i") >= F.col("n"), "VAL").otherwise("CNT")).withColumn("pos", F.col("i") % F.col("n")).join(
        placed, ["geo", "unit", "pos"], "left").groupBy("geo").agg(F.array_sort(F.collect_list(F.struct("i", F.col("value").alias("v")))).alias("cells"))
    per_geo = times.join(cells, "geo")
    index = F.map_from_entries(F.transform("times", lambda t, k: F.struct(t.alias("key"), k.alias("value"))))
    labels = F.map_from_entries(F.transform("times", lambda t: F.struct(t.alias("key"), F.concat(F.lit("Y"), t).alias("value"))))
    sparse = F.to_json(F.map_from_entries(F.transform(
        F.filter("cells", lambda c: c["v"].isNotNull()), lambda c: F.struct(c["i"].cast("string").alias("key"), c["v"].alias("value")))))
    dense = F.concat(F.lit("["), F.array_join(F.transform("cells", lambda c: F.coalesce(c["v"].cast("string"), F.lit("null"))), ","), F.lit("]"))
    values = F.when(F.ascii(F.right("geo", F.lit(1))) % 2 == 0, sparse).otherwise(dense)
    head = '{"id":["unit","time"],"size":[2,%s],"dimension":{"unit":{"label":"Unit","category":{"index":{"CNT":0,"VAL":1}}},"time":{"category":{"index":%s,"label":%s}}},"value":%s}'
    return per_geo.select("geo", F.format_string(head, size, F.to_json(index), F.to_json(labels), values).alias("json"))


@query("jsonstat_explode", "cube", sql="""
SELECT geo, unit, time, value FROM cube""")
def jsonstat(spark, sf):
    cells = explode_jsonstat(jsonstat_docs(spark, sf)).where("value is not null")
    return cells.select("geo", F.col("coords")["unit"].alias("unit"), F.col("coords")["time"].alias("time"),
                        F.col("value").cast("double").alias("value"))


@query("codelist_explode", "cube", sql="""
SELECT geo, 'time' AS dim, 'time' AS dim_label, CAST(row_number() OVER (PARTITION BY geo ORDER BY time) - 1 AS INT) AS pos, time AS code, 'Y' || time AS label
FROM (SELECT DISTINCT geo, time FROM cube)
UNION ALL SELECT geo, 'unit', 'Unit', CAST(CASE unit WHEN 'CNT' THEN 0 ELSE 1 END AS INT), unit, unit
FROM (SELECT DISTINCT geo, unit FROM cube)""")
def codelist_explode(spark, sf):
    return explode_structure(jsonstat_docs(spark, sf))


# ------------------------------------------------------------------- catalogue

view("toc", sql="""
SELECT p_partkey, lower(replace(p_brand, '#', '_')) || '_' || p_size AS code, p_name AS title,
       CASE p_size % 3 WHEN 0 THEN 'folder' WHEN 1 THEN 'dataset' ELSE 'table' END AS type,
       CASE WHEN p_size > 40 THEN '' ELSE '19' || (p_size + 40) END AS data_start, '2001' AS data_end, '0' || (p_partkey % 9 + 1) || '.08.2001' AS last_update
FROM part
""")


def toc_lines(spark, sf):
    """Parts as lines of a quoted catalogue file, with a header and some short lines."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "folder").when(size % 3 == 1, "dataset").otherwise("table")
    start = F.when(size > 40, "").otherwise(F.concat(F.lit("19"), size + 40))
    line = F.concat_ws("\t", q(F.col("p_name")), q(F.concat_ws("_", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), size)), q(kind),
                       q(F.concat(F.lit("0"), F.col("p_partkey") % 9 + 1, F.lit(".08.2001"))), q(F.lit("")), q(start), q(F.lit("2001")))
    parts = table(spark, sf, "part")
    head = '"title"\t"code"\t"type"\t"last update of data"\t"last table structure change"\t"data start"\t"data end"'
    rows = parts.select(F.col("p_partkey").alias("place"), line.alias("line"))
    short = parts.groupBy().agg((F.max("p_partkey") + 1).alias("place")).select("place", F.lit('"only a title"').alias("line"))
    return rows.unionByName(short).unionByName(spark.createDataFrame([(-1, head)], "place bigint, line string"))


@query("catalogue_dedupe", "toc", sql="""
SELECT code, title, data_start, data_end, last_update FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM toc WHERE type IN ('dataset', 'table')) WHERE rn = 1""")
def catalogue(spark, sf):
    return catalogue_from_lines(toc_lines(spark, sf))


@query("catalogue_period", "toc", sql="""
SELECT code, data_start, data_end FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM toc WHERE type IN ('dataset', 'table'))
WHERE rn = 1 AND data_start <> ''""")
def catalogue_span(spark, sf):
    return catalogue_period(catalogue_from_lines(toc_lines(spark, sf)))


@query("structure_with_period", "toc", sql="""
SELECT t.code AS dataset, 'part' AS dim, 'Part' AS dim_label, CAST(place AS INT) AS place, 'n' || p_partkey AS code, title AS label, greatest(n - 3, 0) AS remaining,
       c.data_start, c.data_end
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS place, count(*) OVER (PARTITION BY code) AS n FROM toc) t
LEFT JOIN (SELECT code, data_start, data_end FROM (
             SELECT *, row_number() OVER (PARTITION BY code ORDER BY p_partkey) AS rn FROM toc WHERE type IN ('dataset', 'table')) WHERE rn = 1 AND data_start <> '') c
  ON c.code = t.code WHERE place <= 3""")
def structure_with_period(spark, sf):
    """Each catalogue code as a dataset whose codes are the parts that share it, with its span where the catalogue knows it."""
    parts = table(spark, sf, "part").select(
        F.concat_ws("_", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), "p_size").alias("dataset"), F.lit("part").alias("dim"), F.lit("Part").alias("dim_label"),
        F.col("p_partkey").alias("pos"), F.concat(F.lit("n"), "p_partkey").alias("code"), F.col("p_name").alias("label"))
    return structure_summary(parts, 3, catalogue_period(catalogue_from_lines(toc_lines(spark, sf))))


# ------------------------------------------------------------------ increments

@query("freshness_delta", sql="""
WITH r AS (SELECT 'c' || o_custkey AS key, strftime(max(o_orderdate), '%Y-%m-%d') AS signal FROM orders GROUP BY o_custkey),
     s AS (SELECT 'c' || o_custkey AS key, strftime(max(o_orderdate), '%Y-%m-%d') AS known FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY o_custkey)
SELECT r.key, signal, known, CASE WHEN known IS NULL THEN 'new' WHEN known <> signal THEN 'changed' ELSE 'unchanged' END AS status
FROM r LEFT JOIN s ON r.key = s.key""")
def delta(spark, sf):
    orders = table(spark, sf, "orders")

    def last(df, name):
        return df.groupBy(F.concat(F.lit("c"), "o_custkey").alias("key")).agg(
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias(name))

    before = orders.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return freshness_delta(last(orders, "signal"), last(before, "value"))


@query("state_upsert", sql="""
SELECT 'user' AS source, CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_type)) AS value FROM events GROUP BY user_id""")
def state(spark, sf):
    events = table(spark, sf, "events").select(
        F.lit("user").alias("source"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"),
        F.col("ts").cast("timestamp_ntz").alias("updated_at"))
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    return upsert_state(events.where(F.col("updated_at") < split), events.where(F.col("updated_at") >= split)).drop("updated_at")
