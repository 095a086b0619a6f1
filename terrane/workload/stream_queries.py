"""Streams drained to tables and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.cubes import read_cube, spread_dims, to_wide, write_wide
from ..streaming.admission import ROCKSDB, admit_stream, admit_stream_in_order
from ..streaming.jobs import (
    call_rollup, compact_counts, count_with_late, counted, daily_counter, land_cubes, latest_of, rollup_of, run_to_table, stream_folder,
    upsert_to_table,
)
from .base import query, table
from .cube_queries import periods
from .shapes import CUBE_DIMS, DATASET, calls, cube_columns
from .usage_queries import ADMISSION_SQL, ADMISSION, admission_calls


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("daily_counter_stream", "calls", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, client, CAST(sum(weight) AS BIGINT) AS used FROM calls GROUP BY ALL""")
def daily_counter_stream(spark, sf):
    out, checkpoint = stream_folder(spark, "usage")
    upsert_to_table(daily_counter(calls(spark, sf, event_stream(spark, sf))), out, checkpoint)
    return latest_of(spark, out, ["day_start", "client"]).select(
        F.date_format("day_start", "yyyy-MM-dd").alias("day"), "client", "used")


@query("usage_rollup_stream", "calls", sql="""
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, tool, CASE WHEN value > 40 THEN 'empty' ELSE 'ok' END AS status, count(*) AS calls,
       CAST(sum(CAST(floor(value) AS INT)) AS BIGINT) AS total_ms, quantile_disc(CAST(floor(value) AS INT), 0.5) AS median_ms, max(CAST(floor(value) AS INT)) AS max_ms FROM calls GROUP BY ALL""")
def usage_rollup_stream(spark, sf):
    out, checkpoint = stream_folder(spark, "rollup")
    logged = calls(spark, sf, event_stream(spark, sf)).select(
        "ts", "tool", F.when(F.col("value") > 40, "empty").otherwise("ok").alias("status"), F.floor("value").cast("int").alias("ms"))
    upsert_to_table(call_rollup(logged), out, checkpoint)
    return latest_of(spark, out, ["window_start", "tool", "status"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "tool", "status", "calls", "total_ms", "median_ms", "max_ms")


def late_calls(spark, sf, root):
    """The calls as a stream of two files, the later half of the time first."""
    rows = calls(spark, sf)
    for late, name in ((False, "first"), (True, "second")):
        rows.where((F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")) == late).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


@query("daily_counter_late", "calls", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, client, CAST(coalesce(sum(weight) FILTER (ts >= TIMESTAMP '2024-01-16'), 0) AS BIGINT) AS in_time,
       CAST(coalesce(sum(weight) FILTER (ts < TIMESTAMP '2024-01-16'), 0) AS BIGINT) AS late, CAST(sum(weight) AS BIGINT) AS used FROM calls GROUP BY ALL""")
def daily_counter_late(spark, sf):
    """Calls that come after their day is closed are counted apart; with them the counter equals the batch sum."""
    out, checkpoint = stream_folder(spark, "late")
    count_with_late(late_calls(spark, sf, f"{out}/in"), "1 day", ["client"], {"used": F.col("weight").cast("long")}, f"{out}/counts", checkpoint)
    compact_counts(spark, f"{out}/counts", ["client"], ["used"])
    parts = [counted(spark, f"{out}/counts", ["client"], ["used"], late).withColumnRenamed("used", name) for late, name in ((False, "in_time"), (True, "late"))]
    both = counted(spark, f"{out}/counts", ["client"], ["used"])
    keys = ["window_start", "client"]
    return both.join(parts[0], keys, "left").join(parts[1], keys, "left").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "client", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_time", "late")], "used")


@query("usage_rollup_late", "calls", sql="""
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, tool, CASE WHEN value > 40 THEN 'empty' ELSE 'ok' END AS status, count(*) AS calls,
       CAST(sum(CAST(floor(value) AS INT)) AS BIGINT) AS total_ms, quantile_disc(CAST(floor(value) AS INT), 0.5) AS median_ms, max(CAST(floor(value) AS INT)) AS max_ms FROM calls GROUP BY ALL""")
def usage_rollup_late(spark, sf):
    """The rollup over late calls as well, its median exact."""
    out, checkpoint = stream_folder(spark, "late")
    logged = late_calls(spark, sf, f"{out}/in").select(
        "ts", "tool", F.when(F.col("value") > 40, "empty").otherwise("ok").alias("status"), F.floor("value").cast("int").alias("ms"))
    keys = ["tool", "status"]
    count_with_late(logged, "1 hour", [*keys, "ms"], {"calls": F.lit(1).cast("long")}, f"{out}/counts", checkpoint)
    return rollup_of(counted(spark, f"{out}/counts", [*keys, "ms"], ["calls"]), keys).select(
        F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), *keys, "calls", "total_ms", "median_ms", "max_ms")


@query("landing_stream", "cube", sql="SELECT freq, unit, geo, time, value, flag FROM cube")
def landing_stream(spark, sf):
    """Land wide files, run twice; the second run finds nothing new."""
    out, checkpoint = stream_folder(spark, "landing")
    rows = cube_columns(spark, sf)
    write_wide(to_wide(rows, CUBE_DIMS, periods(rows)), f"{out}/files/dataset={DATASET}")
    for _ in range(2):
        land_cubes(spark, f"{out}/files", f"{out}/store", checkpoint)
    return spread_dims(read_cube(spark, f"{out}/store"), CUBE_DIMS).drop("dataset")


@query("landing_stream_split", "cube", sql="SELECT freq, unit, geo, time, value, flag FROM cube")
def landing_stream_split(spark, sf):
    """One dataset in several files that land one per batch."""
    out, checkpoint = stream_folder(spark, "landing")
    rows = cube_columns(spark, sf)
    write_wide(to_wide(rows, CUBE_DIMS, periods(rows)).repartition(3), f"{out}/files/dataset={DATASET}")
    land_cubes(spark, f"{out}/files", f"{out}/store", checkpoint, files_per_batch=1)
    return spread_dims(read_cube(spark, f"{out}/store"), CUBE_DIMS).drop("dataset")


@query("admission_stream", "calls", sql=ADMISSION_SQL)
def admission_stream(spark, sf):
    """The verdicts of `admission_control`, from keyed state."""
    out, checkpoint = stream_folder(spark, "admission")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        run_to_table(admit_stream(admission_calls(spark, sf, event_stream(spark, sf)), **ADMISSION), out, checkpoint)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out)


@query("admission_stream_in_order", "calls", sql=ADMISSION_SQL)
def admission_stream_in_order(spark, sf):
    """The same verdicts from calls that arrive in three batches out of order: a later third of each client's calls first."""
    out, checkpoint = stream_folder(spark, "admission")
    rows = admission_calls(spark, sf)
    turn = (F.hash("call_id") % 3 + 3) % 3
    for k in range(3):
        rows.where(turn == k).coalesce(1).write.mode("append").parquet(f"{out}/in/{k}")
    # one call far ahead lets all others pass the watermark; it has no limit and is left out
    ahead = rows.limit(1).withColumn("call_id", F.lit(-1).cast("long")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).withColumn("tier", F.lit("pro"))
    ahead.coalesce(1).write.parquet(f"{out}/in/3")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/*")
        run_to_table(admit_stream_in_order(stream, "40 days", **ADMISSION), f"{out}/verdicts", checkpoint)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{out}/verdicts").where("call_id >= 0")
