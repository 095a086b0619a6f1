"""Streams: usage counters, call-log rollup, landing of cube files, admission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.usage import instant, naive
from ..session import shared_dir
from ..sources.canonical import _folder
from ..sources.cubes import file_dataset, read_wide_cubes, write_cube


def daily_counter(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Weight per UTC day and client; late calls are dropped after `delay`.

    `ts` is zone-less UTC; watermarks need an instant, so it is turned into one and back.
    """
    return (
        calls.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "client")
        .agg(F.sum("weight").alias("used"))
        .select(naive(F.col("w.start")).alias("day_start"), "client", "used")
    )


def call_rollup(calls: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Calls, errors and latency per window, tool and status."""
    return (
        calls.withColumn("ts", instant(F.col("ts"))).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "tool", "status")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"),
             F.percentile_approx("ms", 0.5).alias("median_ms"), F.max("ms").alias("max_ms"))
        .select(naive(F.col("w.start")).alias("window_start"), "tool", "status", "calls", "total_ms", "median_ms", "max_ms")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into Parquet and stop; a rerun continues from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def upsert_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain an `update` stream; each batch writes its changed rows under its own batch folder.

    Rewriting a batch replaces its folder, so a retry adds nothing twice.
    `latest_of` reads the last version of each key.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(
        *keys, *[F.col(f"r.{v}").alias(v) for v in values])


def count_with_late(calls: DataFrame, width: str, keys: list[str], sums: dict[str, Column], path: str, checkpoint: str, delay: str = "1 hour") -> None:
    """Drain a stream of calls into sums per window and key that lose no late call.

    A call is late if its window had ended `delay` before the newest call of earlier batches. Each batch writes its own sums,
    those of late calls apart (`late=true`), under its number, so a retry adds nothing twice; `counted` merges them.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _bounds(spark, path, batch_id)
        window = F.window(instant(F.col("ts")), width)
        rows = batch.select(window.alias("w"), *keys, *[c.alias(n) for n, c in sums.items()])
        behind = F.lit(False) if seen is None else naive(F.col("w.end")) <= F.lit(seen).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        rows.groupBy(naive(F.col("w.start")).alias("window_start"), *keys, behind.alias("late")).agg(*[F.sum(n).alias(n) for n in sums]).write.mode(
            "overwrite").option("partitionOverwriteMode", "static").partitionBy("late").parquet(f"{path}/parts/batch={batch_id}")
        batch.agg(F.max("ts").cast("timestamp_ntz").alias("seen")).write.mode("overwrite").parquet(f"{path}/bounds/batch={batch_id}")

    calls.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _batches(spark: SparkSession, path: str, table: str) -> dict[int, str]:
    fs, folder = _folder(spark, f"{path}/{table}")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n.split("=")[1]): f"{path}/{table}/{n}" for n in names if n.startswith("batch=") and fs.exists(_folder(spark, f"{path}/{table}/{n}/_SUCCESS")[1])}


def _bounds(spark: SparkSession, path: str, batch_id: int) -> object:
    """The newest time of the batches before this one; each tells a single row."""
    earlier = [p for b, p in _batches(spark, path, "bounds").items() if b < batch_id]
    return spark.read.parquet(*earlier).agg(F.max("seen")).first()[0] if earlier else None


def counted(spark: SparkSession, path: str, keys: list[str], sums: list[str], late: bool | None = None) -> DataFrame:
    """`window_start, keys, sums` over all batches: of calls in time, of late ones, or (None) of both, which is what a batch job finds."""
    base, parts = _batches(spark, path, "base"), _batches(spark, path, "parts")
    upto = max(base, default=-1)
    frames = [spark.read.parquet(p).withColumn("late", F.col("late").cast("boolean")) for p in [*([base[upto]] if base else []), *(p for b, p in sorted(parts.items()) if b > upto)]]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    rows = rows if late is None else rows.where(F.col("late") == late)
    return rows.groupBy("window_start", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def compact_counts(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> int:
    """Merge the batches written so far into one table and delete them; returns how many. Not for use while a batch is being written.

    The merged table says up to which batch it goes and counts once it is complete, so breaking off at any point loses nothing.
    """
    parts = _batches(spark, path, "parts")
    base = _batches(spark, path, "base")
    open_parts = [b for b in parts if b > max(base, default=-1)]
    if len(open_parts) > 1:
        both = [counted(spark, path, keys, sums, late).withColumn("late", F.lit(late)) for late in (False, True)]
        both[0].unionByName(both[1]).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("late").parquet(f"{path}/base/batch={max(open_parts)}")
        base = _batches(spark, path, "base")
    upto = max(base, default=-1)
    for old in [*(p for b, p in parts.items() if b <= upto), *(p for b, p in base.items() if b < upto)]:
        fs, folder = _folder(spark, old)
        fs.delete(folder, True)
    return len(open_parts) if len(open_parts) > 1 else 0


def rollup_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, summed, median and greatest latency per window and `keys` from counts of calls per `ms`; the median is exact."""
    group = ["window_start", *keys]
    so_far = F.sum("calls").over(Window.partitionBy(*group).orderBy("ms"))
    whole = F.sum("calls").over(Window.partitionBy(*group))
    at = counts.select("*", (2 * so_far >= whole).alias("half"))
    return at.groupBy(*group).agg(F.sum("calls").alias("calls"), F.sum(F.col("calls") * F.col("ms")).alias("total_ms"),
                                  F.min(F.when(F.col("half"), F.col("ms"))).alias("median_ms"), F.max("ms").alias("max_ms"))


def land_cubes(spark: SparkSession, landing: str, root: str, checkpoint: str,
               after: Callable[[DataFrame], None] | None = None, files_per_batch: int = 1000) -> None:
    """Parse newly landed wide cube files and replace their datasets.

    The checkpoint remembers which files were taken, so a second run over the
    same folder does nothing. A dataset is one file or one `dataset=` folder,
    and its files may land in any number of batches: a batch tells which
    datasets changed, and each is replaced by all its files in the landing
    folder. `after` receives the long rows of these datasets, for instance to
    project indicators.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).format("text").load(landing)
    touched = lines.select(file_dataset(F.col("_metadata.file_path")).alias("dataset"))

    def take(batch: DataFrame, batch_id: int) -> None:
        names = sorted(r[0] for r in batch.distinct().collect())  # at most one name per file of the batch
        if not names:
            return
        cube = read_wide_cubes(spark, landing, names)
        write_cube(cube, root, names)
        if after is not None:
            after(cube)

    touched.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def stream_folder(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """Output and checkpoint folders on the shared storage."""
    root = shared_dir(spark, purpose)
    return f"{root}/out", f"{root}/checkpoint"
