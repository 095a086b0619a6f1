"""The canonical table: one replaceable partition per indicator."""

from __future__ import annotations

from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import CANONICAL

REQUIRED = ("geo_code", "time", "value")


def canonical_rows(rows: DataFrame, indicator: str | Column, unit: str | Column, source: str | Column,
                   source_date: str | Column, ingested_at: datetime | None = None) -> DataFrame:
    """Complete measured rows to the nine canonical columns."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    stamp = (ingested_at or datetime.now(UTC)).replace(tzinfo=None)
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("")) if "quality" in rows.columns else F.lit("")

    def constant(v: str | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    values = {
        "indicator": constant(indicator), "geo_code": F.col("geo_code"), "time": F.col("time"),
        "value": F.col("value"), "unit": constant(unit), "quality": quality,
        "source": constant(source), "source_date": constant(source_date), "ingested_at": F.lit(stamp),
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL])


def write_canonical(rows: DataFrame, root: str, indicators: list[str]) -> int:
    """Replace the partitions of `indicators` with `rows`; the others stay.

    Rows of all indicators go out in one job. REBALANCE lets AQE split a hot
    indicator over several tasks. A listed indicator without rows loses its
    old partition, which a dynamic overwrite alone would leave in place.
    Returns the number of rows written.
    """
    spark = rows.sparkSession
    seen = Observation()
    (
        rows.where(F.col("indicator").isin(indicators))
        .observe(seen, F.count(F.lit(1)).alias("n"), F.array_join(F.collect_set("indicator"), "\n").alias("ids"))
        .hint("rebalance", "indicator")
        .sortWithinPartitions("indicator", "geo_code", "time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("indicator")
        .parquet(root)
    )
    try:
        written = seen.get
    except Py4JJavaError:  # an input known to be empty is planned away, metrics included
        written = {"n": 0, "ids": ""}
    for gone in set(indicators) - set((written["ids"] or "").split("\n")):
        drop_indicator(spark, root, gone)
    return written["n"]


def write_indicator(rows: DataFrame, root: str, spec: dict, source_date: str,
                    ingested_at: datetime | None = None) -> int:
    """Replace one indicator from measured rows and its spec (`id`, `unit`, `source`)."""
    full = canonical_rows(rows, spec["id"], spec["unit"], spec["source"], source_date, ingested_at)
    return write_canonical(full, root, [spec["id"]])


def read_canonical(spark: SparkSession, root: str, indicators: list[str] | None = None) -> DataFrame:
    """Canonical rows; an indicator list becomes a partition filter.

    The schema is given, so a missing column of an older partition reads as
    null and no file footer is merged. A store that does not exist yet is empty.
    """
    fs, path = _folder(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], CANONICAL)
    df = spark.read.schema(CANONICAL).option("basePath", root).parquet(root).select(*CANONICAL.names)
    return df if indicators is None else df.where(F.col("indicator").isin(indicators))


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def materialized_ids(spark: SparkSession, root: str) -> list[str]:
    """Indicators that have a partition at rest, from the folder listing alone."""
    fs, path = _folder(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("indicator="))


def drop_partition(spark: SparkSession, root: str, key: str, value: str) -> bool:
    """Remove the partition `key=value`; True when it existed."""
    fs, path = _folder(spark, f"{root.rstrip('/')}/{key}={value}")
    return bool(fs.exists(path) and fs.delete(path, True))


def drop_indicator(spark: SparkSession, root: str, indicator: str) -> bool:
    """Remove one partition; True when it existed."""
    return drop_partition(spark, root, "indicator", indicator)
