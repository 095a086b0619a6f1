"""Profiles, provenance and bounded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.zones import level_of_code
from ..schemas import MAX_ROWS
from .pivot import latest_per_zone


def indicator_profile(canonical: DataFrame) -> DataFrame:
    """Rows, source, newest dates and span per indicator.

    Rows are counted per distinct set of texts first: a text may be a key of a
    hash aggregate but not its result, and few sets remain for the rest.
    """
    sets = canonical.groupBy("indicator", "source", "source_date", "ingested_at", "time").agg(F.count(F.lit(1)).alias("rows"))
    return sets.groupBy("indicator").agg(
        F.sum("rows").alias("rows"), F.max("source").alias("source"),
        F.max("source_date").alias("source_date"), F.max("ingested_at").alias("ingested_at"),
        F.min("time").alias("time_min"), F.max("time").alias("time_max"),
    )


def provenance(canonical: DataFrame) -> DataFrame:
    """Per indicator the source, date and load time of its newest source date."""
    canonical = canonical.select("indicator", "source", "source_date", "ingested_at").distinct()
    newest = F.max_by(F.struct("source", "source_date", "ingested_at"),
                      F.struct(F.coalesce("source_date", F.lit("")), "ingested_at", "source")).alias("p")
    return canonical.groupBy("indicator").agg(newest).select("indicator", "p.source", "p.source_date", "p.ingested_at")


def provenance_by_source(origin: DataFrame) -> DataFrame:
    """One row per source: its date when all indicators agree, else the list per indicator."""
    named = origin.select(
        "indicator", F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source"),
        F.coalesce(F.nullif("source_date", F.lit("")), F.lit("unknown")).alias("day"))
    return named.groupBy("source").agg(
        F.when(F.min("day") == F.max("day"), F.max("day")).otherwise(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("indicator", "day"))),
                                     lambda s: F.concat_ws(" ", s["indicator"], s["day"])), ", ")).alias("dates"),
        F.count(F.lit(1)).alias("indicators"),
    )


def snapshot_summary(snapshots: DataFrame, zones_with_periods: DataFrame) -> DataFrame:
    """Per snapshot indicator: latest date, qualities and whether it repeats on period rows."""
    latest = latest_per_zone(snapshots)
    flagged = latest.join(
        zones_with_periods.select("geo_code").distinct().withColumn("has_periods", F.lit(True)), "geo_code", "left")
    return flagged.groupBy("indicator").agg(
        F.max("time").alias("snapshot_time"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("quality", F.lit("")))), ", ").alias("qualities"),
        F.coalesce(F.bool_or("has_periods"), F.lit(False)).alias("repeated"),
    )


def missing_in_window(requested: DataFrame, answered: DataFrame, profile: DataFrame) -> DataFrame:
    """Requested indicators without a row in the window, with the span they do have."""
    gone = requested.select("indicator").distinct().join(answered.select("indicator").distinct(), "indicator", "left_anti")
    return gone.join(profile.select("indicator", "time_min", "time_max"), "indicator", "left")


def levels_present(canonical: DataFrame) -> DataFrame:
    """Levels found among the zone codes of each indicator, from the code length."""
    level = level_of_code(F.col("geo_code")).alias("level")
    return canonical.select("indicator", level).where(F.col("level").isNotNull()).distinct()


def bounded(df: DataFrame, *order: object, limit: int = MAX_ROWS) -> DataFrame:
    """First `limit` rows plus `truncated`, which tells whether more existed, and `total`, how many there are.

    Top-n of `limit` rows, merged from a top-n per task. The total is counted apart, from the columns that filters
    need.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(limit).withColumn("truncated", total > limit).withColumn("total", total)
