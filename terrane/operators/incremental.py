"""What to recompute, what to keep, and what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshness_delta(remote: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """`key, signal, known, status` for every remote item.

    Work is due when nothing is known (`new`), the signal moved (`changed`) or
    a full run is asked (`forced`); otherwise the item is `unchanged`.
    """
    known = state.select("key", F.col("value").alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(~F.col("known").eqNullSafe(F.col("signal")), "changed")
    status = status.when(F.lit(full), "forced").otherwise("unchanged")
    return remote.select("key", "signal").join(known, "key", "left").select("key", "signal", "known", status.alias("status"))


def year_delta(specs: DataFrame, years: list[int], last: DataFrame, full: bool = False) -> DataFrame:
    """Years to produce per indicator: those after the last one at rest, or all."""
    wanted = specs.select("indicator", F.explode(F.lit(sorted(set(years)))).alias("year"))
    joined = wanted.join(last.select("indicator", "last_year"), "indicator", "left")
    return joined.where(F.lit(full) | (F.col("year") > F.coalesce("last_year", F.lit(-1)))).select("indicator", "year")


def merge_years(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing rows of periods that were not recomputed, plus the fresh rows."""
    redone = fresh.select("indicator", "time").distinct()
    return existing.join(redone, ["indicator", "time"], "left_anti").unionByName(fresh)


def materialization_status(specs: DataFrame, present: DataFrame) -> DataFrame:
    """Specs with `materialized`: whether the indicator has rows at rest."""
    have = present.select(F.col("indicator").alias("id")).distinct().withColumn("materialized", F.lit(True))
    return specs.join(have, "id", "left").withColumn("materialized", F.coalesce("materialized", F.lit(False)))


def run_report(outcomes: DataFrame) -> DataFrame:
    """Counts by source and status with the distinct reasons of failures."""
    reason = F.when(F.col("status") == "failed", F.col("reason"))
    return outcomes.groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("items"),
        F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("reasons"))
