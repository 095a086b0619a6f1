"""Periods kept, latest snapshots and the pivot to one column per indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import value_cell
from ..functions.periods import period_order
from ..schemas import LAST_PERIODS


def last_periods(df: DataFrame, n: int = LAST_PERIODS) -> DataFrame:
    """Rows of the `n` most recent distinct periods of the whole frame.

    The periods come from a distinct and a top-n, both partial per task; the
    n survivors are broadcast, n being a constant of the request.
    """
    recent = df.select("time").distinct().orderBy(period_order(F.col("time")).desc()).limit(n)
    return df.join(F.broadcast(recent), "time", "left_semi").select(*df.columns)


def latest_per_zone(df: DataFrame) -> DataFrame:
    """The most recent row per indicator and zone; ties go to the later source date, then value.

    `max_by` combines on the map side, so a hot indicator or zone shuffles one row per task.
    """
    order = F.struct(period_order(F.col("time")), F.coalesce("source_date", F.lit("")), F.col("value"))
    others = [c for c in df.columns if c not in ("indicator", "geo_code")]
    picked = df.groupBy("indicator", "geo_code").agg(F.max_by(F.struct(*others), order).alias("r"))
    return picked.select("indicator", "geo_code", *[F.col(f"r.{c}").alias(c) for c in others]).select(*df.columns)


def _pivot_values(df: DataFrame, indicators: list[str]) -> DataFrame:
    """One `(value, quality)` struct per indicator, named `_p0, _p1, ..`.

    Numbers travel through the shuffle; text is made from what survives.
    Duplicates of a logical key resolve to the latest source date, then the
    largest value.
    """
    order = F.struct(F.coalesce("source_date", F.lit("")), F.col("value"))
    return df.groupBy("geo_code", "time").agg(*[
        F.max_by(F.struct("value", "quality"), F.when(F.col("indicator") == i, order)).alias(f"_p{k}")
        for k, i in enumerate(indicators)
    ])


def pivot_indicators(df: DataFrame, indicators: list[str]) -> DataFrame:
    """One row per zone and period, one text column per indicator in request order.

    Columns without any value stay.
    """
    wide = _pivot_values(df, indicators)
    return wide.select("geo_code", "time", *[
        value_cell(F.col(f"_p{k}.value"), F.col(f"_p{k}.quality")).alias(i) for k, i in enumerate(indicators)])


def spread_snapshots(periodic: DataFrame, snapshots: DataFrame, indicators: list[str]) -> DataFrame:
    """Pivot of both kinds: each zone's latest snapshots repeat on its period rows.

    A zone without period rows keeps its snapshots on rows of their own dates.
    Both sides are reduced to one row per key first, so the join on the zone
    adds no rows beyond those dates.
    """
    wide = _pivot_values(periodic, indicators)
    held = latest_per_zone(snapshots).groupBy("geo_code").agg(*[
        F.max(F.when(F.col("indicator") == i, F.struct("time", "value", "quality"))).alias(f"_s{k}")
        for k, i in enumerate(indicators)
    ])
    joined = wide.join(held, "geo_code", "full_outer")
    own_dates = F.array_distinct(F.array_compact(F.array(*[F.col(f"_s{k}.time") for k in range(len(indicators))])))
    is_period = F.col("time").isNotNull()
    dated = joined.withColumn("_row", F.explode(F.when(is_period, F.array("time")).otherwise(own_dates)))

    def cell(k: int) -> Column:
        snapshot, plain = F.col(f"_s{k}"), F.col(f"_p{k}")
        shown = snapshot.isNotNull() & (is_period | (snapshot["time"] == F.col("_row")))
        value = F.when(shown, snapshot["value"]).otherwise(plain["value"])
        mark = (
            F.when(shown & is_period, F.concat(F.lit("snapshot "), snapshot["time"]))
            .when(shown, snapshot["quality"]).otherwise(plain["quality"])
        )
        return value_cell(value, mark)

    return dated.select("geo_code", F.col("_row").alias("time"), *[cell(k).alias(i) for k, i in enumerate(indicators)])


def zone_then_recent(df: DataFrame) -> DataFrame:
    """Zones ascending, the most recent period first."""
    return df.orderBy(F.col("geo_code"), period_order(F.col("time")).desc())
