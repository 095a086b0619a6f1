"""From native cubes to canonical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import blank_to_null, merge_quality
from ..schemas import CURRENT_VINTAGE
from ..session import join_counted


def spec_filter(dims: Column, filters: dict[str, str]) -> Column:
    """AND of `dimension = value`."""
    return reduce(lambda a, b: a & b, [dims[k] == v for k, v in filters.items()], F.lit(True))


def recode_pairs(changes: DataFrame, vintage_from: int, vintage_to: int = CURRENT_VINTAGE) -> DataFrame:
    """Old and new code of the changes that keep a zone's identity."""
    usable = (
        (F.col("vintage_from") == vintage_from) & (F.col("vintage_to") == vintage_to)
        & (F.col("bijective") == 1) & F.col("old_code").isNotNull() & F.col("new_code").isNotNull()
        & (F.col("old_code") != F.col("new_code"))
    )
    # One row per old code keeps the recode from multiplying rows.
    return changes.where(usable).groupBy("old_code").agg(F.max("new_code").alias("new_code"))


def recode(df: DataFrame, changes: DataFrame, vintage_from: int,
           vintage_to: int = CURRENT_VINTAGE) -> DataFrame:
    """Move `geo_code` to the target vintage; adds `recoded`. Unmapped codes stay."""
    if vintage_from == vintage_to:
        return df.withColumn("recoded", F.lit(False))
    pairs = recode_pairs(changes, vintage_from, vintage_to).withColumnRenamed("old_code", "geo_code")
    return df.join(pairs, "geo_code", "left").select(
        *[F.coalesce("new_code", "geo_code").alias("geo_code") if c == "geo_code" else F.col(c) for c in df.columns],
        F.col("new_code").isNotNull().alias("recoded"),
    )


def recode_verdict(codes: DataFrame, changes: DataFrame, vintage_from: int,
                   vintage_to: int = CURRENT_VINTAGE) -> DataFrame:
    """`new_code, bijective` per code; unknown codes are unchanged, removed ones null and not bijective."""
    known = (
        changes.where((F.col("vintage_from") == vintage_from) & (F.col("vintage_to") == vintage_to)
                      & F.col("old_code").isNotNull())
        .groupBy(F.col("old_code").alias("geo_code"))
        .agg(F.max(F.struct("bijective", "new_code")).alias("hit"))
    )
    return codes.join(known, "geo_code", "left").select(
        *codes.columns,
        F.when(F.col("hit").isNull(), F.col("geo_code")).otherwise(F.col("hit.new_code")).alias("new_code"),
        F.coalesce(F.col("hit.bijective") == 1, F.lit(True)).alias("bijective"),
    )


def restrict_to_zones(df: DataFrame, zones: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Keep rows whose code is in the reference, at the given levels; aggregates vanish."""
    allowed = zones if levels is None else zones.where(F.col("level").isin(levels))
    return df.join(allowed.select("geo_code").distinct(), "geo_code", "left_semi")


def missing_dimensions(cube_dims: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per spec and dimension it needs that its dataset lacks.

    `cube_dims` lists `(dataset, dim)`; only filters, value and time dimension are checked.
    """
    needed = specs.select(
        F.col("id").alias("indicator"), F.col("extraction.dataset").alias("dataset"),
        F.explode(F.array_distinct(F.concat(
            F.array(F.coalesce(F.col("extraction.value_dim"), F.lit("geo"))),
            F.coalesce(F.map_keys("extraction.filters"), F.array().cast("array<string>"))))).alias("dim"),
    )
    return needed.join(cube_dims.select("dataset", "dim").distinct(), ["dataset", "dim"], "left_anti")


def project_indicators(cube: DataFrame, specs: DataFrame, zones: DataFrame,
                       changes: DataFrame | None = None, source_dates: DataFrame | None = None) -> DataFrame:
    """Rows of every cube spec in one pass over the cubes.

    `cube` is the long table with its `dims` map. A spec takes the rows of its
    dataset whose dimensions equal all its filters, at the zone levels it
    offers. Output: `indicator, geo_code, time, value, quality, unit, source,
    source_date`.
    """
    wanted = specs.where(F.col("extraction.dataset").isNotNull()).select(
        F.col("id").alias("indicator"), "unit", "source", "geo_levels", "nuts_vintage",
        F.col("extraction.dataset").alias("dataset"),
        F.coalesce("extraction.value_dim", F.lit("geo")).alias("value_dim"),
        F.coalesce("extraction.time_dim", F.lit("time")).alias("time_dim"),
        F.coalesce(F.map_entries("extraction.filters"), F.array().cast("array<struct<key:string,value:string>>")).alias("pairs"),
    )
    # A dataset may hold a third of the cube, so the cube never moves by dataset.
    hits = join_counted(cube.where(F.col("value").isNotNull()), wanted, ["dataset"]).where(
        F.forall("pairs", lambda p: F.col("dims")[p["key"]].eqNullSafe(p["value"])))
    rows = hits.select(
        "indicator", "unit", "source", "geo_levels", "nuts_vintage", "dataset",
        F.col("dims")[F.col("value_dim")].alias("geo_code"),
        F.when(F.col("time_dim") == "time", F.col("time")).otherwise(F.col("dims")[F.col("time_dim")]).alias("time"),
        "value", blank_to_null(F.col("flag")).alias("flag"),
    )
    if changes is not None:
        pairs = changes.where(
            (F.col("vintage_to") == CURRENT_VINTAGE) & (F.col("bijective") == 1)
            & F.col("old_code").isNotNull() & F.col("new_code").isNotNull()
            & (F.col("old_code") != F.col("new_code"))
        ).groupBy(F.col("old_code").alias("geo_code"), F.col("vintage_from").alias("nuts_vintage")).agg(
            F.max("new_code").alias("new_code"))
        rows = rows.join(pairs, ["geo_code", "nuts_vintage"], "left").withColumn(
            "recoded", F.col("new_code").isNotNull()).withColumn("geo_code", F.coalesce("new_code", "geo_code"))
    else:
        rows = rows.withColumn("recoded", F.lit(False))
    placed = rows.join(zones.select("geo_code", "level"), "geo_code").where(
        F.array_contains("geo_levels", F.col("level")))
    if source_dates is not None:
        placed = placed.join(source_dates.select("dataset", "source_date"), "dataset", "left")
    else:
        placed = placed.withColumn("source_date", F.lit(""))
    return placed.select(
        "indicator", "geo_code", "time", "value",
        merge_quality(F.col("recoded"), F.col("flag")).alias("quality"),
        "unit", "source", F.coalesce("source_date", F.lit("")).alias("source_date"),
    )


def duplicate_keys(canonical: DataFrame) -> DataFrame:
    """Logical keys that occur more than once, for instance after a recode."""
    return canonical.groupBy("indicator", "geo_code", "time").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
