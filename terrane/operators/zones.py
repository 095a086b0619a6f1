"""Zone reference: building, listing and code changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_folded
from ..functions.zones import first_filled, is_bijective, parent_code
from ..schemas import CHANGES, CURRENT_VINTAGE, PREVIOUS_VINTAGE, ZONES


def nuts_zones(features: DataFrame, level: str, vintage: int = CURRENT_VINTAGE) -> DataFrame:
    """Reference rows from features with NUTS properties in a `properties` map."""
    p = F.col("properties")
    code = p["NUTS_ID"]
    return features.where(F.coalesce(code, F.lit("")) != "").select(
        code.alias("geo_code"), F.lit(level).alias("level"),
        first_filled(p["NAME_LATN"], p["NUTS_NAME"], code).alias("name"),
        parent_code(code).alias("parent_code"), F.lit(vintage).alias("valid_from"), p["CNTR_CODE"].alias("country"))


def city_zones(features: DataFrame, vintage: int = CURRENT_VINTAGE) -> DataFrame:
    """Reference rows from city features; the parent is the first known NUTS3 property."""
    p = F.col("properties")
    code = p["URAU_CODE"]
    return features.where(F.coalesce(code, F.lit("")) != "").select(
        code.alias("geo_code"), F.lit("CITY").alias("level"), first_filled(p["URAU_NAME"], code).alias("name"),
        first_filled(p[f"NUTS3_{vintage}"], p[f"NUTS3_{CURRENT_VINTAGE}"], p[f"NUTS3_{PREVIOUS_VINTAGE}"]).alias("parent_code"),
        F.lit(vintage).alias("valid_from"), p["CNTR_CODE"].alias("country"))


def zone_reference(parts: list[DataFrame]) -> DataFrame:
    """Union of the levels; the last part wins a code that several carry."""
    ranked = [p.select(*ZONES.names, F.lit(k).alias("_part")) for k, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    others = [c for c in ZONES.names if c != "geo_code"]
    return union.groupBy("geo_code").agg(F.max_by(F.struct(*others), F.struct("_part", *others)).alias("r")).select(
        "geo_code", *[F.col(f"r.{c}").alias(c) for c in others]).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ZONES])


def build_changes(table: DataFrame, vintage_from: int = PREVIOUS_VINTAGE,
                  vintage_to: int = CURRENT_VINTAGE) -> DataFrame:
    """Change rows from `old_code, new_code, change`; rows without any code are dropped."""
    old, new = F.nullif(F.trim("old_code"), F.lit("")), F.nullif(F.trim("new_code"), F.lit(""))
    change = F.nullif(F.trim("change"), F.lit(""))
    return table.where(old.isNotNull() | new.isNotNull()).select(
        old.alias("old_code"), new.alias("new_code"),
        F.lit(vintage_from).alias("vintage_from"), F.lit(vintage_to).alias("vintage_to"),
        is_bijective(old, new, change).cast("int").alias("bijective"), change.alias("change"),
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGES])


def list_zones(zones: DataFrame, level: str, parent: str = "", contains: str = "") -> DataFrame:
    """Zones of a level under any ancestor and by accent-insensitive name or code, by code."""
    level, parent = level.upper().strip(), parent.upper()
    found = zones.where(F.col("level") == level)
    if parent:
        below = F.col("parent_code").startswith(parent) if level == "CITY" else (
            F.col("geo_code").startswith(parent) & (F.col("geo_code") != parent))
        found = found.where(below)
    if contains:
        found = found.where(contains_folded(F.coalesce("name", F.lit("")), contains)
                            | contains_folded(F.col("geo_code"), contains))
    return found.select("geo_code", "name", "level", "parent_code").orderBy("geo_code")


def levels_available(zones: DataFrame) -> DataFrame:
    return zones.select("level").distinct().orderBy("level")
