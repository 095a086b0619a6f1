"""Checks on requests and specs: one row per finding, as short codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.zones import code_hint, is_aggregate, level_hint
from ..schemas import (
    CURRENT_VINTAGE, ELEMENT_TYPES, FREQUENCIES, LEVELS, MAX_INDICATORS, MAX_ZONES, PREVIOUS_VINTAGE, SOURCES,
    TEMPORAL_STATS, ZONAL_STATS,
)
from ..session import cut_lineage, join_counted
from .search import closest_terms

#: How alike a known id, or a zone, must be to be suggested.
LIKE_ID, LIKE_ZONE = (3, 5), (1, 2)


def suggestions(unknown: DataFrame, known: DataFrame, like: tuple[int, int], k: int = 3) -> DataFrame:
    """`word, closest`: for each distinct `word`, in upper case, the known `term`s most like it, best first, joined by commas."""
    found = closest_terms(unknown, known, k, like).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("s"))
    return found.select("word", F.array_join(F.transform("s", lambda x: x["term"]), ",").alias("closest"))


def validate_requests(requests: DataFrame, specs: DataFrame, zones: DataFrame, present: DataFrame) -> DataFrame:
    """`error_code, hint` for each requested `(request_id, indicator, zone)`; null means fine.

    The first failing check wins: request size, indicator, zone, level, then
    presence at rest. `present` lists the indicators that have rows. The hint tells what to ask for instead: the code
    of another nomenclature, a level, or up to three ids or zones most like an unknown one.
    """
    asked = requests.select(
        "request_id", F.trim("indicator").alias("indicator"), F.upper(F.trim("zone")).alias("zone"))
    size = asked.groupBy("request_id").agg(
        F.count_distinct("indicator").alias("n_indicators"), F.count_distinct("zone").alias("n_zones"))
    known = specs.select(F.col("id").alias("indicator"), "geo_levels", F.col("extraction.dataset").alias("dataset"),
                         F.lit(True).alias("known"))
    places = zones.select(F.col("geo_code").alias("zone"), "level")
    built = present.select("indicator").distinct().withColumn("built", F.lit(True))
    joined = (
        join_counted(join_counted(asked.join(size, "request_id"), known, ["indicator"], "left"), built, ["indicator"], "left")
        .join(places, "zone", "left")
    )
    code = (
        F.when(F.col("n_indicators") > MAX_INDICATORS, "too_many_indicators")
        .when(F.col("n_zones") > MAX_ZONES, "too_many_zones")
        .when(F.col("known").isNull(), "unknown_indicator")
        .when(F.col("level").isNull(), "unknown_zone")
        .when(~F.array_contains("geo_levels", F.col("level")), "level_not_offered")
        .when(F.col("built").isNull(), "not_materialized")
    )
    aggregate = F.concat(code_hint(F.col("zone")), F.when(F.col("dataset").isNotNull(), F.concat(F.lit(":"), F.col("dataset"))).otherwise(""))
    hint = (
        F.when(code == "unknown_zone", F.when(is_aggregate(F.col("zone")), aggregate).otherwise(code_hint(F.col("zone"))))
        .when(code == "level_not_offered", level_hint(F.col("zone"), F.col("level"), F.col("geo_levels")))
    )
    told = cut_lineage(joined.select("request_id", "indicator", "zone", code.alias("error_code"), hint.alias("hint")))
    open_hint = F.col("hint").isNull()
    ids = told.where(F.col("error_code") == "unknown_indicator").select(F.col("indicator").alias("word"))
    places = told.where((F.col("error_code") == "unknown_zone") & open_hint).select(F.col("zone").alias("word"))
    close = suggestions(ids, specs.select(F.col("id").alias("term")), LIKE_ID).withColumn("error_code", F.lit("unknown_indicator")).unionByName(
        suggestions(places, zones.select(F.col("geo_code").alias("term")), LIKE_ZONE).withColumn("error_code", F.lit("unknown_zone")))
    asked_for = F.when(F.col("error_code") == "unknown_indicator", F.upper("indicator")).when(F.col("error_code") == "unknown_zone", F.col("zone"))
    shown = F.coalesce("hint", F.concat(F.lit("closest:"), F.col("closest")))
    return told.withColumn("word", asked_for).join(close, ["error_code", "word"], "left").select(
        "request_id", "indicator", "zone", "error_code", shown.alias("hint"))


def _outside(values: Column, allowed: tuple) -> Column:
    return F.exists(values, lambda v: v.isNull() | ~v.isin(*allowed))


def validate_specs(specs: DataFrame) -> DataFrame:
    """`id, problem`: one row per violation. `file` and `extra_fields` are used when present."""
    e = F.col("extraction")
    cube, raster, points = (F.col("source") == s for s in SOURCES)
    months = e["temporal_agg"]["months"]
    no_list = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = {
        "id_malformed": ~F.coalesce(F.col("id"), F.lit("")).rlike(r"^[\p{L}\p{N}_]+$"),
        "label_missing": F.col("label").isNull(),
        "unit_missing": F.col("unit").isNull(),
        "source_unknown": F.col("source").isNull() | ~F.col("source").isin(*SOURCES),
        "frequency_unknown": F.col("frequency").isNull() | ~F.col("frequency").isin(*FREQUENCIES),
        "levels_empty": no_list(F.col("geo_levels")),
        "level_unknown": _outside(F.coalesce("geo_levels", F.array().cast("array<string>")), LEVELS),
        "vintage_unknown": ~F.coalesce("nuts_vintage", F.lit(CURRENT_VINTAGE)).isin(CURRENT_VINTAGE, PREVIOUS_VINTAGE),
        "dataset_missing": cube & blank(e["dataset"]),
        "product_missing": raster & blank(e["product"]),
        "variable_missing": raster & blank(e["variable"]),
        "temporal_agg_missing": raster & e["temporal_agg"].isNull(),
        "month_out_of_range": raster & F.exists(F.coalesce(months, F.array().cast("array<int>")), lambda m: ~m.between(1, 12)),
        "temporal_stat_unknown": raster & ~F.coalesce(e["temporal_agg"]["stat"], F.lit("mean")).isin(*TEMPORAL_STATS),
        "zonal_stat_unknown": raster & ~F.coalesce(e["zonal_stat"], F.lit("mean")).isin(*ZONAL_STATS),
        "tags_empty": points & no_list(e["tags"]),
        "elements_empty": points & no_list(e["geometry"]),
        "element_unknown": points & _outside(F.coalesce(e["geometry"], F.array().cast("array<string>")), ELEMENT_TYPES),
        "aggregation_unknown": points & (F.coalesce(e["aggregation"], F.lit("count")) != "count"),
    }
    if "file" in specs.columns:
        checks["id_differs_from_file"] = ~F.col("id").eqNullSafe(F.col("file"))
    if "extra_fields" in specs.columns:
        checks["field_unknown"] = F.size("extra_fields") > 0
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks.items()]))
    single = specs.select("id", F.explode(found).alias("problem"))
    return single.unionByName(duplicate_ids(specs).select("id", F.lit("id_duplicated").alias("problem")))


def duplicate_ids(specs: DataFrame) -> DataFrame:
    return specs.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
