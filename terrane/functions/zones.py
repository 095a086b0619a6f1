"""Rules on zone codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LEVEL_BY_CODE_LENGTH, LEVELS

# Kinds of change that keep a zone's identity, and aggregate prefixes.
BIJECTIVE_CHANGES = ("", "Code change", "Name change")
AGGREGATE_PATTERN = r"^(EU|EA|EEA|EFTA)($|[12_])"


def level_of_code(code: Column) -> Column:
    level = None
    for length, name in LEVEL_BY_CODE_LENGTH.items():
        test = F.length(code) == length
        level = F.when(test, name) if level is None else level.when(test, name)
    return level


def level_depth(level: Column) -> Column:
    """0 for countries, up to 4 for cities."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def parent_code(code: Column) -> Column:
    return F.when(F.length(code) > 2, F.left(code, F.length(code) - 1))


def first_filled(*names: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def is_aggregate(code: Column) -> Column:
    return F.upper(code).rlike(AGGREGATE_PATTERN)


def is_bijective(old: Column, new: Column, change: Column) -> Column:
    filled = (F.coalesce(old, F.lit("")) != "") & (F.coalesce(new, F.lit("")) != "")
    return filled & F.coalesce(change, F.lit("")).isin(*BIJECTIVE_CHANGES)


def code_hint(code: Column) -> Column:
    """Why a code is outside the nomenclature, and what to use instead."""
    upper = F.upper(code)
    return (
        F.when(upper.startswith("GR"), F.concat(F.lit("use:EL"), F.substr(upper, F.lit(3))))
        .when((upper == "GB") | upper.startswith("UK"), "outside_nomenclature")
        .when(is_aggregate(code), "aggregate:use_cube")
    )


def level_hint(code: Column, level: Column, offered: Column) -> Column:
    """Correction when a zone's level is not among the `offered` levels.

    A finer offered level wins (nearest first); else the enclosing zone at the
    finest coarser level; else only the level to list.
    """
    depth = level_depth(level)
    ranked = F.sort_array(F.transform(offered, lambda v: F.named_struct(F.lit("d"), level_depth(v), F.lit("v"), v)))
    finer = F.filter(ranked, lambda r: r["d"] > depth)
    coarsest_first = F.element_at(ranked, -1)
    length = coarsest_first["d"] + 2
    enclosing = (coarsest_first["d"] < 4) & (F.length(code) > length) & (level != "CITY")
    return (
        F.when(F.size(finer) > 0, F.concat(F.lit("list:"), F.get(finer, F.lit(0))["v"], F.lit("<"), code))
        .when(enclosing, F.concat(F.lit("ancestor:"), F.left(code, length)))
        .otherwise(F.concat(F.lit("list:"), coarsest_first["v"]))
    )


def zone_country(code: Column, country: Column | None = None) -> Column:
    prefix = F.left(code, F.lit(2))
    return F.upper(F.coalesce(country, prefix) if country is not None else prefix)
