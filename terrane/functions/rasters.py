"""Rules on raster products: units, routing, sampled time steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statistics that commute with an offset, hours of the sampled steps, product names.
AFFINE_STATS = ("mean", "min", "max", "median")
SYNOPTIC_HOURS = (0, 6, 12, 18)
SHORT_NAMES = {"skin_temperature": "skt", "2m_temperature": "t2m"}
REANALYSIS_PREFIX = "reanalysis-"
KELVIN_OFFSET = -273.15
KELVIN_THRESHOLD = 100.0
COVERAGE_TOLERANCE = 0.999


def unit_offset(target_unit: Column, source_unit: Column, sample_max: Column) -> Column:
    """Offset to add so that a kelvin source answers a Celsius spec."""
    unit = F.upper(F.trim(F.coalesce(source_unit, F.lit(""))))
    return (
        F.when(F.coalesce(target_unit, F.lit("")) != "DEG_C", 0.0)
        .when(unit.isin("K", "KELVIN"), KELVIN_OFFSET)
        .when(unit != "", 0.0)
        .when(sample_max > KELVIN_THRESHOLD, KELVIN_OFFSET)
        .otherwise(0.0)
    )


def apply_offset(value: Column, stat: Column, offset: Column) -> Column:
    return F.when(stat.isin(*AFFINE_STATS), value + offset).otherwise(value)


def feed_of(product: Column, override: str = "", default: str = "reanalysis") -> Column:
    """Which raster table serves a product; an explicit choice wins."""
    if override:
        return F.lit(override.lower())
    return F.when(F.coalesce(product, F.lit("")).startswith(REANALYSIS_PREFIX), default).otherwise("local")


def pick_variable(wanted: Column, present: Column) -> Column:
    """Name under which `wanted` appears among `present`: itself, its short name or the only one."""
    short = F.create_map(*[F.lit(v) for pair in SHORT_NAMES.items() for v in pair])[wanted]
    return (
        F.when(F.array_contains(present, wanted), wanted)
        .when(short.isNotNull() & F.array_contains(present, F.coalesce(short, F.lit(""))), short)
        .when(F.size(present) == 1, F.get(present, F.lit(0)))
    )


def sampled_steps(year: Column, months: Column, per_month: int = 4) -> Column:
    """Sorted distinct sampled timestamps of a year: spread days, rotating synoptic hours."""
    chosen = F.when(F.size(months) > 0, months).otherwise(F.sequence(F.lit(1), F.lit(12)))

    def steps(month: Column) -> Column:
        first = F.make_date(year, month, F.lit(1))
        days = F.day(F.last_day(first))

        def step(i: Column) -> Column:
            day = F.bround((i + 0.5) * days / per_month).cast("int")
            day = F.least(F.greatest(day, F.lit(1)), days)
            hour = F.get(F.array(*[F.lit(h) for h in SYNOPTIC_HOURS]), F.pmod(i, F.lit(len(SYNOPTIC_HOURS))))
            return F.format_string("%04d-%02d-%02dT%02d:00:00", year, month, day, hour)

        return F.transform(F.sequence(F.lit(0), F.lit(per_month - 1)), step)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(chosen, steps))))
