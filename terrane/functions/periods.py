"""Period strings: `2023`, `2023-S2`, `2023-Q4`, `2023-10`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_key(period: Column) -> Column:
    """Chronological sort key `(year, month, grain)` of a period.

    Grain 0 is a year, 1 a semester, 2 a quarter, 3 a month and 9 any other
    suffix; text without a leading year sorts first as (0, 0, 0).
    """
    year = F.regexp_extract(period, r"^(\d+)(?:-|$)", 1)
    suffix = F.when(F.instr(period, "-") > 0, F.regexp_extract(period, r"^[^-]*-(?s:(.*))$", 1)).otherwise("")
    number = F.regexp_extract(suffix, r"^[SQ]?(\d+)$", 1).try_cast("int")
    part = F.substring(suffix, 1, 1)
    known = number.isNotNull()
    month = (
        F.when(known & (part == "S"), (number - 1) * 6 + 1)
        .when(known & (part == "Q"), (number - 1) * 3 + 1)
        .when(known, number)
        .otherwise(0)
    )
    grain = (
        F.when(suffix == "", 0)
        .when(known & (part == "S"), 1)
        .when(known & (part == "Q"), 2)
        .when(known, 3)
        .otherwise(9)
    )
    valid = year != ""
    return F.struct(
        F.when(valid, year.try_cast("int")).otherwise(0).alias("year"),
        F.when(valid, month).otherwise(0).alias("month"),
        F.when(valid, grain).otherwise(0).alias("grain"),
    )


def period_order(period: Column) -> Column:
    """`period_key` with the text itself as the tie-break."""
    key = period_key(period)
    return F.struct(
        key["year"].alias("year"), key["month"].alias("month"), key["grain"].alias("grain"),
        period.alias("period"),
    )


def in_window(period: Column, time_from: str = "", time_to: str = "") -> Column:
    """Inclusive window on the text; `time_to="2023"` also covers `2023-Q4` and `2023-12`."""
    keep = F.lit(True)
    if time_from:
        keep = keep & (period >= time_from)
    if time_to:
        keep = keep & ((period <= time_to) | period.startswith(f"{time_to}-"))
    return keep


def year_list(text: Column) -> Column:
    """`2020-2022,2024` -> sorted array of distinct years; null when a chunk is unreadable."""
    chunks = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda c: c != "")
    readable = F.forall(chunks, lambda c: c.rlike(r"^\d+\s*(-\s*\d+)?$"))

    def expand(chunk: Column) -> Column:
        first = F.regexp_extract(chunk, r"^(\d+)", 1).try_cast("int")
        last = F.coalesce(F.regexp_extract(chunk, r"-\s*(\d+)$", 1).try_cast("int"), first)
        return F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(
            F.array().cast("array<int>"))

    return F.when(readable, F.array_sort(F.array_distinct(F.flatten(F.transform(chunks, expand)))))


def month_stamp(timestamp: Column) -> Column:
    """`YYYY-MM` of a strict `YYYY-MM-DDThh:mm:ssZ` text, else null."""
    clean = F.trim(timestamp)
    return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.substring(clean, 1, 7))
