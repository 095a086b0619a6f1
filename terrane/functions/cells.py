"""Text of a value cell and quality marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two exact halves


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once; keeps long expressions short."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halves(x: Column) -> Column:
    high = x * _SPLITTER - (x * _SPLITTER - x)
    return F.struct(high.alias("high"), (x - high).alias("low"))


def _round_product(size: Column, scale: Column) -> Column:
    """`size * scale` to the nearest integer, ties decided on the exact product, half to even."""

    def decide(product: Column, a: Column, b: Column) -> Column:
        error = (((a["high"] * b["high"] - product) + a["high"] * b["low"]) + a["low"] * b["high"]) + a["low"] * b["low"]
        whole = F.floor(product)
        rest = product - whole
        odd = F.pmod(whole, F.lit(2)) == 1
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
        return (whole + F.when(up, 1).otherwise(0)).cast("double")

    return _let(size * scale, lambda p: _let(_halves(size), lambda a: _let(_halves(scale), lambda b: decide(p, a, b))))


def _six_digits(value: Column) -> Column:
    """`value` rounded to six significant digits on its exact binary value.

    The JVM formatter rounds the shortest decimal text half up, which moves
    12345.65 (stored slightly below) to 12345.7. The error of the product
    `value * 10^k` tells on which side of the tie the stored number lies.
    """
    shift = F.lit(DIGITS - 1) - F.floor(F.log10(F.abs(value)))

    def at(k: Column) -> Column:
        scale = F.pow(F.lit(10.0), k.cast("double"))
        rounded = _let(scale, lambda s: _round_product(F.abs(value), s) / s)
        return F.when((k >= 0) & (k <= 22), F.signum(value) * rounded).otherwise(value)

    return _let(shift, at)


def _text(value: Column) -> Column:
    digits = F.format_string("%.6g", _six_digits(value))
    digits = F.regexp_replace(digits, r"(\.\d*?)0+(e|$)", "$1$2")
    digits = F.regexp_replace(digits, r"\.(e|$)", "$1")
    whole = (value == F.floor(value).cast("double")) & (F.abs(value) < 1e15)
    return (
        F.when(value.isNull() | F.isnan(value), "")
        .when(value.isin(float("inf"), float("-inf")), F.when(value > 0, "inf").otherwise("-inf"))
        .when(whole, value.cast("bigint").cast("string"))
        .otherwise(digits)
    )


def format_value(value: Column) -> Column:
    """Integers as such, else six significant digits without trailing zeros; null is empty."""
    return _let(value, _text)


def value_cell(value: Column, quality: Column) -> Column:
    """`value [mark]`, the mark only when there is one."""
    mark = F.when(F.coalesce(quality, F.lit("")) != "", F.concat(F.lit(" ["), quality, F.lit("]"))).otherwise("")
    return F.concat(format_value(value), mark)


def blank_to_null(flag: Column) -> Column:
    return F.nullif(F.trim(flag), F.lit(""))


def merge_quality(recoded: Column, flag: Column) -> Column:
    """`recoded,flag`; either part may be missing."""
    return F.concat_ws(",", F.when(recoded, "recoded"), blank_to_null(flag))
