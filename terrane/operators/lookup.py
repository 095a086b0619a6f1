"""Native cubes: filters with several codes, code lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded, AI_COLLATION
from ..schemas import MAX_CODES_PER_DIM, MAX_LISTED_CODES
from .search import similar_terms
from .validate import suggestions

#: How alike a known code must be to be suggested.
LIKE_CODE = (3, 5)


def split_codes(raw: str) -> list[str]:
    return [c.strip() for c in raw.split("+") if c.strip()]


def codes_filter(filters: dict[str, str], dims: Column | None = None) -> Column:
    """`{dim: "A+B"}` as AND of memberships; dimensions are columns, or keys of the map `dims`."""
    tests = [(F.col(d) if dims is None else dims[d]).isin(split_codes(raw)) for d, raw in filters.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def unknown_codes(filters: dict[str, str], codelist: DataFrame) -> DataFrame:
    """Filter entries that the dataset's code list does not know: `dim, code, problem, closest`.

    `closest` has up to three known codes of the dimension, or known dimensions, that are most like the entry.
    """
    spark = codelist.sparkSession
    asked = spark.createDataFrame(
        [(d, c) for d, raw in filters.items() for c in split_codes(raw)], "dim string, code string")
    dims = codelist.select("dim").distinct().withColumn("dim_known", F.lit(True))
    codes = codelist.select("dim", "code").distinct().withColumn("code_known", F.lit(True))
    checked = asked.join(dims, "dim", "left").join(codes, ["dim", "code"], "left")
    wrong = checked.where("code_known is null").select(
        "dim", "code", F.when(F.col("dim_known").isNull(), "unknown_dimension").otherwise("unknown_code").alias("problem"))
    lost = suggestions(wrong.where("problem = 'unknown_dimension'").select(F.col("dim").alias("word")),
                       dims.select(F.col("dim").alias("term")), LIKE_CODE).select(F.col("word").alias("key"), "closest")
    near = closest_codes(wrong.where("problem = 'unknown_code'"), codes.join(wrong.select("dim").distinct(), "dim", "left_semi"))
    found = lost.unionByName(near)
    key = F.when(F.col("problem") == "unknown_code", F.upper(F.concat("dim", F.lit("\x1f"), "code"))).otherwise(F.upper("dim"))
    return wrong.withColumn("key", key).join(found, "key", "left").select("dim", "code", "problem", "closest")


def closest_codes(wrong: DataFrame, codes: DataFrame) -> DataFrame:
    """`key, closest` of (dim, code): the known codes of the same dimension most like an unknown one."""
    pairs = similar_terms(wrong.select(F.upper("code").alias("word")).distinct(), codes.select(F.upper("code").alias("term")).distinct(), LIKE_CODE)
    met = wrong.select("dim", F.upper("code").alias("word")).distinct().join(pairs, "word").join(
        codes.select("dim", "code", F.upper("code").alias("term")), ["dim", "term"])
    best = Window.partitionBy("dim", "word").orderBy(F.col("ratio").desc(), "term", "code")
    first = met.withColumn("place", F.row_number().over(best)).where("place <= 3").groupBy("dim", "word").agg(
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("s"))
    return first.select(F.upper(F.concat("dim", F.lit("\x1f"), "word")).alias("key"), F.array_join(F.transform("s", lambda x: x["code"]), ",").alias("closest"))


def list_codes(codelist: DataFrame, contains: str = "", limit: int = MAX_LISTED_CODES) -> DataFrame:
    """Codes ranked: prefix hits first (short codes on top), then codes, then labels containing the text.

    Adds `place` and `remaining`, the number of hits beyond `limit`. Rows are
    those of one dimension, hence short; `codelist` may hold several datasets
    and dimensions, each ranked on its own.
    """
    starts = F.startswith(F.collate("code", AI_COLLATION), F.collate(F.lit(contains), AI_COLLATION))
    rank = (
        F.when(starts, 0)
        .when(contains_folded(F.col("code"), contains), 1)
        .when(contains_folded(F.coalesce("label", F.lit("")), contains), 2)
    )
    hits = codelist.select("*", rank.alias("rank")).where(F.col("rank").isNotNull())
    order = ["rank", F.when(F.col("rank") == 0, F.length("code")).otherwise(0), "pos", "code"]
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("dataset", "dim").orderBy(*order)))
    total = hits.groupBy("dataset", "dim").agg(F.count(F.lit(1)).alias("hits"))
    return ranked.where(F.col("place") <= limit).join(total, ["dataset", "dim"]).select(
        "dataset", "dim", "place", "code", "label", "rank", F.greatest(F.col("hits") - limit, F.lit(0)).alias("remaining"))


def structure_summary(codelist: DataFrame, limit: int = MAX_CODES_PER_DIM, periods: DataFrame | None = None) -> DataFrame:
    """The first codes of each dimension and how many more there are.

    With `periods` (`code, data_start, data_end` of datasets) also the span of the dataset, null where it isn't known.
    """
    first = Window.partitionBy("dataset", "dim").orderBy("pos", "code")
    total = codelist.groupBy("dataset", "dim").agg(F.count(F.lit(1)).alias("codes"), F.max("dim_label").alias("dim_label"))
    shown = codelist.select("dataset", "dim", "code", "label", F.row_number().over(first).alias("place")).where(
        F.col("place") <= limit)
    span = [] if periods is None else ["data_start", "data_end"]
    found = shown.join(total, ["dataset", "dim"])
    if periods is not None:
        found = found.join(periods.select(F.col("code").alias("dataset"), *span), "dataset", "left")
    return found.select("dataset", "dim", "dim_label", "place", "code", "label", F.greatest(F.col("codes") - limit, F.lit(0)).alias("remaining"), *span)
