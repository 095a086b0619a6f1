"""JSON-stat documents: sparse or dense values, and code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIMENSION = "map<string,struct<label:string,category:struct<index:map<string,int>,label:map<string,string>>>>"
_HEAD = f"id array<string>, size array<int>, dimension {_DIMENSION}"


def explode_jsonstat(docs: DataFrame, json: str = "json") -> DataFrame:
    """One row per value: the other columns of `docs`, `coords` (dimension -> code) and `value`.

    A linear index is unfolded with the stride of each dimension, the last one
    running fastest.
    """
    keep = [c for c in docs.columns if c != json]
    parsed = docs.select(
        *keep,
        F.from_json(json, _HEAD).alias("h"),
        F.from_json(F.get_json_object(json, "$.value"), "map<string,string>").alias("sparse"),
        F.from_json(F.get_json_object(json, "$.value"), "array<string>").alias("dense"),
        F.get_json_object(json, "$.value").startswith("[").alias("is_list"),
    )
    listed = F.transform("dense", lambda v, i: F.struct(i.cast("bigint").alias("i"), v.alias("v")))
    mapped = F.transform(F.map_entries("sparse"), lambda e: F.struct(e["key"].cast("bigint").alias("i"), e["value"].alias("v")))
    ordered = F.transform(
        F.col("h.id"),
        lambda d: F.transform(
            F.sort_array(F.transform(F.map_entries(F.col("h.dimension")[d]["category"]["index"]),
                                     lambda e: F.named_struct(F.lit("pos"), e["value"], F.lit("code"), e["key"]))),
            lambda s: s["code"]),
    )
    strides = F.transform(
        F.col("h.size"),
        lambda _, k: F.aggregate(F.slice(F.col("h.size"), k + 2, F.size("h.size")), F.lit(1).cast("bigint"),
                                 lambda acc, n: acc * n),
    )
    read = parsed.select(
        *keep, F.col("h.id").alias("ids"), F.col("h.size").alias("sizes"), ordered.alias("codes"), strides.alias("strides"),
        F.when(F.col("is_list"), listed).otherwise(mapped).alias("cells"))

    # codes are looked up inside the document's row, so that no cell carries the code lists along
    def named(cell: Column) -> Column:
        code = F.transform("ids", lambda _, k: F.get(F.get("codes", k), F.pmod(
            F.floor(cell["i"] / F.get("strides", k)).cast("bigint"), F.get("sizes", k).cast("bigint")).cast("int")))
        return F.struct(F.map_from_arrays("ids", code).alias("coords"), cell["v"].alias("value"))

    return read.select(*keep, F.explode(F.transform("cells", named)).alias("c")).select(*keep, "c.coords", "c.value")


def explode_structure(docs: DataFrame, json: str = "json") -> DataFrame:
    """Code list rows `dim, dim_label, pos, code, label`; a missing label falls back to the code."""
    keep = [c for c in docs.columns if c != json]
    dims = docs.select(*keep, F.from_json(json, _HEAD).alias("h")).select(
        *keep, "h.dimension", F.explode("h.id").alias("dim"))
    detail = F.col("dimension")[F.col("dim")]
    index, label = detail["category"]["index"], detail["category"]["label"]
    use_labels = F.coalesce(F.size(label) > 0, F.lit(False))
    codes = F.when(use_labels, F.map_keys(label)).otherwise(F.map_keys(index))
    listed = dims.select(
        *keep, "dim", F.coalesce(detail["label"], F.col("dim")).alias("dim_label"),
        label.alias("labels"), index.alias("positions"), F.posexplode(codes).alias("listed", "code"))
    return listed.select(
        *keep, "dim", "dim_label",
        F.coalesce(F.col("positions")[F.col("code")], F.col("listed")).alias("pos"),
        "code", F.coalesce(F.col("labels")[F.col("code")], F.col("code")).alias("label"))
