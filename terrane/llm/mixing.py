"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import cut_lineage

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2),
                   cap: int = 2) -> DataFrame:
    """Target of each source of (source, size).

    Sources in order of code points, null last, get the weights in turn. Together they get `share` (a fraction) of
    all sizes in proportion to their weights, none more than `cap` times its own size; what is cut off goes to the
    others by weight. Sources meet their limit in the order of size per weight, so one pass over the sorted sources
    finds the limited ones. One row per source: configuration, unlike the documents.
    """
    up, down = share
    exact = "decimal(38,0)"
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    limit = F.col("source_size") * cap
    return (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                               ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
            .withColumn("whole", F.sum("source_size").over(every).cast(exact) * up)
            .withColumn("used", F.coalesce(F.sum(limit).over(before), F.lit(0)).cast(exact) * down)
            .withColumn("left", F.sum("weight").over(onward))
            .withColumn("limited", (F.col("whole") - F.col("used")) * F.col("weight") >= limit.cast(exact) * F.col("left") * down)
            .withColumn("used", F.sum(F.when(F.col("limited"), limit).otherwise(0)).over(every).cast(exact) * down)
            .withColumn("left", F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(every) * down)
            .select("source", "source_size", F.when(F.col("limited"), limit.cast("double")).otherwise(
                (F.col("weight") * (F.col("whole") - F.col("used"))).cast("double") / F.col("left").cast("double")).alias("target")))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1), the same in every run with the same seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2),
            cap: int = 2, seed: int = 42) -> DataFrame:
    """How often each row of `docs` goes into the mix.

    `docs` needs doc_id, text and source; the result has (row, source, size, source_size, target, copies), where
    `row` holds the columns `carry` of `docs` in a struct, so their names can't clash. Within a source the rows stand in
    order of size, then doc_id. A row's expected copies are target / source_size; they are summed up along that
    order, starting at the source's offset, and the row is taken once for each whole number the sum passes. Hence a
    row is taken at most ceil(cap) times, and since neighbours have like sizes, the words taken stay within about
    one longest text of the target.

    The order is cut into ranges of (source, size, doc_id), so a source of any size spreads over many tasks; a
    rank is the place within its range plus the rows of earlier ranges. The ranged rows are written to the shared
    folder once, so ranks and totals read the same ranges.

    Null or empty text: size 0, taken like any other row, adds no words. Null source: a source of its own.
    Null doc_id and repeated rows: each row counts by itself. Empty table: empty result. A source without words:
    target 0, no copies.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "source",
                        word_count(F.col("text")).alias("size"), "doc_id", F.xxhash64("text").alias("tie"))
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("tie")]
    ranged = cut_lineage(sized.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("row", "source", "size", F.spark_partition_id().alias("range"),
                                 F.monotonically_increasing_id().alias("place")))
    ranges = ranged.groupBy("source", "range").agg(F.count("*").alias("rows"), F.min("place").alias("head"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    targets = source_targets(ranged, weights, share, cap).withColumn("u", offset(F.col("source"), seed)).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # at most a row for each range and source; written, so that the planner knows its size and need not move the rows
    heads = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("of"), F.col("range").alias("at"), "head", "before", "source_size", "target", "u", "rate")
    ranked = ranged.join(cut_lineage(heads), (F.col("range") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("place") - F.col("head") + F.col("before")
    copies = F.floor(F.col("rate") * (rank + 1) + F.col("u")) - F.floor(F.col("rate") * rank + F.col("u"))
    return ranked.select("row", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: every row of `docs` as often as `sampled` takes it, numbered by `copy` from 1.

    A column `copy` of `docs` is replaced.
    """
    taken = sampled(docs, docs.columns, **settings).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy"], F.col("_copy").alias("copy"))


def mixed_sources(docs: DataFrame, **settings) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, copies and taken words."""
    return sampled(docs, ["doc_id"], **settings).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "source_size", "target",
                                              "copies", (F.col("copies") * F.col("size")).alias("taken"))
