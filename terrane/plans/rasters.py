"""The raster sync: every raster spec of the table in one run over each feed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bbox, bbox_intersects
from ..functions.periods import year_list
from ..functions.rasters import apply_offset, feed_of, pick_variable, sampled_steps, unit_offset
from ..functions.zones import zone_country
from ..operators.coverage import Grid
from ..operators.incremental import merge_years, year_delta
from ..operators.zonal import coverage_quality, merge_partials, month_choice, monthly_partials, statistic, zonal_by_spec
from ..schemas import STATE, TEMPORAL_STATS, ZONAL_STATS
from ..session import cut_lineage
from ..sources.canonical import canonical_rows, read_canonical, write_canonical
from ..sources.files import upsert_state

_LAST = ":last_year"


@dataclass
class Feed:
    """A raster table and what is known of it.

    `raster`: `product, variable, ts, lat, lon, value`; `products`: `product, units, source_date, quality`. With
    `per_month`, only that many sampled steps of a month count, as for a source where each step is dear to read.
    """

    raster: DataFrame
    grid: Grid
    products: DataFrame
    per_month: int | None = None


def scope(zones: DataFrame, levels: list[str], countries: tuple[str, ...] = (), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Zones of the levels, in the countries (none: all) and with a bounding box that meets `box` (west, south, east, north)."""
    country = F.col("country") if "country" in zones.columns else None
    kept = zones.where(F.col("level").isin(levels))
    if countries:
        kept = kept.where(zone_country(F.col("geo_code"), country).isin([c.strip().upper() for c in countries]))
    if box:
        kept = kept.where(bbox_intersects(bbox(F.col("geometry")), *box))
    return kept.select("geo_code", "level", "geometry")


def raster_specs(specs: DataFrame, source: str, feeds: list[str], override: str = "") -> DataFrame:
    """The source's specs, flat, with the `feed` that serves each and the `reason` why one can't be run."""
    e = F.col("extraction")
    stat, zonal = F.coalesce(e["temporal_agg"]["stat"], F.lit("mean")), F.coalesce(e["zonal_stat"], F.lit("mean"))
    feed = feed_of(e["product"], override)
    reason = F.when(~stat.isin(*TEMPORAL_STATS), "temporal_stat").when(~zonal.isin(*ZONAL_STATS), "zonal_stat").when(~feed.isin(feeds), "no_feed")
    return specs.where(F.col("source") == source).select(
        F.col("id").alias("indicator"), "unit", "geo_levels", e["product"].alias("product"), e["variable"].alias("wanted"),
        e["temporal_agg"]["months"].alias("months"), stat.alias("stat"), zonal.alias("zonal_stat"), feed.alias("feed"), reason.alias("reason"))


def feed_partials(feed: Feed, products: list[str], years: list[int], box: tuple[float, float, float, float]) -> DataFrame:
    """`product, variable, year, month, i, j` with mergeable statistics: the one scan of a feed, cropped to `box` and a cell around."""
    raw, grid = feed.raster, feed.grid
    west, south, east, north = box
    year = F.year("ts")
    raw = raw.where(F.col("product").isin(products) & F.col("lon").between(west - grid.dx, east + grid.dx)
                    & F.col("lat").between(south - grid.dy, north + grid.dy)
                    & (F.col("ts") >= F.lit(datetime(min(years), 1, 1))) & (F.col("ts") < F.lit(datetime(max(years) + 1, 1, 1))) & year.isin(years))
    if feed.per_month:
        steps = sampled_steps(year, F.array(F.month("ts")), feed.per_month)
        raw = raw.where(F.array_contains(steps, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    placed = raw.select("product", "variable", year.alias("year"), "ts", "value", grid.column(F.col("lon")).alias("i"), grid.row(F.col("lat")).alias("j"))
    return monthly_partials(placed, ["product", "variable", "year", "i", "j"])


def asked_of(partials: DataFrame, work: DataFrame) -> DataFrame:
    """`work` with the `variable` that serves each spec, the months to take, and the `reason` if there is nothing to read."""
    present = partials.groupBy("product", "variable", "year").agg(F.collect_set("month").alias("present"))
    present = cut_lineage(present)
    variables = present.groupBy("product").agg(F.collect_set("variable").alias("variables"))
    named = work.join(variables, "product", "left").withColumn("variable", pick_variable(F.col("wanted"), F.col("variables"))).drop("reason")
    chosen, matched = month_choice(F.col("months"), F.col("present"))
    reason = F.when(F.col("variables").isNull(), "no_raster").when(F.col("variable").isNull(), "no_variable").when(F.col("present").isNull(), "no_raster")
    return named.join(present, ["product", "variable", "year"], "left").select(
        *work.columns[:work.columns.index("reason")], "variable", chosen.alias("chosen"), matched.alias("months_matched"), reason.alias("reason"))


def spec_cells(partials: DataFrame, asked: DataFrame) -> DataFrame:
    """`indicator, year, i, j, value`: the temporal statistic of every spec from the same partials."""
    wanted = asked.where("reason is null").select("indicator", "product", "variable", "year", "stat", "chosen")
    taken = partials.join(wanted, ["product", "variable", "year"]).where(F.array_contains("chosen", F.col("month")))
    return merge_partials(taken, ["indicator", "stat", "year", "i", "j"]).select("indicator", "year", "i", "j", statistic(F.col("stat")).alias("value"))


def spec_rows(cells: DataFrame, zones: DataFrame, asked: DataFrame, feed: Feed, medians: bool) -> DataFrame:
    """Measured rows `indicator, geo_code, level, time, year, value, quality, source_date` of the specs of a feed."""
    specs = asked.select("indicator", "unit", "product", "zonal_stat", "geo_levels").distinct().join(feed.products, "product", "left")
    found = zonal_by_spec(cells.withColumn("time", F.col("year").cast("string")), zones, feed.grid, asked.select(
        "indicator", "zonal_stat", "geo_levels").distinct(), medians)
    top = cells.groupBy("indicator", "year").agg(F.max("value").alias("sample_max"))
    found = found.withColumn("year", F.col("time").cast("int")).join(top, ["indicator", "year"]).join(specs.drop("geo_levels", "product"), "indicator")
    shift = unit_offset(F.col("unit"), F.col("units"), F.col("sample_max"))
    return found.select("indicator", "geo_code", "level", "time", "year", apply_offset(F.col("value"), F.col("zonal_stat"), shift).alias("value"),
                        coverage_quality(F.coalesce("quality", F.lit(""))).alias("quality"), "source_date")


def _outcomes(rows: DataFrame, source: str, status: str, reason: Column, written: Column, years: Column) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.col("indicator").alias("key"), F.lit(status).alias("status"), reason.cast("string").alias("reason"),
                       written.cast("long").alias("rows"), years.cast("string").alias("years"))


def sync_rasters(spark: SparkSession, feeds: dict[str, Feed], zones: DataFrame, specs: DataFrame, years: str | list[int], root: str, state: DataFrame,
                 source: str, now: datetime, countries: tuple[str, ...] = (), box: tuple[float, float, float, float] | None = None, full: bool = False,
                 override: str = "") -> tuple[DataFrame, DataFrame]:
    """One run over all raster specs: `source, key, status, reason, rows, years` per spec, and the state after it.

    A spec gets the years after the last one in the state (`full`: all). Each feed is scanned once for all its specs and
    years; months, statistics and zones are settled on what is summed up. A spec is `updated` and replaced by the years
    it keeps and the new ones under the newest source date, `unchanged` without new years, or `failed` with a reason: `years` (the list can't be
    read), `scope` (no zone), `temporal_stat`, `zonal_stat`, `no_feed`, `no_raster`, `no_variable`, `no_zone` (a year without any covered zone). A failed spec
    keeps its rows and its state, and doesn't stop the others.
    """
    flat = cut_lineage(raster_specs(specs, source, list(feeds), override))
    nothing, none = F.lit(0), F.lit(None)
    if isinstance(years, str):
        years = spark.range(1).select(year_list(F.lit(years)).alias("y")).first().y
    if years is None:
        return _outcomes(flat, source, "failed", F.lit("years"), nothing, none), state
    levels = sorted({r[0] for r in flat.select(F.explode("geo_levels")).distinct().collect()})
    inside = cut_lineage(scope(zones, levels, countries, box))
    corners = bbox(F.col("geometry"))
    found = inside.select(corners.alias("b")).agg(F.min("b.west"), F.min("b.south"), F.max("b.east"), F.max("b.north")).first()
    if found[0] is None:
        return _outcomes(flat, source, "failed", F.lit("scope"), nothing, none), state
    last = state.where((F.col("source") == source) & F.col("key").endswith(_LAST)).select(
        F.expr(f"left(key, length(key) - {len(_LAST)})").alias("indicator"), F.col("value").try_cast("int").alias("last_year"))
    work = cut_lineage(flat.where("reason is null").join(year_delta(flat, years, last, full), "indicator").select(*flat.columns[:-1], "year", "reason"))
    outcomes = [_outcomes(flat.where("reason is not null"), source, "failed", F.col("reason"), nothing, none),
                _outcomes(flat.where("reason is null").join(work, "indicator", "left_anti"), source, "unchanged", none, nothing, none)]
    rows, reasons = [], []
    for name, feed in feeds.items():
        own = work.where(F.col("feed") == name)
        # products, years and statistics of the specs are configuration
        asks = own.groupBy().agg(F.collect_set("product"), F.collect_set("year"), F.bool_or(F.col("zonal_stat") == "median")).first()
        if not asks[1]:
            continue
        partials = cut_lineage(feed_partials(feed, sorted(asks[0]), sorted(asks[1]), box or tuple(found)))
        asked = cut_lineage(asked_of(partials, own))
        cells = cut_lineage(spec_cells(partials, asked))
        made = cut_lineage(spec_rows(cells, inside, asked.where("reason is null"), feed, asks[2]))
        rows.append(made)
        covered = made.select("indicator", "year").distinct().withColumn("covered", F.lit(True))
        reasons.append(asked.join(covered, ["indicator", "year"], "left").select(
            "indicator", "year", F.coalesce("reason", F.when(F.col("covered").isNull(), "no_zone")).alias("reason")))
    if not rows:
        return _union(outcomes), state
    told = cut_lineage(_union(reasons).groupBy("indicator").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reason"), F.array_sort(F.collect_set("year")).alias("years")))
    good = told.where("reason = ''").select("indicator", "years")
    fresh = _union(rows).join(good.select("indicator"), "indicator", "left_semi")
    dates = fresh.groupBy("indicator").agg(F.max_by("source_date", "year").alias("source_date"))
    ids = sorted(r[0] for r in good.select("indicator").collect())
    kept = read_canonical(spark, root, ids).select("indicator", "geo_code", "time", "value", "quality")
    # the partitions being read are those replaced, so the merge is written aside first
    merged = cut_lineage(merge_years(kept, fresh.select(*kept.columns)))
    stamped = merged.join(dates, "indicator").join(flat.select("indicator", "unit"), "indicator")
    write_canonical(canonical_rows(stamped, F.col("indicator"), F.col("unit"), source, F.col("source_date"), now), root, ids)
    counts = good.join(merged.groupBy("indicator").agg(F.count(F.lit(1)).alias("n")), "indicator")
    outcomes.append(_outcomes(told.where("reason <> ''"), source, "failed", F.col("reason"), nothing, none))
    outcomes.append(_outcomes(counts, source, "updated", none, F.col("n"), F.array_join("years", ", ")))
    done = good.select(F.lit(source).alias("source"), F.concat("indicator", F.lit(_LAST)).alias("key"), F.array_max("years").cast("string").alias("value"),
                       F.lit(now).cast("timestamp_ntz").alias("updated_at"))
    return cut_lineage(_union(outcomes)), cut_lineage(upsert_state(state, done).select(*STATE.names))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
