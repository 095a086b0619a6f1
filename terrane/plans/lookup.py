"""Listing and finding: zones, indicators, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import materialization_status
from ..operators.reports import bounded
from ..operators.search import build_index, corpus_statistics, search_all_then_any, search_any
from ..operators.zones import city_zones, list_zones, nuts_zones, zone_reference
from ..schemas import CURRENT_VINTAGE, MAX_ROWS
from ..session import cut_lineage
from ..sources.postings import read_index, refresh_index


def zones_page(zones: DataFrame, level: str, parent: str = "", contains: str = "", limit: int = MAX_ROWS) -> DataFrame:
    """The first zones of a level by code, with `truncated`."""
    return bounded(list_zones(zones, level, parent, contains), F.col("geo_code"), limit=limit)


def build_zone_reference(levels: dict[str, DataFrame], cities: DataFrame | None = None,
                         vintage: int = CURRENT_VINTAGE) -> DataFrame:
    """Zone table from the features of each level and, last, of the cities."""
    parts = [nuts_zones(features, level, vintage) for level, features in levels.items()]
    return zone_reference(parts + ([city_zones(cities, vintage)] if cities is not None else []))


def search_indicators(queries: DataFrame, specs: DataFrame, present: DataFrame, source: str = "",
                      limit: int = 10) -> DataFrame:
    """Specs found by any term of id, label or description, best first, with `materialized`."""
    docs = specs.select(F.col("id").alias("doc"), F.col("id").alias("code"), "label", "description", "source")
    index = cut_lineage(build_index(docs, "code", "label", "description"))
    hits = search_any(queries, index, corpus_statistics(index, docs), docs, source, limit)
    shown = materialization_status(specs, present).select(
        F.col("id").alias("doc"), "label", "unit", "frequency", "geo_levels", "source", "materialized")
    return hits.join(shown, "doc").withColumnRenamed("doc", "id")


def search_datasets(queries: DataFrame, catalogue: DataFrame, limit: int = 10, root: str | None = None) -> DataFrame:
    """Datasets with all terms of the query in any catalogue column, else with any, marked `partial`.

    With `root`, the index at rest there is brought up to date with the catalogue and searched; else one is made for the occasion.
    """
    fields = ["code", "title", "data_start", "data_end", "last_update"]
    docs = catalogue.select(F.col("code").alias("doc"), *fields)
    if root:
        refresh_index(docs, root, *fields)
        index, known = read_index(catalogue.sparkSession, root)
    else:
        index, known = cut_lineage(build_index(docs, *fields)), docs
    hits = search_all_then_any(queries, index, corpus_statistics(index, known), limit)
    return hits.join(docs.select("doc", "title", "data_start", "data_end"), "doc").withColumnRenamed("doc", "code")
