"""Cube ingestion, projection and native queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import in_window
from ..operators.incremental import freshness_delta
from ..operators.lookup import codes_filter
from ..operators.projection import missing_dimensions, project_indicators
from ..operators.reports import bounded
from ..schemas import MAX_ROWS
from ..session import cut_lineage
from ..sources.canonical import canonical_rows, drop_partition, write_canonical
from ..sources.cubes import landed_files, read_cube, read_wide_cubes, wide_lines, wide_problems, write_cube
from ..sources.files import upsert_state


def ingest_cubes(spark: SparkSession, landing: str, root: str, remote: DataFrame, state: DataFrame,
                 full: bool = False) -> DataFrame:
    """Parse the wide files of new or changed datasets into the native store.

    `remote`: `key, signal` per dataset. Returns the delta with its status;
    only due datasets are parsed and replaced.
    """
    delta = freshness_delta(remote, state, full)
    # the list of due datasets is configuration-sized; it prunes the files before they are opened
    due = sorted(r[0] for r in delta.where(F.col("status") != "unchanged").select("key").collect())
    if due:
        write_cube(read_wide_cubes(spark, landing, due), root, due)
    return delta


def sync_cubes(spark: SparkSession, landing: str, root: str, remote: DataFrame, state: DataFrame, source: str,
               now: datetime, full: bool = False, quarantine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One run of the cube sync: `source, key, status, reason, rows` per dataset, and the state after it.

    A due dataset is `updated` with the rows it has now (else 0), or `failed` when nothing landed for it (`no_file`) or one of its
    files can't be read as a whole (`bad_file`); then its old rows and its old state stay, so the next run tries again,
    and the other datasets go on. What can't be read goes to the table `quarantine`, each dataset replacing its own. A second run
    with the same signals updates nothing.
    """
    files = cut_lineage(landed_files(spark, landing))
    landed = files.select(F.col("dataset").alias("key")).distinct().withColumn("landed", F.lit(True))
    known = state.where(F.col("source") == source).select("key", "value")
    delta = freshness_delta(remote, known, full).join(landed, "key", "left").fillna(False, ["landed"])
    due = F.col("status") != "unchanged"
    # the delta is read again after the store has changed, so it is kept
    delta = cut_lineage(delta)
    looked_at = sorted(r[0] for r in delta.where(due & F.col("landed")).select("key").collect())
    lines, n = wide_lines(spark, landing, looked_at)
    problems = cut_lineage(wide_problems(lines, files.where(F.col("dataset").isin(looked_at)), n))
    if quarantine and looked_at:
        write_problems(problems, quarantine, looked_at)
    broken = problems.where(F.col("reason").isin("no_header", "headers")).select(F.col("dataset").alias("key")).distinct().withColumn("broken", F.lit(True))
    delta = cut_lineage(delta.join(broken, "key", "left").fillna(False, ["broken"]))
    good = F.col("landed") & ~F.col("broken")
    ingest_cubes(spark, landing, root, delta.where(good).select("key", "signal"), known, full)
    names = sorted(r[0] for r in delta.where(due & good).select("key").collect())
    counts = read_cube(spark, root, names).groupBy(F.col("dataset").alias("key")).agg(F.count("*").alias("n")) if names else None
    counted = delta.join(counts, "key", "left") if names else delta.withColumn("n", F.lit(None).cast("long"))
    updated = due & good
    outcomes = counted.select(
        F.lit(source).alias("source"), "key", F.when(updated, "updated").when(due, "failed").otherwise("unchanged").alias("status"),
        F.when(due & ~F.col("landed"), "no_file").when(due & F.col("broken"), "bad_file").alias("reason"),
        F.when(updated, F.coalesce("n", F.lit(0))).otherwise(0).alias("rows"))
    fresh = delta.where(updated).select(F.lit(source).alias("source"), "key", F.col("signal").alias("value"),
                                        F.lit(now).cast("timestamp_ntz").alias("updated_at"))
    return outcomes, upsert_state(state, fresh)


def write_problems(problems: DataFrame, path: str, datasets: list[str]) -> None:
    """Replace the problems of the datasets; those without any lose what they had."""
    problems.hint("rebalance", "dataset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
    have = {r[0] for r in problems.select("dataset").distinct().collect()}
    for name in sorted(set(datasets) - have):
        drop_partition(problems.sparkSession, path, "dataset", name)


def spec_problems(cube: DataFrame, specs: DataFrame) -> DataFrame:
    """`indicator, dataset, dim`: dimensions that specs ask of datasets which are there but lack them."""
    dims = cube.select("dataset", F.explode(F.map_keys("dims")).alias("dim")).distinct()
    return missing_dimensions(dims, specs).join(dims.select("dataset").distinct(), "dataset", "left_semi").select("indicator", "dataset", "dim")


def project_all(cube: DataFrame, specs: DataFrame, zones: DataFrame, changes: DataFrame | None, root: str,
                source_dates: DataFrame | None = None, ingested_at: datetime | None = None) -> int:
    """Re-materialise every cube spec in one job; returns the rows written.

    Specs that ask for a dimension their dataset lacks are left out (`spec_problems` lists them), so a misspelt filter
    does not empty an indicator.
    """
    wrong = {r[0] for r in spec_problems(cube, specs).select("indicator").distinct().collect()}
    ids = [r.id for r in specs.where(F.col("extraction.dataset").isNotNull()).select("id").collect() if r.id not in wrong]
    specs = specs.where(F.col("id").isin(ids))
    rows = project_indicators(cube, specs, zones, changes, source_dates)
    full = canonical_rows(rows, F.col("indicator"), F.col("unit"), F.col("source"), F.col("source_date"), ingested_at)
    return write_canonical(full, root, ids)


def project_only(spark: SparkSession, cube_root: str, specs: DataFrame, zones: DataFrame,
                 changes: DataFrame | None, root: str, source_dates: DataFrame | None = None) -> int:
    """Project again from the native store, reading only the datasets the specs name."""
    datasets = [r.d for r in specs.select(F.col("extraction.dataset").alias("d")).distinct().collect() if r.d]
    return project_all(read_cube(spark, cube_root, datasets), specs, zones, changes, root, source_dates)


def query_cube(cube: DataFrame, dims: list[str], filters: dict[str, str], time_from: str = "", time_to: str = "",
               limit: int = MAX_ROWS, extra: list[Column] | None = None) -> DataFrame:
    """First rows by time, then by all dimensions, plus `truncated`. Dimensions are columns of `cube`."""
    found = cube.where(codes_filter(filters) & in_window(F.col("time"), time_from, time_to))
    return bounded(found.select(*dims, "time", "value", "flag", *(extra or [])),
                   F.col("time"), *[F.col(d) for d in dims], limit=limit)
