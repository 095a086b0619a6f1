"""Cross-indicator queries on the canonical table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import in_window, period_order
from ..operators.pivot import last_periods, spread_snapshots, zone_then_recent
from ..operators.reports import (
    bounded, indicator_profile, missing_in_window, provenance, provenance_by_source, snapshot_summary,
)
from ..operators.validate import validate_requests
from ..schemas import LAST_PERIODS, MAX_INDICATORS, MAX_ROWS, MAX_ZONES


@dataclass
class Answer:
    """Lazy frames of one cross-indicator query."""

    table: DataFrame
    provenance: DataFrame
    by_source: DataFrame
    missing: DataFrame
    snapshots: DataFrame
    errors: DataFrame | None = None

    def head(self, limit: int = MAX_ROWS) -> DataFrame:
        return bounded(self.table, F.col("geo_code"), period_order(F.col("time")).desc(), limit=limit)


def query_indicators(canonical: DataFrame, indicators: list[str], zones: list[str] | None = None,
                     time_from: str = "", time_to: str = "", last_n: int = LAST_PERIODS,
                     snapshots: list[str] | None = None) -> Answer:
    """One row per zone and period, one text column per indicator in request order.

    Without time bounds only the last `last_n` periods found are kept.
    `snapshots` names the requested indicators that describe the current state:
    they ignore the window and repeat on every period row of their zone.
    """
    held = [i for i in indicators if i in set(snapshots or [])]
    periodic = [i for i in indicators if i not in held]
    base = canonical.where(F.col("indicator").isin(indicators))
    if zones:
        base = base.where(F.col("geo_code").isin(zones))
    rows = base.where(F.col("indicator").isin(periodic) & in_window(F.col("time"), time_from, time_to))
    if not time_from and not time_to and last_n > 0:
        rows = last_periods(rows, last_n)
    snaps = base.where(F.col("indicator").isin(held))
    table = zone_then_recent(spread_snapshots(rows, snaps, indicators))
    used = rows.unionByName(snaps)
    origin = provenance(used)
    asked = canonical.sparkSession.createDataFrame([(i,) for i in indicators], "indicator string")
    profile = indicator_profile(canonical.where(F.col("indicator").isin(indicators)))
    return Answer(table, origin, provenance_by_source(origin), missing_in_window(asked, used, profile),
                  snapshot_summary(snaps, rows))


ERRORS = "indicator string, zone string, error_code string, hint string"


def request_indicators(canonical: DataFrame, specs: DataFrame, zones: DataFrame, indicators: list[str], zone_codes: list[str],
                       time_from: str = "", time_to: str = "", last_n: int = LAST_PERIODS) -> Answer:
    """A checked request: `errors` tells what is wrong with it, row by row, and the table is empty unless nothing is.

    Ids and codes are trimmed, blank ones dropped, codes taken in upper case. Which indicators are snapshots follows
    from their specs. Error codes are those of `validate_requests`, and `no_indicators` and `no_zones`.
    """
    spark = canonical.sparkSession
    asked = list(dict.fromkeys(i.strip() for i in indicators if i.strip()))
    codes = list(dict.fromkeys(z.strip().upper() for z in zone_codes if z.strip()))
    held = [r.id for r in specs.where(F.col("id").isin(asked) & (F.col("frequency") == "SNAPSHOT")).select("id").distinct().collect()]
    wrong = [(not asked, "no_indicators"), (not codes, "no_zones"), (len(asked) > MAX_INDICATORS, "too_many_indicators"), (len(codes) > MAX_ZONES, "too_many_zones")]
    code = next((c for test, c in wrong if test), None)
    if code:
        nothing = canonical.where(F.lit(False))
        origin = provenance(nothing)
        return Answer(nothing.select("geo_code", "time", *[F.lit("").alias(i) for i in asked]), origin, provenance_by_source(origin),
                      nothing.select("indicator", F.col("time").alias("time_min"), F.col("time").alias("time_max")), snapshot_summary(nothing, nothing),
                      spark.createDataFrame([(None, None, code, None)], ERRORS))
    pairs = spark.createDataFrame([("", i, z) for i in asked for z in codes], "request_id string, indicator string, zone string")
    checked = validate_requests(pairs, specs, zones, canonical.where(F.col("indicator").isin(asked)))
    errors = checked.where("error_code is not null").select("indicator", "zone", "error_code", "hint")
    answer = query_indicators(canonical, asked, codes, time_from, time_to, last_n, held)
    answer.table = answer.table.where(errors.agg(F.count(F.lit(1))).scalar() == 0)
    answer.errors = errors
    return answer
