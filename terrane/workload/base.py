"""Registry of queries and the SQL views they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per path, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(name: str, *needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql.strip())


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def with_views(*names: str, body: str) -> str:
    """`body` behind the WITH clause of the named views and what they need."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _ordered(names, [])]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(*views, body=sql)
        return fn

    return register


def similar_sql(words: str, terms: str, cutoff: tuple[int, int]) -> str:
    """`word, term, ratio` of the upper-case texts `x` that two queries give: common character pairs, counted one by one."""
    up, down = cutoff

    def pairs(source: str) -> str:
        return f"""(SELECT x, length(x) + 1 AS s, g, count(*) AS n FROM (SELECT x, unnest(list_transform(range(1, length(x) + 2),
                   lambda i: substr(chr(2) || x || chr(3), i, 2))) AS g FROM (SELECT DISTINCT upper(x) AS x FROM ({source})) WHERE x <> '') GROUP BY ALL)"""

    return f"""SELECT l.x AS word, r.x AS term, 2.0::DOUBLE * sum(least(l.n, r.n)) / (l.s + r.s) AS ratio
               FROM {pairs(words)} l JOIN {pairs(terms)} r ON l.g = r.g GROUP BY l.x, r.x, l.s, r.s HAVING 2 * {down} * sum(least(l.n, r.n)) >= {up} * (l.s + r.s)"""
