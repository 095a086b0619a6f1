"""Session settings, shared storage and join helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of known row count may be hinted as broadcast up to this many rows.
BROADCAST_ROWS = 20_000

_HASHABLE = {"string", "byte", "short", "integer", "long", "float", "double", "decimal", "date",
             "timestamp", "timestamp_ntz", "boolean"}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "terrane", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the engine's settings; `extra` wins over them."""
    # Python workers import the package from where the driver has it; on a cluster the folder must be there too, or
    # the package be shipped with --py-files.
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.pathsep.join(dict.fromkeys([home, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = SparkSession.builder.appName(app).config("spark.executorEnv.PYTHONPATH", paths)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the folders that `shared_dir` handed out; tables read from them are gone. Runs when the driver ends."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(hadoop).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        release(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    The folder comes from `spark.checkpoint.dir`. Only a local session that has
    none gets a temporary one, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not _made:
        atexit.register(_release_at_exit, spark)
    _made.append(f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the caller knows that `df` has at most `rows` rows.

    Beyond `limit` the frame comes back untouched and the planner shuffles.
    Everywhere else the choice is left to the planner, which broadcasts by
    measured size (table statistics, then AQE).
    """
    return F.broadcast(df) if rows <= limit else df


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join with a table that is configuration: counted, then broadcast, or salted beyond the bound.

    Needed where the planner cannot know the size, as for rows made in Python,
    and where `big` is concentrated on few keys.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how=how)


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than cores before heavy work per row.

    A large table has more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 8,
                how: str = "inner") -> DataFrame:
    """Equi-join that spreads each hot key of `big` over `salts` partitions.

    `small` is repeated once per salt, so it should be the narrow side. Any
    join type that keeps unmatched rows of `big` only is safe.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted join cannot do {how}")
    content = [f.name for f in big.schema if f.dataType.typeName() in _HASHABLE]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
