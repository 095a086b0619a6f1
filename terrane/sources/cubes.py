"""Native statistical cubes: wide text files in, long Parquet at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CUBE
from ..session import broadcast_up_to
from .canonical import drop_partition

TAB = "\t"


def _is_header() -> Column:
    return _first_cell().contains("\\")


def _first_cell() -> Column:
    return F.split_part(F.col("line"), F.lit(TAB), F.lit(1))


def _series(lines: DataFrame, files: int) -> DataFrame:
    """`dataset, file, dim_names, periods, codes, cells` of each series line with the header of its file."""
    first = _first_cell()
    parts = F.split("line", TAB)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda t: F.trim(t))
    headers = lines.where(_is_header()).select(
        "file", F.transform(F.split(F.split_part(first, F.lit("\\"), F.lit(1)), ","), lambda t: F.trim(t)).alias("dim_names"),
        rest.alias("periods")).dropDuplicates(["file"])
    series = lines.where(~_is_header() & (F.col("line") != ""))
    codes = F.transform(F.split(first, ","), lambda t: F.trim(t))
    return series.join(broadcast_up_to(headers, files), "file").select("dataset", "file", "dim_names", "periods", codes.alias("codes"), rest.alias("cells"))


def parse_wide_lines(lines: DataFrame, files: int) -> DataFrame:
    """Long rows from the lines `(file, dataset, line)` of wide cube files.

    The header of a file is the line whose first cell ends in `\\TIME_PERIOD`.
    Each other line is one series: codes joined by commas, then one cell per
    period. `"12.5 p"` carries a flag; `":"`, empty and unreadable cells hold
    no value and disappear (`wide_problems` lists what can't be read). There is
    one header per file, and `files` of them at most: while few they are
    broadcast, so that the series never move.
    """
    joined = _series(lines, files)
    width = F.least(F.size("dim_names"), F.size("codes"))
    long = joined.select(
        "dataset",
        F.map_from_arrays(F.slice("dim_names", 1, width), F.slice("codes", 1, width)).alias("dims"),
        F.explode(F.filter(F.arrays_zip(F.col("periods"), F.col("cells").alias("cell")),
                           lambda c: F.coalesce(c["cell"], F.lit("")) != "")).alias("c"),
    )
    number = F.split_part(F.col("c.cell"), F.lit(" "), F.lit(1))
    return long.select(
        "dataset", "dims", F.col("c.periods").alias("time"), _number(number).alias("value"),
        _flag(F.col("c.cell")).alias("flag"),
    ).where(F.col("value").isNotNull() & F.col("time").isNotNull())


def wide_problems(lines: DataFrame, landed: DataFrame, files: int) -> DataFrame:
    """`dataset, file, reason, series, cell`: what of wide files can't be read.

    Of a file: `no_header` (nor does an empty file have one), `headers` (several). Of a series: `codes` (not as many as the header has
    dimensions), `cells` (more than periods). Of a cell: `number` (neither empty nor `:`, and no number at its
    beginning). `landed` lists `dataset, file`.
    """
    found = lines.where(_is_header()).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    headed = landed.select("dataset", "file").join(found, "file", "left")
    whole = headed.where("n is null or n > 1").select("dataset", "file", F.when(F.col("n").isNull(), "no_header").otherwise("headers").alias("reason"),
                                                      none.alias("series"), none.alias("cell"))
    number = lambda c: _number(F.split_part(c, F.lit(" "), F.lit(1)))
    odd = F.filter("cells", lambda c: (c != "") & ~c.startswith(":") & number(c).isNull())
    found = F.concat(
        F.when(F.size("codes") != F.size("dim_names"), F.array(F.struct(F.lit("codes").alias("reason"), none.alias("cell")))).otherwise(F.array()),
        F.when(F.size("cells") > F.size("periods"), F.array(F.struct(F.lit("cells").alias("reason"), none.alias("cell")))).otherwise(F.array()),
        F.transform(odd, lambda c: F.struct(F.lit("number").alias("reason"), c.alias("cell"))))
    parts = _series(lines, files).select("dataset", "file", F.array_join("codes", ",").alias("series"), F.explode(found).alias("p"))
    return whole.unionByName(parts.select("dataset", "file", "p.reason", "series", "p.cell"))


def _number(text: Column) -> Column:
    """Double of plain decimal text; a trailing `d` or `f`, legal in Java, is not a number here."""
    return F.when(~text.rlike("[dDfF]$") | text.rlike(r"(?i)^[+-]?inf$"), text.try_cast("double"))


def _flag(cell: Column) -> Column:
    return F.trim(F.when(F.instr(cell, " ") > 0, F.substr(cell, F.instr(cell, " ") + 1)).otherwise(""))


def file_dataset(file: Column) -> Column:
    """Dataset of a wide file: its `dataset=` folder if there is one, else its name before the first dot."""
    folder = F.regexp_extract(file, r"dataset=([^/]+)/", 1)
    name = F.split_part(F.element_at(F.split(file, "/"), -1), F.lit("."), F.lit(1))
    return F.when(folder != "", folder).otherwise(name)


def wide_lines(spark: SparkSession, path: str, datasets: list[str] | None = None) -> tuple[DataFrame, int]:
    """Lines `(file, dataset, line)` of all wide files under `path`, or of those of the named datasets, and a bound of the number of files.

    The dataset follows from the path of a file, so files of other datasets are left out before they are opened.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    if datasets is not None:
        text = text.where(file_dataset(file).isin(datasets))
    return text.select(file.alias("file"), file_dataset(file).alias("dataset"), F.col("value").alias("line")), len(text.inputFiles())


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """`dataset, file` of all wide files under `path`, from their listing; files without a byte aren't listed."""
    listed = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path")
    return listed.select(file_dataset(F.col("path")).alias("dataset"), F.col("path").alias("file"))


def read_wide_cubes(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    """Long rows of all wide files under `path`, or of those of the named datasets."""
    return parse_wide_lines(*wide_lines(spark, path, datasets))


def to_wide(cube: DataFrame, dims: list[str], periods: list[str]) -> DataFrame:
    """One row per series, one text cell per period, as in a wide file."""
    cell = F.concat_ws(" ", F.col("value").cast("string"), F.nullif(F.trim("flag"), F.lit("")))
    wide = cube.groupBy(*dims).pivot("time", periods).agg(F.max(cell))
    key = F.concat_ws(",", *[F.col(d) for d in dims]).alias(",".join(dims) + "\\TIME_PERIOD")
    return wide.select(key, *[F.coalesce(F.col(f"`{p}`"), F.lit(":")).alias(p) for p in periods])


def write_wide(wide: DataFrame, path: str) -> None:
    """Tab-separated files, each with its own header line."""
    wide.write.mode("overwrite").option("sep", TAB).option("header", True).option("quote", "").option(
        "escape", "").csv(path)


def write_cube(cube: DataFrame, root: str, datasets: list[str] | None = None) -> None:
    """Replace the datasets present in `cube`; a large dataset is spread over tasks.

    With `datasets`, the whole list of those replaced, the ones without rows in `cube` are dropped.
    """
    (
        cube.select(*CUBE.names)
        .hint("rebalance", "dataset")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("dataset")
        .parquet(root)
    )
    if datasets:
        full = {r[0] for r in cube.select("dataset").distinct().collect()}
        for name in sorted(set(datasets) - full):
            drop_partition(cube.sparkSession, root, "dataset", name)


def read_cube(spark: SparkSession, root: str, datasets: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(CUBE).parquet(root).select(*CUBE.names)
    return df if datasets is None else df.where(F.col("dataset").isin(datasets))


def spread_dims(cube: DataFrame, dims: list[str]) -> DataFrame:
    """One column per named dimension instead of the map."""
    return cube.select("dataset", *[F.col("dims")[d].alias(d) for d in dims], "time", "value", "flag")
