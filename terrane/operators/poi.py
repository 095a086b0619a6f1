"""Points of interest: tag tests, placement and counts per zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import centroid, edges, on_an_edge
from ..session import BROADCAST_ROWS, cut_lineage, join_counted, salted_join
from .coverage import Grid, coverage_runs

#: Sizes of the cells that cover a zone: 1, 4 and 16 grid cells on a side.
SIZES = (0, 2, 4)
#: Where in a cell the point lies whose side is known: at no place that coordinates people write down fall on.
KNOWN_AT = (0.4142135623730951, 0.2360679774997898)
#: The index of the zones is broadcast up to about this size.
BROADCAST_BYTES = 32 << 20

# Country code by extract name, members of the union, exported shapes.
EXTRACT_COUNTRY = {
    "albania": "AL", "andorra": "AD", "austria": "AT", "belarus": "BY", "belgium": "BE",
    "bosnia-herzegovina": "BA", "bulgaria": "BG", "croatia": "HR", "cyprus": "CY",
    "czech-republic": "CZ", "denmark": "DK", "estonia": "EE", "finland": "FI", "france": "FR",
    "georgia": "GE", "germany": "DE", "greece": "EL", "hungary": "HU", "iceland": "IS",
    "ireland-and-northern-ireland": "IE", "italy": "IT", "kosovo": "XK", "latvia": "LV",
    "liechtenstein": "LI", "lithuania": "LT", "luxembourg": "LU", "macedonia": "MK", "malta": "MT",
    "moldova": "MD", "monaco": "MC", "montenegro": "ME", "netherlands": "NL", "norway": "NO",
    "poland": "PL", "portugal": "PT", "romania": "RO", "serbia": "RS", "slovakia": "SK",
    "slovenia": "SI", "spain": "ES", "sweden": "SE", "switzerland": "CH", "turkey": "TR",
    "ukraine": "UA", "united-kingdom": "UK",
}
EU27 = ("AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "EL", "ES", "FI", "FR", "HR", "HU",
        "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK")
EXPORTED_SHAPES = ("POINT", "POLYGON", "MULTIPOLYGON")
POI_QUALITY = "osm_completeness_unknown"


def extract_table(spark: SparkSession) -> DataFrame:
    """`extract, country, pos`: every extract known by name."""
    rows = [(f"europe/{name}", country, pos) for pos, (name, country) in enumerate(EXTRACT_COUNTRY.items())]
    return spark.createDataFrame(rows, "extract string, country string, pos int")


def requested_extracts(asked: DataFrame, extracts: DataFrame, countries: DataFrame) -> DataFrame:
    """`extract, problem` for a request `(place, item)`: one row per extract, in the order of first mention.

    An item with a slash is an extract itself. `eu27` stands for the extracts of the member states, `europe` for
    those of `countries` (`country`). Other items come back with the problem `unknown_extract`.
    """
    items = asked.select("place", F.trim("item").alias("item")).where("item <> ''").withColumn("group", F.lower("item"))
    members = extracts.where(F.col("country").isin(*EU27)).withColumn("group", F.lit("eu27")).unionByName(
        extracts.join(countries.select("country").distinct(), "country", "left_semi").withColumn("group", F.lit("europe")))
    plain = items.where(F.contains("item", F.lit("/"))).select("place", F.lit(0).alias("pos"), F.col("item").alias("extract"), F.lit(None).cast("string").alias("problem"))
    grouped = items.join(members, "group").select("place", "pos", "extract", F.lit(None).cast("string").alias("problem"))
    other = items.where(~F.contains("item", F.lit("/")) & ~F.col("group").isin("eu27", "europe")).select(
        "place", F.lit(0).alias("pos"), F.col("item").alias("extract"), F.lit("unknown_extract").alias("problem"))
    every = plain.unionByName(grouped).unionByName(other)
    return every.groupBy("extract", "problem").agg(F.min(F.struct("place", "pos")).alias("at")).orderBy("at", "extract").select("extract", "problem")


def extract_country(extract: Column) -> Column:
    """Country prefix of an extract path; null when unknown."""
    lookup = F.create_map(*[F.lit(v) for pair in EXTRACT_COUNTRY.items() for v in pair])
    return lookup[F.element_at(F.split(extract, "/"), -1)]


def any_tag(tags: Column, pairs: list[tuple[str, str]]) -> Column:
    """True when at least one (key, value) pair matches exactly."""
    tests = [F.coalesce(tags[k] == v, F.lit(False)) for k, v in pairs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def exportable(osm_type: Column, geom_type: Column, types: list[str]) -> Column:
    return osm_type.isin(types) & F.upper(geom_type).isin(*EXPORTED_SHAPES)


def tag_pairs(specs: DataFrame) -> DataFrame:
    """Distinct (key, value) pairs over all point specs."""
    return specs.select(F.explode("extraction.tags").alias("t")).select("t.key", "t.value").distinct()


def tag_expressions(specs: DataFrame) -> DataFrame:
    """Distinct (element type, key, value) over all point specs."""
    return specs.select(F.explode("extraction.geometry").alias("osm_type"), "extraction.tags").select(
        "osm_type", F.explode("tags").alias("t")).select("osm_type", "t.key", "t.value").distinct()


def as_points(elements: DataFrame) -> DataFrame:
    """Points stay; polygons become their centroid. Replaces `lon`, `lat`, drops `geometry`."""
    centre = centroid(F.col("geometry"))
    is_point = F.upper("geom_type") == "POINT"
    rest = [c for c in elements.columns if c not in ("lon", "lat", "geometry")]
    return elements.select(
        *rest, F.when(is_point, F.col("lon")).otherwise(centre["x"]).alias("lon"),
        F.when(is_point, F.col("lat")).otherwise(centre["y"]).alias("lat"))


def tag_index(specs: DataFrame) -> DataFrame:
    """`osm_type, key, value, indicators`: the specs that ask for a tag, listed under it."""
    wanted = specs.select(F.col("id").alias("indicator"), F.explode("extraction.geometry").alias("osm_type"), "extraction.tags")
    pairs = wanted.select("indicator", "osm_type", F.explode("tags").alias("t"))
    return pairs.groupBy("osm_type", F.col("t.key").alias("key"), F.col("t.value").alias("value")).agg(F.collect_set("indicator").alias("indicators"))


def match_specs(elements: DataFrame, specs: DataFrame, placed: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per element and spec it counts for: right type and at least one tag pair.

    An element's tags look up the specs that ask for them, so the work follows the tags of the elements and the
    hits, not the number of specs. An element, known by `extract`, `osm_type` and `osm_id`, counts once for a spec whatever
    number of its tags match. With `placed`, the rows come back as points without tags, which leaves little to be sorted out.
    The tags that specs ask for are counted: a planner takes them for few however many there are. Beyond `limit` no task holds them all.
    """
    tag = F.explode(F.map_entries("tags")).alias("_tag")
    met = elements.select("*", tag).withColumns({"_key": F.col("_tag.key"), "_value": F.col("_tag.value")}).drop("_tag")
    index = cut_lineage(tag_index(specs).select("osm_type", F.col("key").alias("_key"), F.col("value").alias("_value"), "indicators"))
    index = F.broadcast(index) if index.limit(limit + 1).count() <= limit else index.hint("merge")
    hits = met.join(index, ["osm_type", "_key", "_value"]).drop("_key", "_value")
    hits = hits.select(*elements.columns, F.explode("indicators").alias("indicator"))
    if placed:
        hits = as_points(hits.drop("tags"))
    return hits.dropDuplicates(["extract", "osm_type", "osm_id", "indicator"])


def entered_cells(zones: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """`keys, i, j, x1 .. y2, crosses, at`: the cells that each edge meets, if only at a point of their left or lower side.

    `crosses` tells whether the edge leads through the line of a row's known points, at column position `at`.
    """
    e = F.col("e")
    ends = zones.select(*keys, F.explode(edges(F.col("geometry"))).alias("e")).select(
        *keys, "e.x1", "e.y1", "e.x2", "e.y2", grid.u(e["x1"]).alias("u1"), grid.v(e["y1"]).alias("v1"),
        grid.u(e["x2"]).alias("u2"), grid.v(e["y2"]).alias("v2")).where("x1 <> x2 or y1 <> y2")
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    rows = ends.select("*", F.explode(F.sequence(F.floor(low), F.floor(high))).alias("j"))
    bottom, top = F.greatest(low, F.col("j").cast("double")), F.least(high, (F.col("j") + 1).cast("double"))
    flat = F.col("v1") == F.col("v2")
    cut = rows.select("*", F.when(flat, F.col("u1")).otherwise(_along(bottom)).alias("ua"), F.when(flat, F.col("u2")).otherwise(_along(top)).alias("ub"))
    columns = F.explode(F.sequence(F.floor(F.least("ua", "ub")).cast("int"), F.floor(F.greatest("ua", "ub")).cast("int")))
    line = F.col("j") + KNOWN_AT[1]
    return cut.select(*keys, columns.alias("i"), F.col("j").cast("int").alias("j"), "x1", "y1", "x2", "y2",
                      ((low <= line) & (high > line)).alias("crosses"), _along(line).alias("at"))


def _along(v: Column, u1: Column | None = None, v1: Column | None = None, u2: Column | None = None, v2: Column | None = None) -> Column:
    """Column position of an edge at height `v`, its ends exactly; the other way round with u and v exchanged."""
    u1, v1, u2, v2 = (F.col(n) if c is None else c for n, c in (("u1", u1), ("v1", v1), ("u2", u2), ("v2", v2)))
    return F.when(v == v1, u1).when(v == v2, u2).otherwise(u1 + (v - v1) * ((u2 - u1) / F.nullif(v2 - v1, F.lit(0.0))))


def zone_index(zones: DataFrame, grid: Grid, keys: list[str], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Cells of several sizes met by each zone: `keys, size, i, j, known, cell_edges`.

    A cell of size s has 2^s grid cells on a side. The inside of a zone is covered by the largest cells that lie in
    it, whose `cell_edges` is null. Cells that an edge meets are of the least size and carry the edges that meet them,
    and whether their known point is inside (`known`). So the index follows the length of the boundary, and what a cell
    carries is its own.
    """
    nothing = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    met = entered_cells(zones, grid.coarser(min(sizes)), keys)
    own = met.groupBy(*keys, "i", "j").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("cell_edges"))
    # an edge meets several cells of a row, but crosses its line once: for all columns whose known point is left of that
    crossings = met.where("crosses").select(*keys, "j", "x1", "y1", "x2", "y2", (F.ceil(F.col("at") - KNOWN_AT[0]) - 1).cast("int").alias("i")).distinct()
    marks = own.select(*keys, "i", "j", "cell_edges", F.lit(0).alias("n")).unionByName(
        crossings.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).cast("int").alias("n")).select(*keys, "i", "j", nothing.alias("cell_edges"), "n"))
    # one partition per zone and row: as many rows as cells that an edge meets or crosses
    onward = Window.partitionBy(*keys, "j").orderBy(F.col("i").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    index = marks.withColumn("known", F.sum("n").over(onward) % 2 == 1).where("cell_edges is not null").select(
        *keys, F.lit(min(sizes)).alias("size"), "i", "j", "known", "cell_edges")
    around = larger = None
    for size in sorted(sizes, reverse=True):
        coarse = grid.coarser(size)
        edged = (met if size == min(sizes) else entered_cells(zones, coarse, keys)).select(*keys, "i", "j").distinct()
        whole = coverage_runs(zones, coarse, keys).where(~F.col("touched") & (F.col("fraction") > 0))
        if around is None:
            inside = whole.select(*keys, F.explode(F.sequence("i_from", "i_to")).alias("i"), "j")
        else:  # only within the larger cells that an edge meets
            step = 1 << (larger - size)
            part = lambda c, n=step: F.explode(F.sequence(F.col(c) * n, F.col(c) * n + n - 1))
            inside = around.withColumn("i", part("i")).withColumn("j", part("j")).join(whole, [*keys, "j"]).where(
                F.col("i").between(F.col("i_from"), F.col("i_to"))).select(*keys, "i", "j")
        inside = inside.join(edged, [*keys, "i", "j"], "left_anti")
        index = index.unionByName(inside.select(*keys, F.lit(size).alias("size"), "i", "j", F.lit(True).alias("known"), nothing.alias("cell_edges")))
        around, larger = edged, size
    return index


def inside_cell(grid: Grid) -> Column:
    """Whether the point (`lon`, `lat`) in the cell (`i`, `j`) is strictly inside, from the cell's known point and its own edges.

    The way from the known point goes up or down and then across to the point, all within the cell; each edge that it crosses
    changes sides.
    """
    u, v = grid.u(F.col("lon")), grid.v(F.col("lat"))
    u0, v0 = F.col("i") + KNOWN_AT[0], F.col("j") + KNOWN_AT[1]

    def crossed(e: Column) -> Column:
        u1, v1, u2, v2 = grid.u(e["x1"]), grid.v(e["y1"]), grid.u(e["x2"]), grid.v(e["y2"])
        at, height = _along(v, u1, v1, u2, v2), _along(u0, v1, u1, v2, u2)
        across = ((v1 > v) != (v2 > v)) & ((at > u0) != (at > u))
        along = ((u1 > u0) != (u2 > u0)) & ((height > v0) != (height > v))
        return F.coalesce(across, F.lit(False)) != F.coalesce(along, F.lit(False))

    odd = F.size(F.filter("cell_edges", crossed)) % 2 == 1
    return F.col("cell_edges").isNull() | ((F.col("known") != odd) & ~on_an_edge(F.col("lon"), F.col("lat"), F.col("cell_edges")))


def points_in_zones(points: DataFrame, zones: DataFrame, grid: Grid, same_country: bool = True, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Points strictly inside zones: the point's columns plus `geo_code, level`.

    Equi-join on cells of a few sizes (and country), exact test only where an edge enters a cell. The index of the zones is
    written once; measured in bytes, it is broadcast while small and else repeated per salt, so that one crowded cell
    does not end in one task.
    """
    keys = ["geo_code", "level", "zone_country"]
    shaped = zones.select("geo_code", "level", F.left("geo_code", F.lit(2)).alias("zone_country"), "geometry")
    index = cut_lineage(zone_index(shaped, grid, keys, sizes))
    cells = F.array(*[F.struct(F.lit(s).alias("size"), F.shiftright(grid.column(F.col("lon")), s).alias("i"), F.shiftright(grid.row(F.col("lat")), s).alias("j"))
                      for s in sizes])
    placed = points.select("*", F.explode(cells).alias("_cell")).select(*points.columns, "_cell.*")
    on = ["size", "i", "j"]
    if same_country:
        index, on = index.withColumnRenamed("zone_country", "country"), ["country", *on]
    else:
        index = index.drop("zone_country")
    held = index.agg(F.sum(F.lit(100) + 32 * F.coalesce(F.size("cell_edges"), F.lit(0)))).first()[0] or 0
    hits = placed.join(F.broadcast(index), on) if held <= BROADCAST_BYTES else salted_join(placed, index, on)
    return hits.where(inside_cell(grid)).drop("cell_edges", "known", "size", "i", "j")


def count_in_zones(matched: DataFrame, zones: DataFrame, specs: DataFrame, grid: Grid,
                   covered: DataFrame) -> DataFrame:
    """Count per indicator and zone over all extracts, 0 for empty zones of covered countries.

    `matched` holds `indicator, country, lon, lat`; `covered` lists `country`.
    """
    levels = specs.select(F.col("id").alias("indicator"), F.explode("geo_levels").alias("level"))
    counts = (
        points_in_zones(matched.select("indicator", "country", "lon", "lat"), zones, grid)
        .groupBy("indicator", "level", "geo_code").agg(F.count(F.lit(1)).alias("n"))
    )
    in_scope = zones.select("geo_code", "level", F.left("geo_code", F.lit(2)).alias("country")).join(
        covered.select("country").distinct(), "country", "left_semi")
    scope = join_counted(in_scope, levels, ["level"]).select("indicator", "level", "geo_code")
    return scope.join(counts, ["indicator", "level", "geo_code"], "left").select(
        "indicator", "level", "geo_code", F.coalesce("n", F.lit(0)).cast("double").alias("value"),
        F.lit(POI_QUALITY).alias("quality"))
