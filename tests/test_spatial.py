"""Points, polygons, coverage and zonal statistics."""

import math
import random

import pytest
from conftest import PHARMACIES
from pyspark.sql import functions as F

from terrane.functions.geometry import bbox, bbox_intersects, box_geometry, centroid, polygon_area, wrap_longitude
from terrane.functions.rasters import feed_of, pick_variable, sampled_steps, unit_offset
from terrane.operators.coverage import Grid, grid_coverage
from terrane.operators.incremental import freshness_delta, merge_years, run_report, year_delta
from terrane.operators.poi import extract_table, match_specs, points_in_zones, requested_extracts, tag_expressions, tag_pairs, zone_index
from terrane.operators.zonal import covered_cells, crop, weighted_median, zonal_statistics
from terrane.plans.spatial import count_poi, write_zonal, zonal_indicator
from terrane.schemas import GEOMETRY, POI
from terrane.session import shared_dir
from terrane.sources.canonical import read_canonical


def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n), (w, s)]]


def shapes(spark, rows):
    """rows: (code, level, [polygon, ..]) with polygons as lists of rings."""
    schema = "geo_code string, level string, geometry " + GEOMETRY.simpleString()
    return spark.createDataFrame([(c, lv, [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in polygons]) for c, lv, polygons in rows], schema)


# Own made-up areas: one in two parts, one alone in its country, one in a country that no extract covers.
AREAS = [("IS011", "NUTS3", [box(-22, 64, -21, 65)]), ("IS022", "NUTS3", [box(-19, 65, -17, 66), box(-16.5, 65, -16, 65.5)]),
         ("MT001", "NUTS3", [box(14.1, 35.8, 14.6, 36)]), ("HR041", "NUTS3", [box(15.5, 45.5, 16.5, 46)])]
WORLD = Grid(-180, -90, 0.25, 0.25)


def element(id, amenity, at, country, kind="node"):
    if kind == "node":
        return (country, country, kind, id, {"amenity": amenity}, "POINT", *map(float, at), None)
    ring = [(float(x), float(y)) for x, y in box(*at)[0]]
    return (country, country, kind, id, {"amenity": amenity}, "POLYGON", None, None, [[ring]])


def counts(spark, make_specs, elements, spec=PHARMACIES, countries=("IS", "MT")):
    extracts = spark.createDataFrame([(c, c, f"2026-0{k + 7}") for k, c in enumerate(countries)], "extract string, country string, month string")
    out = count_poi(spark.createDataFrame(elements, POI), extracts, shapes(spark, AREAS), make_specs(spec), WORLD).collect()
    assert {(r.time, r.quality) for r in out} == {("2026-08", "osm_completeness_unknown")}
    return {r.geo_code: r.value for r in out}


def test_every_covered_zone_has_a_count(spark, make_specs):
    got = counts(spark, make_specs, [element(1, "pharmacy", (-21.4, 64.3), "IS"), element(2, "pharmacy", (-21.7, 64.9), "IS"), element(3, "pharmacy", (-16.2, 65.1), "IS")])
    assert got == {"IS011": 2, "IS022": 1, "MT001": 0}


def test_polygon_counts_by_its_centre(spark, make_specs):
    # most of this area lies outside every zone, its centre lies inside
    assert counts(spark, make_specs, [element(7, "pharmacy", (-19.4, 65.4, -18.2, 67.0), "IS", "way"), element(8, "pharmacy", (-21.9, 63.0, -21.1, 64.8), "IS", "way")])["IS022"] == 0
    assert counts(spark, make_specs, [element(7, "pharmacy", (-19.4, 65.4, -18.2, 66.4), "IS", "way")])["IS022"] == 1


def test_points_elsewhere_or_on_a_border_do_not_count(spark, make_specs):
    places = [((100, -10), "IS"), ((14.3, 35.9), "IS"), ((-21.5, 64.5), "MT"), ((-22, 64.5), "IS"), ((-21.5, 65), "IS"), ((-21, 64), "IS")]
    got = counts(spark, make_specs, [element(n, "pharmacy", at, country) for n, (at, country) in enumerate(places)])
    assert got == {"IS011": 0, "IS022": 0, "MT001": 0}


def test_any_tag_counts_once_and_types_are_honoured(spark, make_specs):
    spec = PHARMACIES | {"tags": [("amenity", "pharmacy"), ("amenity", "doctors"), ("healthcare", "yes")], "geometry": ["node"]}
    both = list(element(1, "doctors", (14.2, 35.9), "MT"))
    both[4] = {"amenity": "doctors", "healthcare": "yes"}
    got = counts(spark, make_specs, [tuple(both), element(2, "pharmacy", (14.5, 35.95), "MT"), element(3, "cafe", (14.4, 35.9), "MT"),
                                     element(4, "pharmacy", (14.2, 35.85, 14.3, 35.95), "MT", "way")], spec)
    assert got["MT001"] == 2


def test_expressions(make_specs):
    assert {(r.osm_type, r.key, r.value) for r in tag_expressions(make_specs(PHARMACIES)).collect()} == {
        (t, "amenity", "pharmacy") for t in ("node", "way", "relation")}
    assert tag_pairs(make_specs(PHARMACIES)).count() == 1


def test_requested_extracts(spark):
    def asked(*items, countries=()):
        rows = spark.createDataFrame(list(enumerate(items)), "place int, item string")
        known = spark.createDataFrame([(c,) for c in countries], "country string")
        return [(r.extract, r.problem) for r in requested_extracts(rows, extract_table(spark), known).collect()]

    union = asked("asia/japan", " EU27 ", "europe/switzerland", "europe/belgium", "")
    assert union[0] == ("asia/japan", None) and union[-1] == ("europe/switzerland", None)
    assert len(union) == 29 and ("europe/norway", None) not in union
    assert asked("Europe", countries=["NO", "MT"]) == [("europe/malta", None), ("europe/norway", None)]
    assert asked("atlantis", "europe") == [("atlantis", "unknown_extract")]


def star(seed, cx, cy, points=9):
    rnd = random.Random(seed)
    return [(cx + math.cos(a) * r, cy + math.sin(a) * r) for a, r in
            ((2 * math.pi * k / points, rnd.uniform(0.4, 2.3)) for k in range(points))]


def clip(ring, keep, cut):
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if keep(a):
            out.append(a)
        if keep(a) != keep(b):
            out.append(cut(a, b))
    return out


def area_in_cell(ring, x0, y0, x1, y1):
    """Clip a ring to a box and take its area: slow, independent reference."""
    def at_x(v):
        return lambda a, b: (v, a[1] + (v - a[0]) * (b[1] - a[1]) / (b[0] - a[0]))

    def at_y(v):
        return lambda a, b: (a[0] + (v - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), v)

    for keep, cut in ((lambda p: p[0] >= x0, at_x(x0)), (lambda p: p[0] <= x1, at_x(x1)), (lambda p: p[1] >= y0, at_y(y0)), (lambda p: p[1] <= y1, at_y(y1))):
        ring = clip(ring, keep, cut)
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_coverage_equals_clipping(spark):
    grid = Grid(-4, -4, 0.5, 0.4)
    zones = {f"Z{k}": star(k, 0.1 * k, -0.07 * k) for k in range(6)}
    rows = [(c, "NUTS1", [[ring if k % 2 else ring[::-1]]]) for k, (c, ring) in enumerate(zones.items())]
    hole = [(1.5, 1.5), (2.5, 1.5), (2.5, 2.75), (1.5, 2.75)]
    rows.append(("H", "NUTS1", [[[(1, 1), (3, 1), (3, 3), (1, 3)], hole], [[(-3, -3), (-2.9, -3), (-2.9, -2.95)]]]))
    got = {(r.geo_code, r.i, r.j): r.fraction for r in grid_coverage(shapes(spark, rows), grid).collect()}
    for code, ring in zones.items():
        for i in range(20):
            for j in range(24):
                x0, y0 = -4 + i * 0.5, -4 + j * 0.4
                assert got.get((code, i, j), 0.0) == pytest.approx(area_in_cell(ring, x0, y0, x0 + 0.5, y0 + 0.4) / 0.2, abs=1e-9)
    assert sum(f for (c, *_), f in got.items() if c == "H") * 0.2 == pytest.approx(4 - 1.25 + 0.0025, abs=1e-9)


def test_points_in_stars_equal_ray_test(spark):
    rnd = random.Random(5)
    zones = {f"ZZ{k}": star(k, 0.5 * k, 0) for k in range(5)}
    points = [(n, rnd.uniform(-3, 5), rnd.uniform(-3, 3)) for n in range(600)]

    def inside(ring, x, y):
        hits = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            hits += ((y1 > y) != (y2 > y)) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return hits % 2 == 1

    want = {(n, c) for n, x, y in points for c, ring in zones.items() if inside(ring, x, y)}
    frame = spark.createDataFrame(points, "n int, lon double, lat double")
    zone_rows = shapes(spark, [(c, "NUTS1", [[ring]]) for c, ring in zones.items()])
    got = points_in_zones(frame, zone_rows, Grid(-10, -10, 0.3, 0.3), same_country=False)
    assert {(r.n, r.geo_code) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_points_beyond_the_broadcast_bound(spark, monkeypatch):
    from terrane.operators import poi

    monkeypatch.setattr(poi, "BROADCAST_BYTES", -1)
    frame = spark.createDataFrame([(1, -21.5, 64.5, "IS"), (2, -21.5, 64.5, "MT")], "n int, lon double, lat double, country string")
    assert [(r.n, r.geo_code) for r in points_in_zones(frame, shapes(spark, AREAS), WORLD).collect()] == [(1, "IS011")]


def test_index_follows_the_boundary(spark):
    """Four times the side: about four times the cells, not sixteen; a ring of many edges leaves few in each cell."""
    def cells(side):
        index = zone_index(shapes(spark, [("BIG", "NUTS1", [box(0.1, 0.1, side + 0.3, side + 0.2)])]), Grid(0, 0, 0.25, 0.25), ["geo_code"])
        return index.count()

    assert cells(40) < 6 * cells(10)
    ring = [(math.cos(a) * r, math.sin(a) * r) for a, r in ((2 * math.pi * k / 4000, 2 + 0.02 * (k % 7)) for k in range(4000))]
    index = zone_index(shapes(spark, [("S", "NUTS1", [[ring]])]), Grid(-10, -10, 0.1, 0.1), ["geo_code"])
    edges = index.select(F.size("cell_edges").alias("n")).where("n > 0").agg(F.sum("n"), F.max("n")).first()
    assert edges[0] < 3 * 4000 and index.where("cell_edges is null").count() > 0


@pytest.mark.parametrize("step", [1.0, 0.5, 0.3])
def test_points_on_grid_lines_and_vertices(spark, step):
    """Shapes and points on the lines of the grid: holes, notches, slopes through corners, points on borders."""
    scale = 0.3 if step == 0.3 else 1.0
    whole = [("A", [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4)]]), ("B", [[(0, 0), (6, 6), (0, 6)]]), ("C", [[(0, 0), (6, 0), (3, 3), (6, 6), (0, 6), (3, 3.5)]]),
             ("D", [[(1, 1), (5, 3), (1, 5), (3, 3)]])]

    def near_edge(x, y):
        return any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and x1 != x2 and y1 != y2
                   for _, rings in whole for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))

    polygons = [(c, [[(x * scale, y * scale) for x, y in ring] for ring in rings]) for c, rings in whole]
    # what rounding makes of a point on a slope is a matter of luck, so with steps that no float holds there are none
    points = [(n, x * scale * 0.5, y * scale * 0.5) for n, (x, y) in enumerate((x, y) for x in range(-1, 14) for y in range(-1, 14))
              if scale == 1.0 or not near_edge(x / 2, y / 2)]

    def inside(rings, x, y):
        hits = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return False
                hits += ((y1 > y) != (y2 > y)) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return hits % 2 == 1

    frame = spark.createDataFrame([(n, float(x), float(y)) for n, x, y in points], "n int, lon double, lat double")
    got = points_in_zones(frame, shapes(spark, [(c, "NUTS1", [rings]) for c, rings in polygons]), Grid(-6, -6, step, step), same_country=False)
    want = {(n, c) for n, x, y in points for c, rings in polygons if inside(rings, x, y)}
    assert {(r.n, r.geo_code) for r in got.collect()} == want and len(want) > 100


def test_tags_are_looked_up(spark, make_specs):
    """An element with several tags of a spec counts once; the plan has no list of pairs to go through."""
    spec = PHARMACIES | {"tags": [("amenity", "pharmacy"), ("healthcare", "yes")], "geometry": ["node"]}
    both = list(element(1, "pharmacy", (14.5, 35.95), "MT"))
    both[4] = {"amenity": "pharmacy", "healthcare": "yes", "name": "x"}
    matched = match_specs(spark.createDataFrame([tuple(both), element(2, "cafe", (14.4, 35.9), "MT"), element(3, "pharmacy", (14.2, 35.9, 14.3, 36), "MT", "way")], POI),
                          make_specs(spec, PHARMACIES | {"id": "every"}))
    assert sorted((r.indicator, r.osm_id) for r in matched.collect()) == [("every", 1), ("every", 3), ("pharmacies", 1)]
    assert "exists(" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_polygon_measures(spark):
    rows = shapes(spark, [("P", "X", [box(0, 0, 2, 2)]), ("H", "X", [[box(0, 0, 2, 2)[0], box(0.5, 0.5, 1.5, 1.5)[0]]]), ("O", "X", [[[(0, 0), (2, 0), (2, 2), (0, 2)]]])])
    got = {r.geo_code: (r.a, r.c.x, r.c.y) for r in rows.select("geo_code", polygon_area(F.col("geometry")).alias("a"), centroid(F.col("geometry")).alias("c")).collect()}
    assert got == {"P": (4, 1, 1), "H": (3, 1, 1), "O": (4, 1, 1)}
    assert tuple(spark.range(1).select(bbox(box_geometry(F.lit(0), F.lit(0), F.lit(5), F.lit(4))).alias("b")).first().b) == (0, 0, 5, 4)
    far = bbox_intersects(bbox(box_geometry(F.lit(-61.8), F.lit(15.8), F.lit(-61), F.lit(16.5))), -12, 34, 35, 72)
    assert not spark.range(1).select(far.alias("x")).first().x
    lon = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,)], "lon double")
    assert sorted(r.w for r in lon.select(wrap_longitude(F.col("lon")).alias("w")).collect()) == [-90, 0, 90, 180]


# --------------------------------------------------------------------- raster

UNIT = Grid(0, 0, 1, 1)
SQUARES = [("ZZ11", "NUTS1", [box(0, 2, 2, 4)]), ("ZZ12", "NUTS1", [box(3, 0, 5, 2)]), ("YY11", "NUTS1", [box(0, 0, 1, 1)])]


def gradient(spark, shift=0.0):
    cells = [(k, 3 - row, 10.0 * (k + 1) + row + shift) for row in range(4) for k in range(4)]
    return spark.createDataFrame(cells, "i int, j int, value double")


def zonal(spark, stat="mean", quality="", offset=0.0, shift=0.0, rows=SQUARES):
    out = zonal_statistics(gradient(spark, shift), shapes(spark, rows), UNIT, stat, base_quality=quality, offset=offset)
    return {r.geo_code: (r.value, r.quality) for r in out.collect()}


def test_mean_and_partial_coverage(spark):
    got = zonal(spark, quality="sampled")
    assert got["ZZ11"] == (15.5, "sampled") and got["ZZ12"] == (pytest.approx(42.5), "partial_coverage")


def test_far_zone_has_no_row_and_offset_applies(spark):
    assert zonal(spark, rows=[("ZZ50", "NUTS1", [box(50, 50, 51, 51)])]) == {}
    assert zonal(spark, shift=273.15, offset=-273.15)["ZZ11"][0] == pytest.approx(15.5)
    assert zonal(spark, "sum", offset=-273.15)["ZZ11"][0] == 62.0
    assert zonal(spark, "median")["ZZ11"][0] == 15.5 and zonal(spark, "count")["ZZ11"][0] == 4.0
    assert (zonal(spark, "min")["ZZ11"][0], zonal(spark, "max")["ZZ11"][0]) == (10.0, 21.0)


def test_weighted_median_equals_sorting(spark):
    rnd = random.Random(2)
    rows = [(z, float(rnd.choice([0, 0, 0, 1, 2.5, rnd.random() * 50])), rnd.choice([0.25, 0.5, 1.0])) for z in ("a", "b", "c") for _ in range(200)]
    rows += [("one", 7.0, 0.5)]

    def median(pairs):
        pairs, before, s = sorted(pairs), 0.0, []
        for k, (_, w) in enumerate(pairs):
            s.append(k * w + (len(pairs) - 1) * before)
            before += w
        target = (len(pairs) - 1) * before / 2
        k = max(i for i, x in enumerate(s) if x <= target)
        if k + 1 == len(s):
            return pairs[k][0]
        return pairs[k][0] + (target - s[k]) * (pairs[k + 1][0] - pairs[k][0]) / (s[k + 1] - s[k])

    got = {r.z: r["median"] for r in weighted_median(spark.createDataFrame(rows, "z string, value double, fraction double"), ["z"]).collect()}
    for z in ("a", "b", "c", "one"):
        assert got[z] == pytest.approx(median([(v, w) for c, v, w in rows if c == z]), abs=1e-9)


def test_months_years_and_merge(spark):
    spec = {"id": "lst", "unit": "DEG_C", "source": "copernicus", "geo_levels": ["NUTS1"], "temporal_agg": {"months": [6, 7, 8]}, "zonal_stat": "mean"}
    rows = [(f"{y}-{m:02d}-01", 0.5 + k, 3.5 - row, 10.0 * (k + 1) + row + (m - 6) + 273.15) for y in (2022, 2023) for m in (1, 6, 7, 8) for row in range(4) for k in range(4)]
    raster = spark.createDataFrame(rows, "day string, lon double, lat double, value double").select(F.col("day").cast("timestamp_ntz").alias("ts"), "lon", "lat", "value")
    root, zones = shared_dir(spark, "test"), shapes(spark, SQUARES[:1])

    def run(year, existing):
        fresh = zonal_indicator(raster.where(F.year("ts") == year), zones, spec, UNIT, "K")
        return write_zonal(existing, fresh, spec, root, f"run {year}")

    assert run(2023, None) == 1
    assert run(2022, read_canonical(spark, root)) == 2
    assert run(2023, read_canonical(spark, root)) == 2
    got = {r.time: (round(r.value, 6), r.quality, r.source_date) for r in read_canonical(spark, root).collect()}
    assert got == {"2022": (16.5, "", "run 2023"), "2023": (16.5, "", "run 2023")}


def test_crop_without_overlap_keeps_all(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "lon double, lat double")
    assert crop(df, 50, 50, 51, 51, 1).count() == 1 and crop(df, 0, 0, 0.5, 0.5, 0.25).count() == 1


def test_samples(spark):
    steps = spark.range(1).select(sampled_steps(F.lit(2023), F.array(F.lit(6), F.lit(7), F.lit(8))).alias("s")).first().s
    assert len(steps) == 12 and steps[0] == "2023-06-04T00:00:00" and {s[11:13] for s in steps} == {"00", "06", "12", "18"}


def test_units_and_routing(spark):
    cases = [("DEG_C", "K", None, -273.15), ("DEG_C", "", 290.0, -273.15), ("DEG_C", "", 30.0, 0.0), ("DEG_C", "degC", 290.0, 0.0), ("PCT", "K", 290.0, 0.0)]
    for unit, source, top, want in cases:
        assert spark.range(1).select(unit_offset(F.lit(unit), F.lit(source), F.lit(top).cast("double")).alias("o")).first().o == want
    one = spark.range(1)
    assert one.select(feed_of(F.lit("reanalysis-x")).alias("f"), feed_of(F.lit("imperviousness")).alias("g"), feed_of(F.lit("x"), "ARCO").alias("h")).first()[:] == ("reanalysis", "local", "arco")
    assert one.select(pick_variable(F.lit("2m_temperature"), F.array(F.lit("t2m"), F.lit("x"))).alias("v")).first().v == "t2m"


# ----------------------------------------------------------------- increments

def test_deltas(spark):
    remote = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, signal string")
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, value string")
    assert {r.key: r.status for r in freshness_delta(remote, state).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.key: r.status for r in freshness_delta(remote, state, full=True).collect()} == {"a": "forced", "b": "changed", "c": "new"}
    specs = spark.createDataFrame([("x",), ("y",)], "indicator string")
    last = spark.createDataFrame([("x", 2023)], "indicator string, last_year int")
    assert {(r.indicator, r.year) for r in year_delta(specs, [2024, 2023], last).collect()} == {("x", 2024), ("y", 2023), ("y", 2024)}
    kept = spark.createDataFrame([("x", "2022", 1), ("x", "2023", 1)], "indicator string, time string, v int")
    assert {(r.time, r.v) for r in merge_years(kept, kept.where("time = '2023'").withColumn("v", F.lit(2))).collect()} == {("2022", 1), ("2023", 2)}
    out = spark.createDataFrame([("osm", "failed", "boom"), ("osm", "failed", "boom"), ("osm", "updated", None)], "source string, status string, reason string")
    assert {(r.status, r["items"], r.reasons) for r in run_report(out).collect()} == {("failed", 2, "boom"), ("updated", 1, "")}


def test_cells_without_data_lower_the_coverage(spark):
    cells = gradient(spark).withColumn("value", F.when((F.col("i") == 0) & (F.col("j") == 3), float("nan")).otherwise(F.col("value")))
    assert covered_cells(cells, shapes(spark, SQUARES[:1]), UNIT).count() == 3
    assert zonal_statistics(cells, shapes(spark, SQUARES[:1]), UNIT).first().quality == "partial_coverage"


def test_many_asked_tags_are_not_broadcast(spark, specs):
    rows = [("europe/x", "node", k // 2, {"amenity": "pharmacy"}) for k in range(8)] + [("europe/x", "node", 9, {"amenity": "bar"})]
    elements = spark.createDataFrame(rows, "extract string, osm_type string, osm_id int, tags map<string,string>")
    for limit, join in ((2, "SortMergeJoin"), (3, "BroadcastHashJoin")):
        found = match_specs(elements, specs.where("source = 'osm'"), limit=limit)
        assert join in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.osm_id for r in found.collect()) == [0, 1, 2, 3]
