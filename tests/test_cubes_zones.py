"""Cube files and projection, code lists, zones, codes, requests, specs."""

import json
import os

import pytest
from conftest import PHARMACIES, WAGES
from pyspark.sql import functions as F

from terrane.functions.zones import code_hint, is_aggregate, level_hint
from terrane.operators.lookup import list_codes, structure_summary
from terrane.operators.projection import project_indicators, recode_verdict
from terrane.operators.validate import validate_requests, validate_specs
from terrane.operators.zones import build_changes, list_zones
from terrane.plans.cubes import project_all, project_only, query_cube
from terrane.schemas import CODELIST, CUBE
from terrane.session import shared_dir
from terrane.sources.canonical import read_canonical
from terrane.sources.cubes import parse_wide_lines, read_cube, write_cube
from terrane.sources.files import load_specs, read_features, read_toc, upsert_state
from terrane.sources.jsonstat import explode_jsonstat, explode_structure


def cube(spark, *rows):
    return spark.createDataFrame([("wages", {"freq": f, "unit": u, "geo": g}, t, v, q) for f, u, g, t, v, q in rows], CUBE)


# two rows that count; then another unit, another frequency, an aggregate, a level that isn't asked for, a row without value
NATIVE = [("A", "INDEX", "CZ06", "2022", 118.4, "e"), ("A", "INDEX", "HU22", "2022", 131.0, ""), ("A", "CZK", "CZ06", "2022", 39_000.0, ""),
          ("Q", "INDEX", "CZ06", "2022-Q3", 117.0, ""), ("A", "INDEX", "EU27_2020", "2022", 125.5, ""), ("A", "INDEX", "CZ064", "2022", 121.0, ""),
          ("A", "INDEX", "CZ08", "2022", None, "b")]


@pytest.fixture(scope="module")
def changes(spark):
    table = spark.createDataFrame([("HU2A", "HU22", "Code change"), ("CZ0X", "", "Merged"), ("LV00A", "LV00C", "Name change"),
                                   ("EE00B", "EE009", "Boundary shift"), ("", "", "x")], "old_code string, new_code string, change string")
    return build_changes(table)


def test_wide_file_cells(spark):
    head = "freq,unit,geo\\TIME_PERIOD\t2020 \t2021\t2022\t2023"
    lines = spark.createDataFrame([("f", "d", x) for x in (
        head, "A,X,LV\t:\t87.25 e \t: z\t0.5", "A,X,EE\tn/a\t\t 12", "A,X,LT\t-2 b u\t4f\t6e2\t11\t13")], "file string, dataset string, line string")
    got = {(r.dims["geo"], r.time): (r.value, r.flag) for r in parse_wide_lines(lines, 1).collect()}
    assert got == {("LV", "2021"): (87.25, "e"), ("LV", "2023"): (0.5, ""), ("EE", "2022"): (12.0, ""),
                   ("LT", "2020"): (-2.0, "b u"), ("LT", "2022"): (600.0, ""), ("LT", "2023"): (11.0, "")}


def test_projection_keeps_reference_zones_only(spark, make_specs, zones):
    got = project_indicators(cube(spark, *NATIVE), make_specs(WAGES), zones).collect()
    assert {(r.geo_code, r.time, r.value, r.quality) for r in got} == {("CZ06", "2022", 118.4, "e"), ("HU22", "2022", 131.0, "")}


def test_projection_recodes_the_older_vintage(spark, make_specs, zones, changes):
    old = cube(spark, ("A", "INDEX", "HU2A", "2020", 96.0, ""), ("A", "INDEX", "CZ0X", "2020", 88.0, ""), ("A", "INDEX", "CZ06", "2020", 104.5, "e"))
    got = project_indicators(old, make_specs(WAGES | {"vintage": 2021}), zones, changes).collect()
    assert {(r.geo_code, r.quality) for r in got} == {("HU22", "recoded"), ("CZ06", "e")}
    current = project_indicators(old, make_specs(WAGES), zones, changes).collect()
    assert {r.geo_code for r in current} == {"CZ06"}


def test_verdicts(spark, changes):
    codes = spark.createDataFrame([("LV00A",), ("CZ0X",), ("EE00B",), ("HU22",)], "geo_code string")
    got = {r.geo_code: (r.new_code, r.bijective) for r in recode_verdict(codes, changes, 2021).collect()}
    assert got == {"LV00A": ("LV00C", True), "CZ0X": (None, False), "EE00B": ("EE009", False), "HU22": ("HU22", True)}


def test_store_and_project_again(spark, make_specs, zones):
    root = shared_dir(spark, "test")
    write_cube(cube(spark, *NATIVE), f"{root}/native")
    assert project_all(read_cube(spark, f"{root}/native"), make_specs(WAGES), zones, None, f"{root}/canon") == 2
    assert project_only(spark, f"{root}/native", make_specs(WAGES), zones, None, f"{root}/canon") == 2
    assert read_canonical(spark, f"{root}/canon").count() == 2


def test_native_query(spark):
    wide = cube(spark, *NATIVE).select(F.col("dims.freq"), F.col("dims.unit"), F.col("dims.geo"), "time", "value", "flag")
    got = query_cube(wide, ["freq", "unit", "geo"], {"geo": "CZ06++HU22", "unit": "INDEX", "freq": "A"}, "2022", "2022", limit=1).collect()
    assert [(r.geo, r.truncated) for r in got] == [("CZ06", True)]


def test_jsonstat(spark):
    dims = {"geo": {"category": {"index": {"LT": 1, "LV": 0}, "label": {"LV": "Latvija"}}}, "time": {"label": "Time", "category": {"index": {"2022": 0, "2023": 1}}}}
    doc = {"id": ["geo", "time"], "size": [2, 2], "dimension": dims}
    docs = spark.createDataFrame([("s", json.dumps(doc | {"value": {"0": 1.5, "3": 4}})), ("l", json.dumps(doc | {"value": [1, 2, None, 4]}))], "k string, json string")
    got = {(r.k, r.coords["geo"], r.coords["time"]): r.value for r in explode_jsonstat(docs).where("value is not null").collect()}
    assert got == {("s", "LV", "2022"): "1.5", ("s", "LT", "2023"): "4", ("l", "LV", "2022"): "1", ("l", "LV", "2023"): "2", ("l", "LT", "2023"): "4"}
    codes = {(r.dim, r.code): (r.dim_label, r.pos, r.label) for r in explode_structure(docs.where("k = 's'")).collect()}
    assert codes == {("geo", "LV"): ("geo", 0, "Latvija"), ("time", "2022"): ("Time", 0, "2022"), ("time", "2023"): ("Time", 1, "2023")}


def test_codes_ranked(spark):
    codes = ["AT33", "LT", "LT022", "LT02", "LT01", "MT00", "NL4LT", "SE33", "SK"]
    labels = {"AT33": "Altirol", "SE33": "Övre Norrland", "SK": "Slovensko", "MT00": "Maltese islands"}
    rows = [("d", "geo", "Geo", i, c, labels.get(c, "x")) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, CODELIST)
    got = [r.code for r in list_codes(df, "LT").orderBy("place").collect()]
    assert got == ["LT", "LT02", "LT01", "LT022", "NL4LT", "AT33", "MT00"]
    assert [r.code for r in list_codes(df, "ovre").collect()] == ["SE33"]
    assert {r.remaining for r in list_codes(df, "", limit=4).collect()} == {5}
    assert {r.remaining for r in structure_summary(df, 2).collect()} == {7}


def codes_of(df):
    return [r.geo_code for r in df.collect()]


def test_zone_listing(zones):
    assert codes_of(list_zones(zones, "NUTS2")) == ["CZ06", "CZ08", "HU22"]
    assert codes_of(list_zones(zones, "NUTS2", parent="CZ")) == ["CZ06", "CZ08"]
    assert codes_of(list_zones(zones, "NUTS3", parent="CZ06")) == ["CZ063", "CZ064"]
    assert codes_of(list_zones(zones, "NUTS1", parent="CZ0")) == []
    assert codes_of(list_zones(zones, "CITY", parent="CZ064")) == ["CZ002C"]
    assert codes_of(list_zones(zones, "NUTS3", contains="GYŐR")) == ["HU221"]
    assert codes_of(list_zones(zones, "NUTS2", contains="dunantul")) == ["HU22"]


def test_hints(spark):
    one = spark.range(1)
    for code, want in [("GR30", "use:EL30"), ("UKI", "outside_nomenclature"), ("GB", "outside_nomenclature"), ("EU27_2020", "aggregate:use_cube"), ("CZ06", None)]:
        assert one.select(code_hint(F.lit(code)).alias("h")).first().h == want
    assert one.select(is_aggregate(F.lit("EFTA")).alias("a")).first().a and not one.select(is_aggregate(F.lit("EE")).alias("a")).first().a
    levels = F.array(F.lit("NUTS2"), F.lit("NUTS3"), F.lit("CITY"))
    assert one.select(level_hint(F.lit("HU"), F.lit("NUTS0"), levels).alias("h")).first().h == "list:NUTS2<HU"


def test_request_checks(spark, specs, zones, canonical):
    rows = [("a", "wage_index", "cz064"), ("b", "pharmacies", "HU"), ("c", "wage_index", "GR30"), ("d", "wage_index", "EU27_2020"),
            ("e", "nothing", "HU"), ("f", "wage_index", "CZ06")]
    rows += [("six", f"i{k}", "HU") for k in range(6)] + [("many", "dwellings", f"Z{k:03d}") for k in range(101)]
    present = canonical.select("indicator").where("indicator <> 'dwellings'")
    got = {r.request_id: (r.error_code, r.hint) for r in validate_requests(
        spark.createDataFrame([*rows, ("g", "dwellings", "CZ06")], "request_id string, indicator string, zone string"), specs, zones, present).collect()}
    assert got == {"a": ("level_not_offered", "ancestor:CZ06"), "b": ("level_not_offered", "list:NUTS2<HU"), "c": ("unknown_zone", "use:EL30"),
                   "d": ("unknown_zone", "aggregate:use_cube:wages"), "e": ("unknown_indicator", None), "f": (None, None),
                   "six": ("too_many_indicators", None), "many": ("too_many_zones", None), "g": ("not_materialized", None)}


def test_spec_checks(make_specs, specs):
    assert validate_specs(specs).count() == 0
    bad = make_specs(PHARMACIES | {"id": "no_tags", "tags": None}, WAGES | {"id": "odd", "source": "census"}, WAGES | {"id": "lau", "levels": ["LAU"]},
                     WAGES | {"id": "bad id"}, WAGES | {"id": "twice"}, WAGES | {"id": "twice"})
    got = {(r.id, r.problem) for r in validate_specs(bad).collect()}
    assert got == {("no_tags", "tags_empty"), ("odd", "source_unknown"), ("lau", "level_unknown"), ("bad id", "id_malformed"), ("twice", "id_duplicated")}


def test_spec_files(spark, tmp_path):
    spec = {"id": "jobs", "label": "Jobs", "unit": "NR", "source": "eurostat", "frequency": "A", "geo_levels": ["NUTS0"], "extraction": {"dataset": "labour", "filters": {"nace": "C"}}}
    (tmp_path / "jobs.json").write_text(json.dumps(spec))
    (tmp_path / "other.json").write_text(json.dumps(spec | {"colour": "red"}))
    got = load_specs(spark, str(tmp_path))
    assert got.where("file = 'jobs'").first().extraction.filters == {"nace": "C"}
    assert {(r.id, r.problem) for r in validate_specs(got).collect()} == {("jobs", "id_differs_from_file"), ("jobs", "field_unknown"), ("jobs", "id_duplicated")}
    assert load_specs(spark, str(tmp_path), "osm").count() == 0


def test_catalogue_file(spark, tmp_path):
    head = '"title"\t"code"\t"type"\t"last update of data"\t"last table structure change"\t"data start"\t"data end"'
    rows = [head, '"  First "\t"a"\t"dataset"\t"01.01.2026"\t""\t"2000"\t"2025"', '"Second"\t"a"\t"table"\t"x"\t""\t""\t""',
            '"Folder"\t"f"\t"folder"\t""\t""\t""\t""', '"short"\t"s"', '"Table"\t"b"\t"table"\t"02.01.2026"\t""\t""\t"2025"']
    (tmp_path / "toc.txt").write_text("\n".join(rows))
    got = {r.code: (r.title, r.data_start, r.last_update) for r in read_toc(spark, str(tmp_path / "toc.txt")).collect()}
    assert got == {"a": ("First", "2000", "01.01.2026"), "b": ("Table", "", "02.01.2026")}


def test_geojson(spark, tmp_path):
    box = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    doc = {"features": [{"properties": {"NUTS_ID": "ZZ1", "LEVL_CODE": 1}, "geometry": {"type": "Polygon", "coordinates": box}},
                        {"properties": {"NUTS_ID": "ZZ2"}, "geometry": {"type": "MultiPolygon", "coordinates": [box, box]}}]}
    os.makedirs(tmp_path / "geo")
    (tmp_path / "geo" / "a.geojson").write_text(json.dumps(doc))
    got = {r.properties["NUTS_ID"]: r.geometry for r in read_features(spark, str(tmp_path / "geo")).collect()}
    assert len(got["ZZ2"]) == 2 and got["ZZ1"][0][0][2].asDict() == {"x": 2.0, "y": 2.0}


def test_state_keeps_the_latest(spark):
    def state(*rows):
        return spark.createDataFrame(rows, "source string, key string, value string, at string").select(
            "source", "key", "value", F.col("at").cast("timestamp_ntz").alias("updated_at"))

    got = upsert_state(state(("osm", "k", "1", "2026-01-01"), ("osm", "z", "1", "2026-01-01")), state(("osm", "k", None, "2026-01-02")))
    assert {(r.key, r.value) for r in got.collect()} == {("k", None), ("z", "1")}


def test_misspelt_filter_leaves_the_indicator(spark, make_specs, zones):
    from terrane.plans.cubes import project_all, spec_problems
    from terrane.schemas import CUBE
    from terrane.session import shared_dir
    from terrane.sources.canonical import read_canonical

    root = f"{shared_dir(spark, 'test')}/store"
    cube = spark.createDataFrame([("d", {"freq": "A", "geo": "CZ"}, "2020", 1.0, "")], CUBE)
    spec = dict(id="x", source="eurostat", frequency="A", levels=["NUTS0"], dataset="d", value_dim="geo")
    right, wrong = make_specs(dict(spec, filters={"freq": "A"})), make_specs(dict(spec, filters={"frq": "A"}))
    assert project_all(cube, right, zones, None, root) == 1
    assert [tuple(r) for r in spec_problems(cube, wrong).collect()] == [("x", "d", "frq")]
    assert project_all(cube, wrong, zones, None, root) == 0
    assert read_canonical(spark, root).count() == 1


def test_canonical_store_that_is_not_there_yet(spark):
    from terrane.session import shared_dir
    from terrane.sources.canonical import read_canonical

    assert read_canonical(spark, f"{shared_dir(spark, 'test')}/none").count() == 0
