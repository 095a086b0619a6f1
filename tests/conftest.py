import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from terrane.session import build_session

    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def zones(spark):
    from terrane.schemas import ZONES

    rows = [
        ("CZ", "NUTS0", "Česko", None, 2024, "CZ"), ("HU", "NUTS0", "Magyarország", None, 2024, "HU"),
        ("CZ0", "NUTS1", "Česko", "CZ", 2024, "CZ"), ("HU2", "NUTS1", "Dunántúl", "HU", 2024, "HU"),
        ("CZ06", "NUTS2", "Jihovýchod", "CZ0", 2024, "CZ"), ("CZ08", "NUTS2", "Moravskoslezsko", "CZ0", 2024, "CZ"),
        ("HU22", "NUTS2", "Nyugat-Dunántúl", "HU2", 2024, "HU"), ("CZ063", "NUTS3", "Kraj Vysočina", "CZ06", 2024, "CZ"),
        ("CZ064", "NUTS3", "Jihomoravský kraj", "CZ06", 2024, "CZ"), ("HU221", "NUTS3", "Győr-Moson-Sopron", "HU22", 2024, "HU"),
        ("CZ002C", "CITY", "Brno", "CZ064", 2024, "CZ"),
    ]
    return spark.createDataFrame(rows, ZONES)


def _row(id, source, frequency, levels, vintage=2024, **extraction):
    from terrane.schemas import SPECS

    fields = {f: None for f in SPECS["extraction"].dataType.names} | extraction
    return (id, id, "X", source, frequency, levels, vintage, None, fields)


@pytest.fixture(scope="session")
def make_specs(spark):
    from terrane.schemas import SPECS

    return lambda *rows: spark.createDataFrame([_row(**r) for r in rows], SPECS)


WAGES = dict(id="wage_index", source="eurostat", frequency="A", levels=["NUTS0", "NUTS1", "NUTS2"], dataset="wages",
             value_dim="geo", filters={"freq": "A", "unit": "INDEX"})
HOMES = dict(id="dwellings", source="eurostat", frequency="A", levels=["NUTS0", "NUTS1", "NUTS2", "NUTS3"], dataset="housing",
             value_dim="geo", filters={"freq": "A", "unit": "NR"})
PHARMACIES = dict(id="pharmacies", source="osm", frequency="SNAPSHOT", levels=["NUTS2", "NUTS3", "CITY"],
                  tags=[("amenity", "pharmacy")], geometry=["node", "way", "relation"], aggregation="count")


@pytest.fixture(scope="session")
def specs(make_specs):
    return make_specs(WAGES, HOMES, PHARMACIES)


@pytest.fixture(scope="session")
def canonical(spark):
    from datetime import datetime

    from terrane.schemas import CANONICAL

    stamp = datetime(2025, 4, 2)

    def rows(indicator, source, day, *cells):
        return [(indicator, z, t, float(v), "X", q, source, day, stamp) for z, t, v, q in cells]

    data = rows("wage_index", "eurostat", "03.02.2025", ("CZ06", "2022", 118.4, "e"), ("CZ06", "2021", 111, ""), ("CZ06", "2020", 104.5, ""),
                ("CZ06", "2019", 100, ""), ("HU22", "2022", 131, ""), ("HU22", "2021", 120.25, ""), ("CZ08", "2022", 109, ""))
    data += rows("dwellings", "eurostat", "14.01.2025", ("CZ06", "2022", 812400, ""), ("HU22", "2022", 455000, ""))
    q = "osm_completeness_unknown"
    data += rows("pharmacies", "osm", "extract 2025-03", ("CZ06", "2025-02", 211, q), ("CZ06", "2025-03", 214, q), ("CZ08", "2025-03", 187, q))
    return spark.createDataFrame(data, CANONICAL)
