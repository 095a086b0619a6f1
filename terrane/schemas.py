"""Table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Indicator x zone x period, one partition per indicator.
CANONICAL = _struct(
    indicator=S, geo_code=S, time=S, value=D, unit=S, quality=S, source=S, source_date=S,
    ingested_at=T.TimestampNTZType(),
)

ZONES = _struct(geo_code=S, level=S, name=S, parent_code=S, valid_from=I, country=S)

CHANGES = _struct(old_code=S, new_code=S, vintage_from=I, vintage_to=I, bijective=I, change=S)

#: Many datasets in one long table; the dimensions stay in a map.
CUBE = _struct(dataset=S, dims=T.MapType(S, S), time=S, value=D, flag=S)

STATE = _struct(source=S, key=S, value=S, updated_at=T.TimestampNTZType())

CATALOGUE = _struct(code=S, title=S, data_start=S, data_end=S, last_update=S)

CODELIST = _struct(dataset=S, dim=S, dim_label=S, pos=I, code=S, label=S)

POINT = _struct(x=D, y=D)
#: polygon -> ring -> point; the first ring of a polygon is its shell, the rest are holes.
GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))

POI = _struct(extract=S, country=S, osm_type=S, osm_id=L, tags=T.MapType(S, S), geom_type=S,
              lon=D, lat=D, geometry=GEOMETRY)

RASTER = _struct(product=S, variable=S, ts=T.TimestampNTZType(), lat=D, lon=D, value=D)

TAG = _struct(key=S, value=S)
EXTRACTION = _struct(
    dataset=S, filters=T.MapType(S, S), value_dim=S, time_dim=S, product=S, variable=S,
    temporal_agg=_struct(months=T.ArrayType(I), stat=S), zonal_stat=S, tags=T.ArrayType(TAG),
    geometry=T.ArrayType(S), aggregation=S,
)
SPECS = _struct(
    id=S, label=S, unit=S, source=S, frequency=S, geo_levels=T.ArrayType(S), nuts_vintage=I,
    description=S, extraction=EXTRACTION,
)

# The vocabulary of specs and zones.
SOURCES = ("eurostat", "copernicus", "osm")
FREQUENCIES = ("A", "Q", "M", "SNAPSHOT")
LEVELS = ("NUTS0", "NUTS1", "NUTS2", "NUTS3", "CITY")
LEVEL_BY_CODE_LENGTH = {2: "NUTS0", 3: "NUTS1", 4: "NUTS2", 5: "NUTS3", 6: "CITY"}
CURRENT_VINTAGE = 2024
PREVIOUS_VINTAGE = 2021
TEMPORAL_STATS = ("mean", "min", "max", "sum")
ZONAL_STATS = ("mean", "min", "max", "sum", "count", "median")
ELEMENT_TYPES = ("node", "way", "relation")

# Limits of one request.
MAX_INDICATORS = 5
MAX_ZONES = 100
MAX_ROWS = 400
MAX_CODES_PER_DIM = 25
MAX_LISTED_CODES = 60
LAST_PERIODS = 3
