"""All registered queries."""

import importlib

from .base import ORACLES, QUERIES

for _family in ("indicator", "cube", "zone", "spatial", "raster", "search", "usage", "stream", "rest"):
    importlib.import_module(f"{__package__}.{_family}_queries")

__all__ = ["ORACLES", "QUERIES"]
