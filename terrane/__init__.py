"""Territorial indicators on Spark: cubes, rasters and points at one grain."""
