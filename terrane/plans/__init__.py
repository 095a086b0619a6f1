"""Composite jobs: the public entry points."""
