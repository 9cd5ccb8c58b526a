"""Bindings of the operators to tables, as registered queries with the SQL they are held against."""

from tessella.plans import files, instances, listings, media, rasters, shapes, tiling  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
