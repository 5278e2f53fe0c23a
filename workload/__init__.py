"""Registered queries over the given tables."""

from workload import analysis, files, joins, live, runs, scalars, scenes, summaries  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
