"""Imports every module that registers queries."""

from jobmetrics.plans import feeds, functions, graphs, lineage, selections, series, states, totals, words  # noqa: F401
from jobmetrics.plans.registry import QUERIES

__all__ = ["QUERIES"]
