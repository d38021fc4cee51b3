"""Imports every module that registers queries."""

from lectern.plans import clusters, corpus, retrieval, rollups, segments, storage, texts  # noqa: F401
from lectern.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
