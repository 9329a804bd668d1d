"""Imports every query module, which fills the registry."""

from palimpsest.plans import adapter_queries, catalog_queries, grid_queries, heat_queries, mixture_queries, probe_queries, source_queries, text_queries  # noqa: F401
from palimpsest.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
