"""Queries of the engine over the bound tables."""

from factloom.plans import flow_queries, graph_queries, model_queries, search_queries, store_queries, text_queries, trace_queries  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
