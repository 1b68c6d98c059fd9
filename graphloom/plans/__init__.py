"""Queries by name: importing the modules registers them."""

from . import function_queries, graph_queries, more_queries, relational_queries, retrieval_queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
