"""Registered queries: each runs an operator over the given tables, most with a checking SQL text."""

from . import catalog, evaluation, evolution, files, intent, ranking, reports, retrieval, text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
