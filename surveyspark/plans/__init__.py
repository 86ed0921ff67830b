"""Query bindings of every operator to the provided tables, with DuckDB oracle SQL."""

from . import chat, cleaning, crosstab, explain, flagship, misc, model, scoring, survey  # noqa: F401  (registers queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
