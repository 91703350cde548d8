"""All registered queries of the library (without the llm subpackage)."""

from . import catalog, estate, governance, graphs, text  # noqa: F401
from .base import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "query"]
