"""All core queries by name, and their SQL."""

from . import checks, corpus, files, layout, scoring, selection  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
