"""Registered queries by subject."""

from lodestone.plans import checks, code, corpus, crawl, graphs, lookups, patterns, search, sqltables  # noqa: F401  they register themselves
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
