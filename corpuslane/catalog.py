"""Registered queries of the library, without the training-data operators."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "facet_counts"
MODULES = ("text_queries", "search_queries", "harvest_queries", "dictionary_queries", "store_queries", "extract_queries", "html_queries", "article_queries", "record_queries", "more_queries")

for _m in MODULES:
    importlib.import_module(f".plans.{_m}", __package__)

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
