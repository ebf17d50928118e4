"""Selector queries over HTML documents in Spark DataFrames."""

from twigline.query import Query, QueryBuilder, QueryFactory, Save, query
from twigline.selector import SelectorParseError, parse_selector

__all__ = ["Query", "QueryBuilder", "QueryFactory", "Save", "SelectorParseError", "parse_selector", "query"]
