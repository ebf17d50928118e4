"""DataFrame operators: parse documents, run queries over them."""

from twigline.operators.extract import elements, except_matches, extract, intersect_matches, nested, select_matches
from twigline.operators.metrics import extract_observed
from twigline.operators.parts import extract_parts
from twigline.operators.parse import html_events, html_nodes, register_sql, with_dom

__all__ = ["elements", "except_matches", "extract", "extract_observed", "extract_parts", "html_events", "html_nodes", "intersect_matches", "nested", "register_sql", "select_matches", "with_dom"]
