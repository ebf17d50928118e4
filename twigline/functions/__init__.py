"""Column functions over matches and element structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(key: str, attributes: str | Column = "attributes") -> Column:
    """Value of the first attribute with exactly this key; null if it has none or there is no such attribute."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(1))["value"]


def has_attribute(key: str, attributes: str | Column = "attributes") -> Column:
    return F.exists(attributes, lambda a: a["key"] == key)


def attribute_map(attributes: str | Column = "attributes") -> Column:
    """Map of keys to values; the first of equal keys wins."""
    col = F.col(attributes) if isinstance(attributes, str) else attributes
    keys = F.transform(col, lambda a: a["key"])
    firsts = F.filter(col, lambda a, i: F.array_position(keys, a["key"]) == i + 1)
    return F.map_from_entries(firsts)


def class_words(cls: str | Column = "class") -> Column:
    return F.split(F.trim(F.coalesce(F.col(cls) if isinstance(cls, str) else cls, F.lit(""))), "\\s+")


def trim_unicode(text: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def match_json() -> Column:
    """A match row as a JSON object with name, id, class, attributes, inner_html and text_content."""
    return F.to_json(
        F.struct(
            "name", "id", "class", attribute_map("attributes").alias("attributes"), "inner_html", "text_content"
        ),
        {"ignoreNullFields": "false"},
    )
