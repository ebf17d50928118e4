"""Compound selectors as Catalyst expressions over an element, be it a struct or a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twigline.selector import AttributeTest, Compound

Fields = Callable[[str], Column]


def _words(value: Column) -> Column:
    return F.split(F.trim(value), "\\s+")


def value_matches(test: AttributeTest, value: Column) -> Column:
    """Null values fail every test but presence."""
    kind, needle = test.effective, test.value
    if kind == "presence":
        return F.lit(True)
    if kind == "exact":
        found = value == needle
    elif kind in ("word", "hyphen") and not needle:
        return F.lit(False)
    elif kind == "word":
        found = F.array_contains(_words(value), needle)
    elif kind == "hyphen":
        found = F.exists(_words(value), lambda w: (w == needle) | w.startswith(f"{needle}-"))
    elif kind == "prefix":
        found = value.startswith(needle)
    elif kind == "suffix":
        found = value.endswith(needle)
    else:
        found = value.contains(needle)
    return F.coalesce(found, F.lit(False))


def attribute_matches(test: AttributeTest, field: Fields) -> Column:
    found = F.exists(field("attributes"), lambda a: (a["key"] == test.key) & value_matches(test, a["value"]))
    if test.key in ("id", "class"):  # kept apart from the other attributes
        own = field(test.key)
        found = found | (own.isNotNull() & value_matches(test, own))
    return found


def compound_matches(c: Compound, field: Fields) -> Column:
    """Name, id, classes, attributes, in the order of rising cost; ``And`` stops at the first that fails."""
    tests: list[Column] = []
    if c.name is not None:
        tests.append(field("name") == c.name)
    if c.id is not None:
        tests.append(F.coalesce(field("id") == c.id, F.lit(False)))
    tests += [F.array_contains(field("classes"), x) for x in c.classes]
    tests += [attribute_matches(t, field) for t in c.attributes]
    return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(True)
