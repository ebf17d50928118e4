"""Structural-join plan: queries over an element table (one row per element), for documents that one task should not
evaluate alone.

Runs of child and descendant steps are one holistic merge (after Bruno, Koudas and Srivastava, "Holistic Twig Joins",
2002): the elements that fit any step of the run, sorted by document and number, pass a stack of the open ones.
Documents are cut into ranges of element numbers.  An element that is open at a cut goes to all ranges that it reaches
into, so the stack of a range starts with the ancestors carried over the cut, and ranges are merged independently.
Sibling steps are equi-joins on the sibling before, or on the parent with the least number that fits; conditions are
left semi and anti joins on the paths of the matches that meet them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from twigline.plans.predicates import compound_matches
from twigline.query import Query, Section
from twigline.selector import CHILD, DESCENDANT, LATER, NEXT, Step

#: Element numbers of a range.
RANGE = 1 << 16
#: Steps of one merge; longer runs take several.
RUN = 60
_FIELDS = ["node_id", "parent_id", "prev_id", "last_id", "node"]
_NOTHING: frozenset = frozenset()


class _Open:
    """An element on the stack: the scopes in which it passes each step (0: it is their scope), alone and with those around it."""

    __slots__ = ("all", "last", "node", "own")

    def __init__(self, node: int, last: int, own: list[frozenset], around: list[frozenset] | None) -> None:
        self.node, self.last, self.own = node, last, own
        self.all = own if around is None else [a if not o else o if not a else a | o for o, a in zip(own, around, strict=True)]


def merge_rows(rows: Iterator[tuple], combinators: list[str], whole: bool) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(place of the row, scope's path) of the elements that pass the last step, each once for every scope.

    ``rows`` are (place, group, in its own range, number, parent, last, bits of the steps that fit, path if it is a scope),
    by group and number, an element before itself as a scope.  ``whole``: the document is a scope as well.
    """
    steps = len(combinators)
    stack: list[_Open] = []
    now: object = stack  # no group
    for place, group, home, number, parent, last, bits, path in rows:
        if group != now:
            now = group
            stack = [_Open(-1, 1 << 62, [frozenset(((),)), *[_NOTHING] * steps], None)] if whole else []
        while stack and stack[-1].last < number:
            stack.pop()
        top = stack[-1] if stack else None
        if path is not None:
            scope = frozenset((tuple(path),))
            if top is not None and top.node == number:
                stack[-1] = _Open(number, last, [top.own[0] | scope, *top.own[1:]], stack[-2].all if len(stack) > 1 else None)
            else:
                stack.append(_Open(number, last, [scope, *[_NOTHING] * steps], top and top.all))
            continue
        if top is None:
            continue
        own, any_ = [_NOTHING], False
        for k, combinator in enumerate(combinators):
            found = _NOTHING
            if bits >> k & 1:
                found = top.all[k] if combinator == DESCENDANT else top.own[k] if top.node == parent else _NOTHING
            own.append(found)
            any_ = any_ or bool(found)
        if any_:
            if home:
                for scope_path in own[steps]:
                    yield place, scope_path
            if last > number:
                stack.append(_Open(number, last, own, top.all))


def _merge(nodes: DataFrame, key: list[str], scopes: DataFrame | None, steps: tuple[Step, ...]) -> DataFrame:
    """(key, path, element fields) of the elements that pass a run of child and descendant steps inside each scope."""
    fits = [compound_matches(s.compound, F.col) for s in steps]
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(fits)])
    path = ArrayType(IntegerType())
    rows = nodes.select(*key, *_FIELDS, bits.alias("_bits"), F.lit(None).cast(path).alias("path")).filter("_bits != 0")
    if scopes is None and len(steps) == 1:
        found = rows if steps[0].combinator == DESCENDANT else rows.filter("parent_id = -1")
        return found.select(*key, F.array().cast(path).alias("path"), *_FIELDS)
    if scopes is not None:
        rows = rows.unionByName(scopes.select(*key, *_FIELDS[:-1], F.lit(None).cast(nodes.schema["node"].dataType).alias("node"), F.lit(0).cast("long").alias("_bits"), "path"))
    ranges = F.sequence(F.expr(f"node_id div {RANGE}"), F.expr(f"last_id div {RANGE}"))
    rows = rows.withColumn("_range", F.explode(ranges)).withColumn("_home", F.col("_range") == F.expr(f"node_id div {RANGE}"))
    order = [*key, "_range", "node_id", F.col("path").isNotNull()]
    rows = rows.select(*key, "_range", "_home", "_bits", "path", *_FIELDS).repartition(*key, "_range").sortWithinPartitions(*order)
    combinators, whole, n = [s.combinator for s in steps], scopes is None, len(key)
    made = [*key, "path", *_FIELDS]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                held[:] = [batch]
                column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
                groups = zip(*[batch.column(i).to_pylist() for i in range(n + 1)], strict=True)
                values = [column(c) for c in ("_home", "node_id", "parent_id", "last_id", "_bits", "path")]
                yield from zip(range(batch.num_rows), groups, *values, strict=True)
                yield (-1, None, False, 0, 0, 0, 0, None)  # the batch ends

        def flush(places: list[int], paths: list[tuple[int, ...]]) -> pa.RecordBatch:
            kept = held[0].take(pa.array(places, pa.int64()))
            columns = {name: kept.column(i) for i, name in enumerate(kept.schema.names)}
            columns["path"] = pa.array(paths, pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([columns[c] for c in made], made)

        yield from _batched(rows_of(), combinators, whole, flush)

    schema = rows.select(*made).schema
    return rows.mapInArrow(merge, schema)


def _batched(rows: Iterator[tuple], combinators: list[str], whole: bool, flush) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The merge over rows that come in batches: what is found in a batch is cut out of it before the next one."""
    places: list[int] = []
    paths: list[tuple[int, ...]] = []
    ready: list[pa.RecordBatch] = []

    def passed() -> Iterator[tuple]:
        for row in rows:
            if row[0] < 0:
                if places:
                    ready.append(flush(places, paths))
                    places.clear()
                    paths.clear()
            else:
                yield row

    for place, path in merge_rows(passed(), combinators, whole):
        if ready:
            yield from ready
            ready.clear()
        places.append(place)
        paths.append(path)
    yield from ready


def _siblings(nodes: DataFrame, key: list[str], now: DataFrame, step: Step) -> DataFrame:
    """The elements that fit a step and stand behind one of ``now``: at once, or later."""
    fit = nodes.filter(compound_matches(step.compound, F.col)).select(*key, *_FIELDS)
    if step.combinator == NEXT:
        before = now.select(*key, "path", F.col("node_id").alias("prev_id"))
        return fit.join(before, [*key, "prev_id"]).select(*key, "path", *_FIELDS)
    first = now.groupBy(*key, "path", "parent_id").agg(F.min("node_id").alias("_first"))
    return fit.join(first, [*key, "parent_id"]).filter("node_id > _first").select(*key, "path", *_FIELDS)


def _alternative(nodes: DataFrame, key: list[str], scopes: DataFrame | None, steps: tuple[Step, ...]) -> DataFrame:
    now, at = scopes, 0
    while at < len(steps):
        to = at
        while to < len(steps) and to - at < RUN and steps[to].combinator in (CHILD, DESCENDANT):
            to += 1
        if to > at:
            now = _merge(nodes, key, now, steps[at:to])
        else:
            to = at + 1
            now = _siblings(nodes, key, now, steps[at])
        at = to
    return now


def _section(section: Section, nodes: DataFrame, key: list[str], scopes: DataFrame | None) -> DataFrame:
    """(key, path, element fields) of the section's matches; path is that of the scope, one row for each it lies in."""
    parts = [_alternative(nodes, key, scopes, steps) for steps in section.alternatives]
    now = parts[0]
    if len(parts) > 1:  # an element is one match, whichever selectors of the list it fits
        both = reduce(lambda a, b: a.unionByName(b), parts)
        now = both.groupBy(*key, "path", "node_id").agg(*[F.first(c).alias(c) for c in _FIELDS[1:]])
    for wanted, condition in section.conditions:
        inside = _inner(now)
        met = _section(condition, nodes, key, inside).select(*key, F.col("path").alias("_path")).distinct()
        now = now.withColumn("_path", F.concat("path", F.array("node_id"))).join(met, [*key, "_path"], "left_semi" if wanted else "left_anti").drop("_path")
    if section.first:
        least = now.groupBy(*key, "path").agg(F.min_by(F.struct(*_FIELDS), "node_id").alias("_m"))
        now = least.select(*key, "path", *[F.col("_m")[c].alias(c) for c in _FIELDS])
    return now


def _inner(matches: DataFrame) -> DataFrame:
    """Matches as scopes of what is inside them."""
    return matches.withColumn("path", F.concat("path", F.array("node_id")))


def tag_names(queries: list[Query]) -> frozenset[str] | None:
    """Names of the elements that some step of the queries can fit; None if a step takes any name."""

    def steps(section: Section) -> Iterator[Step]:
        for alternative in section.alternatives:
            yield from alternative
        for inner in (*section.children, *(c for _, c in section.conditions)):
            yield from steps(inner)

    names = {s.compound.name for q in queries for s in steps(q.root)}
    return None if None in names else frozenset(names)


def query_matches(query: Query, nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, section, path, node) of all matches of a query over an element table.

    ``nodes`` has the key columns (of a document, without nulls), the element's fields, and ``node``: what to give back
    of a matched element.
    """
    found: dict[int, DataFrame] = {}
    out = None
    for number, parent, section in query.sections():
        found[number] = _inner(_section(section, nodes, key, found.get(parent)))
        part = found[number].select(*key, F.lit(number).alias("section"), "path", "node")
        out = part if out is None else out.unionByName(part)
    return out
