"""Run queries over documents: matches as rows, or nested arrays of structs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from twigline.matcher import Match, compile_queries, find_matches
from twigline.operators.parse import RAW, TEXT, element_rows
from twigline.plans import joins
from twigline.query import Query, QueryBuilder, Section, as_queries
from twigline.scratch import shared_path

#: Columns of a match.
MATCH_FIELDS = {
    "query_ix": "int", "section_ix": "int", "selector": "string", "path": "array<int>", "parent_path": "array<int>",
    "node_id": "int", "depth": "int", "name": "string", "id": "string", "class": "string",
    "attributes": "array<struct<key:string,value:string>>", "inner_html": "string", "text_content": "string",
}
MATCH_COLUMNS = list(MATCH_FIELDS)
_PAIR = pa.struct([("key", pa.string()), ("value", pa.string())])
_ARROW = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def match_arrays(found: list[Match], selectors: list[list[str]], columns: Iterable[str] = MATCH_COLUMNS) -> list[pa.Array]:
    """Columns of matches; ``selectors`` by query and section."""

    def attributes() -> pa.Array:
        pairs = [p for m in found for p in m.attributes]
        ends = [0]
        for m in found:
            ends.append(ends[-1] + len(m.attributes))
        structs = pa.StructArray.from_arrays(
            [pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], ["key", "value"]
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    values = {
        "query_ix": lambda m: m.plan.query,
        "section_ix": lambda m: m.plan.number,
        "selector": lambda m: selectors[m.plan.query][m.plan.number],
        "path": lambda m: m.path,
        "parent_path": lambda m: m.path[:-1],
        "node_id": lambda m: m.path[-1],
        "depth": lambda m: m.depth,
        "name": lambda m: m.name,
        "id": lambda m: m.id,
        "class": lambda m: m.class_,
        "inner_html": lambda m: m.inner_html,
        "text_content": lambda m: m.text_content,
    }
    return [attributes() if c == "attributes" else pa.array([values[c](m) for m in found], _ARROW[MATCH_FIELDS[c]]) for c in columns]


def kept_columns(df: DataFrame, html_col: str, keep: list[str] | None, made: Iterable[str]) -> list[str]:
    """The columns to keep (default: all but the html); none may be named as one that is made."""
    kept = [c for c in df.columns if c != html_col] if keep is None else [c for c in keep if c != html_col]
    clash = sorted(set(kept) & set(made))
    if clash:
        raise ValueError(f"kept columns named as a match's: {clash}; rename them or leave them out of keep")
    return kept


def extract(
    df: DataFrame,
    queries: Query | QueryBuilder | Iterable[Query | QueryBuilder],
    html_col: str = "html",
    keep: list[str] | None = None,
    plan: str = "local",
    columns: Iterable[str] = MATCH_COLUMNS,
) -> DataFrame:
    """One row per match of every selector of every query, with the kept columns (default: all but the html) and the
    match's ``columns`` (default: all; fewer cost less, as Spark can't prune what Python makes).

    ``plan`` "local" evaluates a document's queries while it is parsed, and stops where nothing more can match: no
    shuffle, fit for streams; only matches leave the Python worker.  "joins" joins element rows instead (see
    ``plans.joins``): a document's elements are dealt over tasks by ranges.  Both give the same rows.

    ``path`` names a match by the element numbers of its enclosing matches and its own; ``parent_path`` is the enclosing
    match's.  ``with_ordinal`` adds a match's place in its scope.  Null html has no matches; repeated rows have their
    matches each.
    """
    many = as_queries(queries)
    columns = list(columns)
    unknown = sorted(set(columns) - set(MATCH_COLUMNS))
    if unknown:
        raise ValueError(f"no columns of a match: {unknown}")
    kept = kept_columns(df, html_col, keep, columns)
    if plan == "joins":
        return _extract_joined(df, many, html_col, kept, columns)
    if plan != "local":
        raise ValueError(f"unknown plan {plan!r}")
    schema = df.select(*kept).schema
    for f in StructType.fromDDL(", ".join(f"{c} {MATCH_FIELDS[c]}" for c in columns)) if columns else ():
        schema = schema.add(f)
    names = schema.names
    selectors = [[s.selector for _, _, s in q.sections()] for q in many]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = compile_queries(many)
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).cast(pa.binary())
            own = batch.select(list(range(batch.num_columns - 1)))
            rows: list[int] = []
            found: list[Match] = []
            held = 0  # bytes of the content found
            for i in range(batch.num_rows):
                some = find_matches(pages[i].as_py(), plans)
                rows += [i] * len(some)
                found += some
                held += sum(len(m.inner_html or "") + len(m.text_content or "") for m in some)
                if found and (len(found) > 20_000 or held > 8_000_000 or i == batch.num_rows - 1):
                    kept_rows = own.take(pa.array(rows)).columns if kept else []
                    yield pa.RecordBatch.from_arrays([*kept_rows, *match_arrays(found, selectors, columns)], names)
                    rows, found, held = [], [], 0

    return df.select(*kept, html_col).mapInArrow(find, schema)


def with_ordinal(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each match among its selector's matches in the same enclosing match, from 0. ``keys`` name a document."""
    scope = Window.partitionBy(*keys, "query_ix", "section_ix", "parent_path").orderBy("node_id")
    return matches.withColumn("ordinal", (F.row_number().over(scope) - 1).cast("int"))


def _bytes(source: str | Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(source, start + 1, end - start), "UTF-8")


#: What a match needs of its element beside its number.
_ELEMENT = ["depth", "name", "id", "class", "attributes", "inner_start", "inner_end", "text_start", "text_end"]


def _extract_joined(df: DataFrame, many: list[Query], html_col: str, kept: list[str], columns: list[str]) -> DataFrame:
    """The documents are parsed once and numbered; queries are joins of narrow element rows by that number.

    The parsed documents are a table in the shared folder: numbers stay what they are if an executor is lost, and every
    step reads the columns it needs.
    """
    numbered = df.select(F.struct(*kept).alias("_keep") if kept else F.struct(F.lit(0).alias("_")).alias("_keep"), F.monotonically_increasing_id().alias("_doc"), html_col)
    wanted = {RAW: any(s.save.inner_html for q in many for _, _, s in q.sections()), TEXT: any(s.save.text_content for q in many for _, _, s in q.sections())}
    contents = [c for c, needed in wanted.items() if needed]
    rows = element_rows(numbered, html_col, "_doc", "_keep", joins.tag_names(many), tuple(contents))
    path = shared_path(df.sparkSession, "elements")
    rows.write.parquet(path)
    parsed = df.sparkSession.read.schema(rows.schema).parquet(path)
    used = ["node_id", "parent_id", "prev_id", "last_id", "name", "id", "class", "classes", "attributes"]
    nodes = parsed.filter("node_id >= 0").select("_doc", *used, F.struct(*_ELEMENT).alias("node"))
    rows = None
    for k, q in enumerate(many):
        part = joins.query_matches(q, nodes, ["_doc"]).withColumn("query_ix", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    if kept or contents:
        rows = rows.join(parsed.filter("node_id = -1").select("_doc", "_keep", *contents), "_doc")
    n, path = F.col("node"), F.col("path")
    picked = lambda what: F.array(*[F.array(*[F.lit(what(s)) for _, _, s in q.sections()]) for q in many])[F.col("query_ix")][F.col("section")]
    inner, text = picked(lambda s: s.save.inner_html), picked(lambda s: s.save.text_content)
    cut = {
        "inner_html": F.when(inner & n["inner_start"].isNotNull(), _bytes(RAW, n["inner_start"], n["inner_end"])) if wanted[RAW] else None,
        "text_content": F.when(text & n["text_end"].isNotNull() & n["text_start"].isNotNull(), _bytes(TEXT, n["text_start"], n["text_end"])) if wanted[TEXT] else None,
    }
    made = {
        "query_ix": F.col("query_ix"), "section_ix": F.col("section"), "selector": picked(lambda s: s.selector), "path": path,
        "parent_path": F.slice(path, F.lit(1), F.size(path) - 1), "node_id": F.element_at("path", -1), **{f: n[f] for f in _ELEMENT[:5]},
        **{c: F.lit(None).cast("string") if x is None else x for c, x in cut.items()},
    }
    return rows.select(*[F.col("_keep")[c].alias(c) for c in kept], *[made[c].alias(c) for c in columns])


_NESTED = ("node_id", "depth", "name", "id", "class", "attributes", "inner_html", "text_content")


def _nested_type(section: Section) -> str:
    fields = [f"{f}:{MATCH_FIELDS[f]}" for f in _NESTED]
    fields += [f"children_{i}:array<{_nested_type(c)}>" for i, c in enumerate(section.children)]
    return f"struct<{','.join(fields)}>"


def _nested_arrow(section: Section) -> pa.DataType:
    fields = [(f, pa.list_(_PAIR) if f == "attributes" else _ARROW[MATCH_FIELDS[f]]) for f in _NESTED]
    fields += [(f"children_{i}", pa.list_(_nested_arrow(c))) for i, c in enumerate(section.children)]
    return pa.struct(fields)


def nested(df: DataFrame, query: Query | QueryBuilder, html_col: str = "html", keep: list[str] | None = None, into: str = "matches") -> DataFrame:
    """One row per document: an array of match structs, each with one array field per child selector.

    Child fields are named ``children_0``, ``children_1``, ... in the order of the child selectors.
    """
    (q,) = as_queries(query)
    kept = kept_columns(df, html_col, keep, [into])
    schema = df.select(*kept).schema.add(into, ArrayType(StructType.fromDDL(f"x {_nested_type(q.root)}")[0].dataType))
    kind = pa.list_(_nested_arrow(q.root))
    places = {}  # section number: parent's number and place among its children
    for number, parent, _ in q.sections():
        places[number] = (parent, sum(p == parent for p, _ in places.values()))
    counts = {number: len(section.children) for number, _, section in q.sections()}

    def tree(found: list[Match]) -> list[dict]:
        top: list[dict] = []
        made: dict[tuple, dict] = {}
        for m in found:
            number = m.plan.number
            values = (m.path[-1], m.depth, m.name, m.id, m.class_, [{"key": k, "value": v} for k, v in m.attributes], m.inner_html, m.text_content)
            node = dict(zip(_NESTED, values, strict=True)) | {f"children_{i}": [] for i in range(counts[number])}
            made[number, m.path] = node
            parent, place = places[number]
            (top if parent < 0 else made[parent, m.path[:-1]][f"children_{place}"]).append(node)
        return top

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = compile_queries([q])
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                trees = [tree(find_matches(p.as_py(), plans)) for p in pages.slice(at, 256)]
                part = batch.slice(at, len(trees))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(trees, kind)], schema.names)

    return df.select(*kept, html_col).mapInArrow(build, schema)


def select_matches(matches: DataFrame, selector: str, root: bool = True) -> DataFrame:
    """The rows of one selector: of a root (default) or of a child section."""
    is_root = F.size("parent_path") == 0
    return matches.filter((F.col("selector") == selector) & (is_root if root else ~is_root))


def intersect_matches(matches: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Matches whose element is also one of ``other``'s. ``keys`` name a document, without nulls."""
    return matches.join(other.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_semi")


def except_matches(matches: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Matches whose element is none of ``other``'s."""
    return matches.join(other.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_anti")


def elements(df: DataFrame, selector: str, save=None, html_col: str = "html", keep: list[str] | None = None, first: bool = False, columns: Iterable[str] = MATCH_COLUMNS) -> DataFrame:  # noqa: ANN001
    """Shorthand for one selector."""
    start = Query.first if first else Query.all
    return extract(df, start(selector, save), html_col, keep, columns=columns)
