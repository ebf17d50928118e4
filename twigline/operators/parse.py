"""Documents to element rows: the one operator that needs Python, run narrow over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from twigline.dom import Dom, as_bytes, parse_html
from twigline.matcher import compile_queries, find_matches
from twigline.query import Query, QueryBuilder, as_queries

NODE_FIELDS = {
    "node_id": "int", "parent_id": "int", "prev_id": "int", "last_id": "int", "depth": "int", "name": "string", "id": "string",
    "class": "string", "classes": "array<string>", "attributes": "array<struct<key:string,value:string>>",
    "inner_start": "int", "inner_end": "int", "text_start": "int", "text_end": "int", "close_reason": "string",
}
NODE_DDL = ", ".join(f"{name} {kind}" for name, kind in NODE_FIELDS.items())
NODE_NAMES = list(NODE_FIELDS)
#: Columns that ``with_dom`` adds: element structs, bytes of the document, bytes of its text.
DOM, RAW, TEXT = "_nodes", "_html", "_text"


def _list(lengths: list[int], values: pa.Array) -> pa.Array:
    ends = [0]
    for k in lengths:
        ends.append(ends[-1] + k)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def nodes_array(doms: list[Dom]) -> pa.Array:
    """Element structs of several documents as one Arrow list array."""
    flat = lambda name: [x for d in doms for x in getattr(d, name)]
    classes = [(c or "").split() for d in doms for c in d.class_]
    attributes = flat("attributes")
    pairs = [p for a in attributes for p in a]
    columns = {
        **{k: pa.array(flat(k), pa.int32()) for k in ("node_id", "parent_id", "prev_id", "last_id", "depth")},
        "name": pa.array(flat("name"), pa.string()),
        "id": pa.array(flat("id"), pa.string()),
        "class": pa.array(flat("class_"), pa.string()),
        "classes": _list([len(c) for c in classes], pa.array([w for c in classes for w in c], pa.string())),
        "attributes": _list(
            [len(a) for a in attributes],
            pa.StructArray.from_arrays(
                [pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], ["key", "value"]
            ),
        ),
        **{k: pa.array(flat(k), pa.int32()) for k in ("inner_start", "inner_end", "text_start", "text_end")},
        "close_reason": pa.array(flat("close_reason"), pa.string()),
    }
    struct = pa.StructArray.from_arrays([columns[k] for k in NODE_NAMES], NODE_NAMES)
    return _list([len(d) for d in doms], struct)


#: Bytes that Spark reads as one partition, unless told otherwise.
SCAN_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its size makes fewer; larger inputs are left as they are.

    For small files of one row group, which Spark can't cut: parsing costs more than dealing their rows out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SCAN_BYTES else df


def with_dom(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the other columns) with the parsed document. Narrow, so it also runs on streams.

    The html may be text or UTF-8 bytes; null parses as empty.  Only the kept columns and the html are read.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (html_col, DOM, RAW, TEXT)]
    schema = df.select(*keep).schema.add(DOM, ArrayType(StructType.fromDDL(NODE_DDL), False))
    schema = schema.add(RAW, "binary").add(TEXT, "binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).cast(pa.binary())
            at = 0
            while at < batch.num_rows:  # a few megabytes of html at a time
                doms, raws, size, start = [], [], 0, at
                while at < batch.num_rows and size < 4_000_000:
                    raw = pages[at].as_py() or b""
                    doms.append(parse_html(raw))
                    raws.append(raw)
                    size += len(raw) + 1000
                    at += 1
                part = batch.slice(start, at - start)
                texts = pa.array([d.text for d in doms], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], nodes_array(doms), pa.array(raws, pa.binary()), texts], [*keep, DOM, RAW, TEXT]
                )

    return df.select(*keep, html_col).mapInArrow(parse, schema)


def element_rows(df: DataFrame, html_col: str, doc: str, keep: str, tags: frozenset[str] | None = None, contents: tuple[str, ...] = (RAW, TEXT)) -> DataFrame:
    """A row for every element with one of the names ``tags`` (None: any) (``doc`` and the element's fields), and one for every document, with node_id -1, ``doc``,
    ``keep``, and the ``contents`` asked for: the document's bytes and those of its text.  However many elements a document has, no row holds them all."""
    schema = StructType([df.schema[doc], *StructType.fromDDL(NODE_DDL)]).add(keep, df.schema[keep].dataType)
    for c in contents:
        schema = schema.add(c, BinaryType())
    names = schema.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, kept, pages = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            at = 0
            while at < batch.num_rows:  # a few megabytes of html at a time
                doms, raws, size, start = [], [], 0, at
                while at < batch.num_rows and size < 2_000_000:
                    raw = pages[at].as_py() or b""
                    doms.append(parse_html(raw, names=tags))
                    raws.append(raw)
                    size += len(raw) + 1000
                    at += 1
                fields = nodes_array(doms).flatten().flatten()
                n, m = sum(len(d) for d in doms), len(doms)
                owner = pa.array([start + i for i, d in enumerate(doms) for _ in range(len(d))] + list(range(start, at)), pa.int64())
                ends = [pa.array([-1] * m, pa.int32()), *(pa.nulls(m, f.type) for f in fields[1:])]
                none = pa.nulls(n, pa.binary())
                held = {RAW: raws, TEXT: [d.text for d in doms]}
                columns = [
                    numbers.take(owner), *(pa.concat_arrays(pair) for pair in zip(fields, ends, strict=True)),
                    kept.take(pa.array([None] * n + list(range(start, at)), pa.int64())),
                    *(pa.concat_arrays([none, pa.array(held[c], pa.binary())]) for c in contents),
                ]
                rows = pa.RecordBatch.from_arrays(columns, names)
                for some in range(0, rows.num_rows, 50_000):
                    yield rows.slice(some, 50_000)

    return df.select(doc, keep, html_col).mapInArrow(parse, schema)


def html_nodes(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per element: the kept columns and the element's fields. A table to store, join and query."""
    dom = with_dom(df, html_col, keep)
    keep = [c for c in dom.columns if c not in (DOM, RAW, TEXT)]
    return dom.select(*keep, F.inline(DOM))


EVENT_DDL = "seq int, event string, tag string, depth int, position int, reason string"


def html_events(
    df: DataFrame,
    html_col: str = "html",
    keep: list[str] | None = None,
    queries: Query | QueryBuilder | Iterable[Query | QueryBuilder] | None = None,
) -> DataFrame:
    """One row per event, for diagnosis.

    Without queries: start tags, end tags and implied closes with their reason.  With queries also the evaluation: the
    parse's start and end, tags that fit a waiting step or don't, scopes opened and closed, matches saved and complete,
    and the early end of the parse; ``reason`` then names the query and section (``0.1``).
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != html_col]
    clash = sorted(set(keep) & set(StructType.fromDDL(EVENT_DDL).names))
    if clash:
        raise ValueError(f"kept columns named as an event's: {clash}; rename them or leave them out of keep")
    many = None if queries is None else as_queries(queries)
    schema = df.select(*keep).schema
    for f in StructType.fromDDL(EVENT_DDL):
        schema = schema.add(f)
    names = schema.names
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def trace(html: bytes | None, plans: list | None) -> list[tuple]:
        if plans is None:
            return parse_html(html, trace=True).events
        found: list[tuple] = []
        find_matches(html, plans, found)
        return found

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = None if many is None else compile_queries(many)
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).cast(pa.binary())
            kept = batch.select(list(range(batch.num_columns - 1)))
            rows: list[int] = []
            found: list[tuple] = []
            for i in range(batch.num_rows):
                own = trace(pages[i].as_py(), plans)
                rows += [i] * len(own)
                found += [(n, *e) for n, e in enumerate(own)]
                if found and (len(found) > 50_000 or i == batch.num_rows - 1):
                    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.take(pa.array(rows)).columns, *columns], names)
                    rows, found = [], []

    return df.select(*keep, html_col).mapInArrow(events, schema)


def register_sql(spark: SparkSession, name: str = "html_nodes") -> None:
    """A table function for SQL: ``SELECT ... FROM pages, LATERAL html_nodes(html)``, with the elements' contents.

    Spark allows no batch-wise table function beside LATERAL, so rows are evaluated one by one, but travel in Arrow batches.
    """
    from pyspark.sql.functions import udtf

    ddl = (
        "node_id int, parent_id int, last_id int, depth int, name string, id string, class string, "
        "attributes map<string,string>, inner_html string, text_content string"
    )

    @udtf(returnType=ddl, useArrow=True)
    class HtmlNodes:
        def eval(self, html: str) -> Iterator[tuple]:
            yield from _with_content(html)

    spark.udtf.register(name, HtmlNodes)


def _with_content(html: str | bytes | None) -> Iterator[tuple]:
    data = as_bytes(html)
    dom = parse_html(data)
    for i in range(len(dom)):
        a, b = dom.inner_start[i], dom.inner_end[i]
        s, t = dom.text_start[i], dom.text_end[i]
        yield (
            i, dom.parent_id[i], dom.last_id[i], dom.depth[i], dom.name[i], dom.id[i], dom.class_[i],
            dict(reversed(dom.attributes[i])), None if a is None else data[a:b].decode("utf-8", "replace"),
            None if s is None or t is None else dom.text[s:t].decode("utf-8", "replace"),
        )
