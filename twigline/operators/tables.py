"""Table functions for SQL that take whole tables and evaluate them batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from twigline.matcher import Match, Program, compile_queries, find_matches
from twigline.operators.extract import MATCH_FIELDS, match_arrays
from twigline.query import Query, query


def _query(selector: str, save: str) -> Query:
    """From a selector, or a query spec as JSON."""
    return query(selector) if selector.lstrip().startswith("{") else query({"all": selector, "save": save})


def register_select(spark: SparkSession, keep: str = "page_id long", name: str = "html_select") -> None:
    """``SELECT ... FROM html_select(TABLE(SELECT page_id, html FROM pages), 'nav a[href]', 'text_content')``.

    The table argument needs the columns ``keep`` (DDL, by which the result's schema is known; none may be named as a
    match's) and ``html``; null html has no matches.  The other arguments are a selector, or a query spec as JSON, and
    what to save (all, none, inner_html, text_content; not used with a spec).  One row per match: the kept columns and
    the match's.  Without ``PARTITION BY`` no row is moved; with it, a partition's rows come together.

    Spark's Arrow table functions must name their schema beforehand, so it can't follow from the selector.
    """
    kept = StructType.fromDDL(keep)
    clash = sorted(set(kept.names) & {*MATCH_FIELDS, "html"})
    if clash:
        raise ValueError(f"kept columns named as a match's, or html: {clash}")
    wanted = [(f.name, to_arrow_type(f.dataType)) for f in kept]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {k}" for c, k in MATCH_FIELDS.items())])

    class Select:
        def __init__(self) -> None:
            self.known: tuple | None = None

        def _program(self, selector: str, save: str) -> tuple[Program, list[list[str]]]:
            if self.known is None or self.known[0] != (selector, save):
                q = _query(selector, save)
                self.known = ((selector, save), compile_queries([q]), [[s.selector for _, _, s in q.sections()]])
            return self.known[1:]

        def eval(self, rows: pa.RecordBatch, selector: pa.Array, save: pa.Array) -> Iterator[pa.Table]:
            if not rows.num_rows:
                return
            program, selectors = self._program(selector[0].as_py(), save[0].as_py())
            pages = rows.column(rows.schema.get_field_index("html")).cast(pa.binary())
            own = pa.Table.from_arrays([rows.column(rows.schema.get_field_index(c)).cast(k) for c, k in wanted], [c for c, _ in wanted])
            owners: list[int] = []
            found: list[Match] = []
            held = 0
            for i in range(rows.num_rows):
                some = find_matches(pages[i].as_py(), program)
                owners += [i] * len(some)
                found += some
                held += sum(len(m.inner_html or "") + len(m.text_content or "") for m in some)
                if found and (len(found) > 20_000 or held > 8_000_000 or i == rows.num_rows - 1):
                    columns = own.take(pa.array(owners, pa.int64())).columns
                    yield pa.Table.from_arrays([*columns, *match_arrays(found, selectors)], [*own.column_names, *MATCH_FIELDS])
                    owners, found, held = [], [], 0

    spark.udtf.register(name, arrow_udtf(Select, returnType=ddl))
