"""Figures of an extraction, observed while it runs: no second pass, no accumulators of one's own."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from twigline.dom import Walk, as_bytes
from twigline.matcher import Match, Matcher, compile_queries, finish
from twigline.operators.extract import MATCH_FIELDS, kept_columns, match_arrays
from twigline.query import Query, QueryBuilder, as_queries

#: How elements are closed, beside by their own end tag.
RECOVERIES = ("implied", "mismatched", "eof")
_COUNTS = ["documents", "bytes", "bytes_read", "early_ends", *RECOVERIES]


class _Counting(Matcher):
    def __init__(self, program) -> None:  # noqa: ANN001
        super().__init__(program)
        self.closed: Counter = Counter()

    def close(self, row: int, depth: int, last: int, end: int, size: int, reason: str) -> bool:
        self.closed[reason] += 1
        return super().close(row, depth, last, end, size, reason)


def extract_observed(
    df: DataFrame,
    queries: Query | QueryBuilder | Iterable[Query | QueryBuilder],
    observation: Observation,
    html_col: str = "html",
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``extract``; after an action on them, ``observation.get`` holds what it took.

    documents, bytes of html, bytes_read (what was walked before the end, or an early one), early_ends, elements closed
    otherwise than by their end tag (implied, mismatched, eof), and ``matches_0``, ``matches_1``, ... for the queries.
    A query execution listener gets the same figures, also of streams.  Null html is a document of 0 bytes.  Failed and
    repeated tasks are not counted twice; a second action counts into its own observation only.
    """
    many = as_queries(queries)
    kept = kept_columns(df, html_col, keep, MATCH_FIELDS)
    fields = StructType.fromDDL(", ".join(f"{c} {k}" for c, k in MATCH_FIELDS.items())).fields
    n = len(_COUNTS) + len(many)
    schema = StructType([*(f for f in df.select(*kept).schema), *fields])
    for f in schema:  # rows of figures have no other column
        f.nullable = True
    schema.add("_figures", ArrayType(LongType()))
    names = schema.names
    selectors = [[s.selector for _, _, s in q.sections()] for q in many]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_queries(many)
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).cast(pa.binary())
            own = batch.select(list(range(batch.num_columns - 1)))
            rows: list[int] = []
            found: list[Match] = []
            figures = [0] * n
            held = 0
            for i in range(batch.num_rows):
                data = as_bytes(pages[i].as_py())
                sink = _Counting(program)
                walk = Walk(sink)
                early = walk.whole(data)
                some = finish(sink, data, program)
                for k, v in enumerate([1, len(data), walk.read, int(early), *(sink.closed[r] for r in RECOVERIES)]):
                    figures[k] += v
                for m in some:
                    figures[len(_COUNTS) + m.plan.query] += 1
                rows += [i] * len(some)
                found += some
                held += sum(len(m.inner_html or "") + len(m.text_content or "") for m in some)
                if found and (len(found) > 20_000 or held > 8_000_000 or i == batch.num_rows - 1):
                    columns = [*own.take(pa.array(rows, pa.int64())).columns, *match_arrays(found, selectors)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(found), pa.list_(pa.int64()))], names)
                    rows, found, held = [], [], 0
            if batch.num_rows:
                none = [pa.nulls(1, c.type) for c in own.columns] + [pa.nulls(1, a.type) for a in match_arrays([], selectors)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([figures], pa.list_(pa.int64()))], names)

    rows = df.select(*kept, html_col).mapInArrow(find, schema)
    wanted = [*_COUNTS, *(f"matches_{k}" for k in range(len(many)))]
    seen = rows.observe(observation, *[F.coalesce(F.sum(F.get("_figures", F.lit(k))), F.lit(0)).alias(name) for k, name in enumerate(wanted)])
    return seen.filter("_figures is null").drop("_figures")
