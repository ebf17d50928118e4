"""Documents that lie in a table as ordered parts: evaluated without ever being one value."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from twigline.matcher import Match, compile_queries
from twigline.operators.extract import MATCH_FIELDS, match_arrays
from twigline.query import Query, QueryBuilder, as_queries
from twigline.stepping import Stepper


def extract_parts(
    df: DataFrame,
    queries: Query | QueryBuilder | Iterable[Query | QueryBuilder],
    document: list[str],
    order: list[str],
    part_col: str = "part",
) -> DataFrame:
    """One row per match, with the document's columns, as ``extract`` gives for the whole documents.

    A document is the rows that agree in the columns ``document`` (nulls agree), its parts are text or UTF-8 bytes cut
    anywhere, in the order of the columns ``order`` (equal ones: of the parts themselves).  A null part is an empty one.
    One shuffle brings the parts of a document together, sorted; they are fed to the evaluation one by one, and no more
    of them once nothing can match.  What is kept meanwhile is what is open and the content of incomplete matches.
    """
    many = as_queries(queries)
    clash = sorted(set(document) & set(MATCH_FIELDS))
    if clash:
        raise ValueError(f"document columns named as a match's: {clash}; rename them")
    schema = df.select(*document).schema
    for f in StructType.fromDDL(", ".join(f"{c} {k}" for c, k in MATCH_FIELDS.items())):
        schema = schema.add(f)
    names, keys = schema.names, len(document)
    selectors = [[s.selector for _, _, s in q.sections()] for q in many]
    rows = df.select(*document, *[c for c in order if c not in document], part_col)
    rows = rows.repartition(*document).sortWithinPartitions(*document, *order, part_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compile_queries(many)
        now, stepper = None, None
        owners: list[pa.RecordBatch] = []
        found: list[Match] = []
        held = 0

        def taken(some: list[Match], own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal held
            found.extend(some)
            owners.extend([own] * len(some))
            held += sum(len(m.inner_html or "") + len(m.text_content or "") for m in some)
            if len(found) > 10_000 or held > 8_000_000:
                yield flushed()

        def flushed() -> pa.RecordBatch:
            nonlocal held
            kept = pa.Table.from_batches(owners).combine_chunks().columns
            out = pa.RecordBatch.from_arrays([*(c.chunk(0) for c in kept), *match_arrays(found, selectors)], names)
            found.clear()
            owners.clear()
            held = 0
            return out

        own = None
        for batch in batches:
            parts = batch.column(batch.num_columns - 1).cast(pa.binary())
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
            for i, key in enumerate(ids):
                if stepper is None or key != now:
                    if stepper is not None:
                        yield from taken(stepper.finish(), own)
                    now, stepper = key, Stepper(program)
                    own = batch.slice(i, 1).select(list(range(keys)))
                if not stepper.ended:
                    yield from taken(stepper.feed(parts[i].as_py()), own)
        if stepper is not None:
            yield from taken(stepper.finish(), own)
        if found:
            yield flushed()

    return rows.mapInArrow(find, schema)
