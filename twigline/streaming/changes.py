"""Changed matches of pages that are crawled again and again: keyed state that survives restarts."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from twigline.matcher import Program, compile_queries, find_matches
from twigline.query import Query, QueryBuilder, as_queries

CHANGE_DDL = "change string, selector string, name string, id string, class string, attributes string, text_content string, times int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_matches(html: str | bytes | None, program: Program, selectors: list[list[str]]) -> Counter:
    """How often each match occurs, whatever its place: as JSON of selector, name, id, class, attributes and text."""
    found = find_matches(html, program)
    return Counter(
        json.dumps([selectors[m.plan.query][m.plan.number], m.name, m.id, m.class_, m.attributes, m.text_content], ensure_ascii=False) for m in found
    )


def changed(before: Counter, now: Counter) -> Iterator[tuple]:
    """Rows of what is more, and of what is less, in a fixed order."""
    for change, more in (("added", now - before), ("removed", before - now)):
        for match, times in sorted(more.items()):
            selector, name, ident, cls, attributes, text = json.loads(match)
            yield change, selector, name, ident, cls, json.dumps(attributes, ensure_ascii=False), text, times


class _LastVersion(StatefulProcessor):
    """Keeps a page's matches of its last version, and forgets a page that was not seen for a while.

    Goes by plain rows: a page has a row or two, for which a data frame each would take longer than the matches.
    """

    def __init__(self, queries: list[Query], forget_ms: int, columns: list[str]) -> None:
        self.queries, self.forget_ms, self.columns = queries, forget_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = StructType().add("matches", StringType()).add("seen", LongType())
        self.last = handle.getValueState("last", kept)
        self.row = Row(*self.columns)
        self.program = compile_queries(self.queries)
        self.selectors = [[s.selector for _, _, s in q.sections()] for q in self.queries]

    def _due(self, seen: int) -> int:
        return seen // 1000 + self.forget_ms

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last = self.last.get()  # one call; None for a page not seen before
        before, seen = (Counter(json.loads(last[0])), last[1]) if last else (Counter(), None)
        known = seen
        for row in sorted(rows, key=lambda r: (r["us"], r["html"] is not None, r["html"])):
            us = row["us"]
            if seen is not None and us < seen:
                continue  # a late copy of an older version
            now = page_matches(row["html"], self.program, self.selectors)
            for change in changed(before, now):
                yield self.row(key[0], us, *change)
            before, seen = now, us
        if seen != known:
            if known is not None:
                self.handle.deleteTimer(self._due(known))
            self.handle.registerTimer(self._due(seen))
        self.last.update((json.dumps(before, ensure_ascii=False), seen))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changed_matches(
    stream: DataFrame,
    queries: Query | QueryBuilder | Iterable[Query | QueryBuilder],
    key: str = "page_id",
    time: str = "crawled",
    html_col: str = "html",
    late: str = "1 day",
    forget_days: float = 30.0,
) -> DataFrame:
    """(key, time, change, match, times): matches that a page's version has more or less often than the one before.

    ``key`` names a page and ``time``, a timestamp, its versions; null html has no matches, rows without a key or a time
    are no pages.  A version older than the last one seen is passed over, equal ones replace each other, and those more
    than ``late`` behind all others are dropped, as streams with a watermark do.  A page that was not seen for
    ``forget_days`` is forgotten, so that state does not grow for ever; when it comes again, all its matches are added.
    Append mode; the state store must be RocksDB (``use_rocksdb``).
    """
    rows = stream.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(html_col).alias("html"), F.unix_micros(time).alias("us"))
    rows = rows.filter("key is not null and time is not null")
    # times pass as microseconds, so that no time zone of a worker meets them
    schema = stream.select(F.col(key).alias("key")).schema.add("us", LongType())
    for f in StructType.fromDDL(CHANGE_DDL):
        schema = schema.add(f)
    processor = _LastVersion(as_queries(queries), int(forget_days * 86_400_000), schema.names)
    grouped = rows.withWatermark("time", late).groupBy("key")
    found = grouped.transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), *schema.names[2:])


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory, as stateful streams with timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what has arrived, append it to a Parquet folder, and stop; a later run goes on from the checkpoint."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
