"""Documents that come in parts: the same queries, evaluated step by step, and stopped from outside at any time.

Between parts only what is open is kept: elements and what waits in them, markup without an end, and the content of
matches that are not complete.
"""

from __future__ import annotations

from collections.abc import Iterable

from twigline.dom import Walk, as_bytes
from twigline.matcher import Match, Matcher, Program, compile_queries, holding
from twigline.query import Query, QueryBuilder, as_queries


class _Text:
    """Runs of text, from an offset on."""

    def __init__(self) -> None:
        self.start, self.runs = 0, bytearray()

    def append(self, run: bytes) -> None:
        self.runs += run
        self.runs += b" "

    def cut(self, a: int, b: int) -> str:
        return self.runs[a - self.start : b - self.start].decode("utf-8", "replace")

    def drop(self) -> None:
        self.start += len(self.runs)
        self.runs.clear()


class _Cutter(Matcher):
    """Cuts a match's content as soon as it is complete."""

    def __init__(self, program: Program) -> None:
        super().__init__(program)
        self.program, self.complete = program, []
        if self.text is not None:
            self.text = _Text()
        self.walk = Walk(self)

    def open(self, row: int, name: str, attributes: bytes | None, parent: int, depth: int, start: int, inner: int | None, size: int) -> bool:
        known = len(self.matches)
        ended = super().open(row, name, attributes, parent, depth, start, inner, size)
        self.complete += [m for m in self.matches[known:] if m.inner_start is None]
        return ended

    def close(self, row: int, depth: int, last: int, end: int, size: int, reason: str) -> bool:
        kept = self.waiting.get(row, ())
        ended = super().close(row, depth, last, end, size, reason)
        for m in kept:
            if m.plan.inner:
                m.inner_html = self.walk.held(m.inner_start, end).decode("utf-8", "replace")
            if m.plan.text and m.text_end >= m.text_start:
                m.text_content = self.text.cut(m.text_start, m.text_end)
        self.complete += kept
        return ended


class Stepper:
    """One document's evaluation: ``feed`` its parts, ``finish``; each gives the matches that have become complete.

    Matches of queries with conditions come when the document is finished.  ``ended`` tells that nothing more can match;
    to stop before that, stop feeding.
    """

    def __init__(self, queries: Query | QueryBuilder | Iterable[Query | QueryBuilder] | Program) -> None:
        self._sink = _Cutter(queries if isinstance(queries, Program) else compile_queries(as_queries(queries)))

    @property
    def ended(self) -> bool:
        return self._sink.walk.ended

    def feed(self, part: str | bytes | None) -> list[Match]:
        sink = self._sink
        if not sink.waiting and sink.text is not None:
            sink.text.drop()
        starts = [m.inner_start for some in sink.waiting.values() for m in some if m.plan.inner]
        if part:
            sink.walk.feed(as_bytes(part), min(starts, default=None))
        return self._taken(False)

    def finish(self) -> list[Match]:
        self._sink.walk.finish()
        return self._taken(True)

    def _taken(self, last: bool) -> list[Match]:
        sink = self._sink
        if sink.program.conditions:
            return holding(sink.matches) if last else []
        out, sink.complete = sink.complete, []
        sink.matches.clear()
        return out
