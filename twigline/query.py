"""Query trees: selectors with what to keep of their matches and selectors to run inside each match."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from twigline.selector import Step, parse_selectors


@dataclass(frozen=True)
class Save:
    """Which content of a match is kept besides name, id, class and attributes."""

    inner_html: bool = False
    text_content: bool = False

    @classmethod
    def all(cls) -> Save:
        return cls(True, True)

    @classmethod
    def none(cls) -> Save:
        return cls(False, False)

    @classmethod
    def only_inner_html(cls) -> Save:
        return cls(True, False)

    @classmethod
    def only_text_content(cls) -> Save:
        return cls(False, True)


@dataclass(frozen=True)
class Section:
    """One selector of a query; children are evaluated inside each of its matches.

    ``conditions`` are (wanted, section): a match counts only if it holds a match of each wanted one and none of the
    others.
    """

    selector: str
    alternatives: tuple[tuple[Step, ...], ...]
    first: bool
    save: Save
    children: tuple[Section, ...] = ()
    conditions: tuple[tuple[bool, Section], ...] = ()

    def __post_init__(self) -> None:
        names = [c.selector for c in self.children]
        if len(set(names)) < len(names):
            raise ValueError(f"the same selector twice inside {self.selector!r}")


@dataclass(frozen=True)
class Query:
    """A built query. ``Query.all`` and ``Query.first`` start a builder."""

    root: Section

    @staticmethod
    def all(selector: str, save: Save | None = None) -> QueryBuilder:
        return QueryBuilder(_section(selector, False, save))

    @staticmethod
    def first(selector: str, save: Save | None = None) -> QueryBuilder:
        return QueryBuilder(_section(selector, True, save))

    def sections(self) -> list[tuple[int, int, Section]]:
        """(number, parent's number or -1, section) of all sections, parents before children."""
        out: list[tuple[int, int, Section]] = []

        def walk(section: Section, parent: int) -> None:
            number = len(out)
            out.append((number, parent, section))
            for c in section.children:
                walk(c, number)

        walk(self.root, -1)
        return out

    def spec(self) -> dict:
        return _to_spec(self.root)


def _section(selector: str, first: bool, save: Save | None) -> Section:
    return Section(selector, parse_selectors(selector), first, save or Save.none())


class QueryFactory:
    """Handed to ``then``: starts child builders."""

    def all(self, selector: str, save: Save | None = None) -> QueryBuilder:
        return Query.all(selector, save)

    def first(self, selector: str, save: Save | None = None) -> QueryBuilder:
        return Query.first(selector, save)


class QueryBuilder:
    """``all`` and ``first`` add a child of the section added last; ``then`` adds several to it. Immutable."""

    def __init__(self, root: Section, last: tuple[int, ...] = ()) -> None:
        self._root = root
        self._last = last  # way from the root to the section added last

    def _change(self, change: Callable[[Section], Section]) -> Section:
        """The root, with the section added last changed."""

        def put(at: Section, way: tuple[int, ...]) -> Section:
            if not way:
                return change(at)
            return replace(at, children=(*at.children[: way[0]], put(at.children[way[0]], way[1:]), *at.children[way[0] + 1 :]))

        return put(self._root, self._last)

    def _append(self, sections: Iterable[Section], move: bool) -> QueryBuilder:
        new, place = tuple(sections), 0

        def add(at: Section) -> Section:
            nonlocal place
            place = len(at.children)
            return replace(at, children=at.children + new)

        root = self._change(add)
        return QueryBuilder(root, (*self._last, place) if move else self._last)

    def having(self, selector: str) -> QueryBuilder:
        """Keep only those matches of the section added last that hold a match of ``selector``."""
        return self._if(True, selector)

    def without(self, selector: str) -> QueryBuilder:
        """Keep only those matches of the section added last that hold no match of ``selector``."""
        return self._if(False, selector)

    def _if(self, wanted: bool, selector: str) -> QueryBuilder:
        condition = (wanted, _section(selector, True, None))
        return QueryBuilder(self._change(lambda s: replace(s, conditions=(*s.conditions, condition))), self._last)

    def all(self, selector: str, save: Save | None = None) -> QueryBuilder:
        return self._append([_section(selector, False, save)], True)

    def first(self, selector: str, save: Save | None = None) -> QueryBuilder:
        return self._append([_section(selector, True, save)], True)

    def then(self, callback: Callable[[QueryFactory], Iterable[QueryBuilder]]) -> QueryBuilder:
        made = callback(QueryFactory())
        builders = [made] if isinstance(made, QueryBuilder) else list(made)
        return self._append([b._root for b in builders], False)

    def append(self, other: QueryBuilder) -> QueryBuilder:
        return self._append([other._root], False)

    def __len__(self) -> int:
        return len(Query(self._root).sections())

    def build(self) -> Query:
        return Query(self._root)

    try_build = build


_SAVES = {
    "all": Save.all(), "none": Save.none(), "inner_html": Save.only_inner_html(), "text_content": Save.only_text_content(),
}


def query(spec: dict | str) -> Query:
    """From a declarative spec (dict or JSON): ``{"all": selector, "save": "all", "then": [...]}`` or with "first".

    ``"having"`` and ``"without"`` are lists of selectors that a match must, or must not, hold.
    """
    return Query(_from_spec(json.loads(spec) if isinstance(spec, str) else spec))


def _from_spec(spec: dict) -> Section:
    kinds = [k for k in ("all", "first") if k in spec]
    unknown = set(spec) - {"all", "first", "save", "then", "having", "without"}
    if len(kinds) != 1 or unknown:
        raise ValueError(f"a query spec needs one of all and first, and may have save, then, having and without: {spec}")
    save = spec.get("save", "none")
    if isinstance(save, dict):
        save = Save(bool(save.get("inner_html")), bool(save.get("text_content")))
    elif not isinstance(save, Save):
        if save not in _SAVES:
            raise ValueError(f"unknown save {save!r}")
        save = _SAVES[save]
    section = _section(spec[kinds[0]], kinds[0] == "first", save)
    conditions = tuple((kind == "having", _section(c, True, None)) for kind in ("having", "without") for c in spec.get(kind, ()))
    return replace(section, children=tuple(_from_spec(s) for s in spec.get("then", ())), conditions=conditions)


def _to_spec(s: Section) -> dict:
    save = next(k for k, v in _SAVES.items() if v == s.save)
    out: dict = {"first" if s.first else "all": s.selector, "save": save}
    for kind, wanted in (("having", True), ("without", False)):
        if some := [c.selector for w, c in s.conditions if w == wanted]:
            out[kind] = some
    if s.children:
        out["then"] = [_to_spec(c) for c in s.children]
    return out


def as_queries(queries: Query | QueryBuilder | Iterable[Query | QueryBuilder]) -> list[Query]:
    """A list of built queries; an empty one, or the same root selector twice, is an error."""
    many = [queries] if isinstance(queries, (Query, QueryBuilder)) else list(queries)
    built = [q.build() if isinstance(q, QueryBuilder) else q for q in many]
    if not built:
        raise ValueError("at least one query is needed")
    names = [q.root.selector for q in built]
    if len(set(names)) < len(names):
        raise ValueError("the same root selector twice")
    return built
