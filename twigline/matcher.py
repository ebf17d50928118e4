"""Evaluation of queries while a document is parsed: one pass, linear in its tags, and no further than needed.

The sections of a query inside one enclosing match are a scope, and their selectors a tree of steps that begins alike
where they do.  What waits is a scope with a level of that tree: for the children and later siblings at each open
element, for descendants in lists by tag name, to which an element adds on opening and from which it takes on closing.
Within a level, steps are found by name, id and class, so a tag meets only steps that can fit it, however many queries
wait.  A tag that passes a section's last step is a match, and opens a scope for the sections inside it.  The walk ends
as soon as no scope can find more and the content of all matches is complete.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from twigline.dom import Sink, as_bytes, parse_attributes, walk
from twigline.query import Query, Section
from twigline.selector import CHILD, DESCENDANT, LATER, NEXT, AttributeTest, Compound

#: A level that waits for descendants of more names than this goes to one list, that of ``ANY_NAME``.
FEW_NAMES, ANY_NAME = 8, "*"
Attributes = tuple[str | None, str | None, list[tuple[str, str | None]]]


def attribute_matches(test: AttributeTest, value: str | None) -> bool:
    kind, needle = test.effective, test.value
    if kind == "presence":
        return True
    if value is None:
        return False
    if kind == "exact":
        return value == needle
    if kind == "word":
        return needle in value.split()
    if kind == "hyphen":
        return bool(needle) and any(w == needle or w.startswith(needle + "-") for w in value.split())
    if kind == "prefix":
        return value.startswith(needle)
    if kind == "suffix":
        return value.endswith(needle)
    return needle in value


def fits(c: Compound, attributes: Attributes) -> bool:
    """Whether id, classes and attribute tests hold; the name is looked at elsewhere."""
    ident, cls, rest = attributes
    if c.id is not None and ident != c.id:
        return False
    if c.classes and not set(c.classes) <= set((cls or "").split()):
        return False
    for t in c.attributes:
        if not (
            any(k == t.key and attribute_matches(t, v) for k, v in rest)
            or (t.key == "id" and ident is not None and attribute_matches(t, ident))
            or (t.key == "class" and cls is not None and attribute_matches(t, cls))
        ):
            return False
    return True


class _Step:
    """A step of one or more sections' selectors, and the level of those that follow it."""

    __slots__ = ("compound", "ends", "following", "plans", "tests")

    def __init__(self, compound: Compound) -> None:
        self.compound = compound
        self.tests = compound.id is not None or bool(compound.classes or compound.attributes)
        self.following: _Level | None = None
        self.ends: list[_Plan] = []  # sections whose selector ends here
        self.plans: list[_Plan] = []  # sections that this step serves


class _Bucket:
    """Steps of one name: those without tests, and the others by id, by class, by an attribute's value, or by none."""

    __slots__ = ("classes", "ids", "other", "plain", "tested", "values")

    def __init__(self) -> None:
        self.plain: list[_Step] = []
        self.other: list[_Step] = []
        self.ids: dict[str, list[_Step]] = {}
        self.classes: dict[str, list[_Step]] = {}
        self.values: dict[tuple[str, str | None], list[_Step]] = {}
        self.tested = False

    def add(self, step: _Step) -> None:
        c = step.compound
        self.tested |= step.tests
        exact = [(t.key, t.value) for t in c.attributes if t.effective == "exact" and t.key not in ("id", "class")]
        if c.id is not None:
            self.ids.setdefault(c.id, []).append(step)
        elif c.classes:
            self.classes.setdefault(c.classes[0], []).append(step)
        elif exact:
            self.values.setdefault(exact[0], []).append(step)
        else:
            (self.other if step.tests else self.plain).append(step)

    def fitting(self, attributes: Attributes) -> Iterator[_Step]:
        """The steps with tests that an element's attributes pass."""
        ident, cls, rest = attributes
        yield from (s for s in self.other if fits(s.compound, attributes))
        if self.ids and ident is not None:
            yield from (s for s in self.ids.get(ident, ()) if fits(s.compound, attributes))
        if self.classes and cls:
            for word in dict.fromkeys(cls.split()):
                yield from (s for s in self.classes.get(word, ()) if fits(s.compound, attributes))
        if self.values:
            for pair in dict.fromkeys(rest):
                yield from (s for s in self.values.get(pair, ()) if fits(s.compound, attributes))


class _Level:
    """Steps that wait together: the first ones of a group of sections, or those that may follow a step.

    Sections whose selectors begin alike share their steps.  By combinator, and there by name (None: any).
    """

    __slots__ = ("by", "steps", "wait_for")

    def __init__(self) -> None:
        self.steps: dict[tuple[str, Compound], _Step] = {}
        self.by: dict[str, dict[str | None, _Bucket]] = {}
        self.wait_for: list[str | None] = []  # lists of waiting descendants that it goes to

    def step(self, combinator: str, compound: Compound) -> _Step:
        found = self.steps.get((combinator, compound))
        if found is None:
            self.steps[combinator, compound] = found = _Step(compound)
            self.by.setdefault(combinator, {}).setdefault(compound.name, _Bucket()).add(found)
            names = self.by.get(DESCENDANT, {})
            self.wait_for = list(names) if len(names) <= FEW_NAMES else [ANY_NAME]
        return found


def _level(plans: list[_Plan]) -> _Level | None:
    """The first steps of some sections, with all that follow."""
    top = _Level()
    for plan in plans:
        for steps in plan.alternatives:
            at = top
            for n, s in enumerate(steps):
                step = at.step(s.combinator, s.compound)
                if plan not in step.plans:
                    step.plans.append(plan)
                if n == len(steps) - 1:
                    step.ends.append(plan)
                else:
                    if step.following is None:
                        step.following = _Level()
                    at = step.following
    return top if plans else None


class _Plan:
    """A compiled section. ``condition`` is its place among its parent's conditions, or None."""

    __slots__ = ("alternatives", "children", "condition", "first", "inner", "inside", "level", "number", "parent", "query", "text", "wanted")

    def __init__(self, section: Section, query: int, numbers: dict[int, int], parent: _Plan | None = None, condition: int | None = None) -> None:
        self.alternatives, self.first, self.query, self.number = section.alternatives, section.first, query, numbers.get(id(section), -1)
        self.inner, self.text = section.save.inner_html, section.save.text_content
        self.parent, self.condition = parent, condition
        self.children = [_Plan(c, query, numbers, self) for c in section.children]
        self.wanted = [w for w, _ in section.conditions]
        self.inside = self.children + [_Plan(c, query, numbers, self, n) for n, (_, c) in enumerate(section.conditions)]
        self.level = _level(self.inside)

    def saves_text(self) -> bool:
        return self.text or any(c.saves_text() for c in self.children)

    def has_conditions(self) -> bool:
        return bool(self.wanted) or any(c.has_conditions() for c in self.children)


class Program:
    """Compiled queries, for any number of documents."""

    def __init__(self, queries: list[Query]) -> None:
        self.plans = [_Plan(q.root, k, {id(s): n for n, _, s in q.sections()}) for k, q in enumerate(queries)]
        self.level = _level(self.plans)
        self.saves_text = any(p.saves_text() for p in self.plans)
        self.conditions = any(p.has_conditions() for p in self.plans)


def compile_queries(queries: Iterable[Query]) -> Program:
    return Program(list(queries))


class _Scope:
    """A group of sections that are evaluated inside one match (or the document)."""

    __slots__ = ("done", "left", "level", "met", "path", "plans")

    def __init__(self, plans: list[_Plan], level: _Level, path: tuple[int, ...]) -> None:
        self.plans, self.level, self.path = plans, level, path
        self.left = len(plans)  # sections that may find more
        self.done: set[_Plan] = set()
        self.met: set[int] = set()  # conditions


class Match:
    """A match; content is cut out of the document when the walk is over."""

    __slots__ = (
        "attributes", "class_", "depth", "id", "inner_end", "inner_html", "inner_start", "name", "path", "plan", "scope", "text_content",
        "text_end", "text_start",
    )

    def __init__(self, plan: _Plan, path: tuple[int, ...], name: str, attributes: Attributes, depth: int) -> None:
        self.plan, self.path, self.name, self.depth = plan, path, name, depth
        self.id, self.class_, self.attributes = attributes
        self.inner_start = self.inner_end = self.text_start = self.text_end = None
        self.inner_html = self.text_content = None
        self.scope: _Scope | None = None  # of the sections inside it

    def holds(self) -> bool:
        """Whether it meets its section's conditions."""
        met = self.scope.met if self.scope else ()
        return all(wanted == (n in met) for n, wanted in enumerate(self.plan.wanted))


class _Frame:
    """What waits at an open element: (scope, level) pairs, by combinator, and those it adds to the waiting descendants."""

    __slots__ = ("added", "child", "later", "next", "scope")

    def __init__(self) -> None:
        self.child: list[tuple[_Scope, _Level]] = []
        self.next: list[tuple[_Scope, _Level]] = []
        self.later: list[tuple[_Scope, _Level]] = []
        self.added: list[tuple[_Scope, _Level]] = []
        self.scope: list[_Scope] = []


_NO_ATTRIBUTES: Attributes = (None, None, [])
_BARE = _Frame()  # of all elements at which nothing waits; never changed


class Matcher(Sink):
    """One document's evaluation. ``trace`` gets (event, tag, depth, position, detail)."""

    def __init__(self, program: Program, trace: list | None = None) -> None:
        self.matches: list[Match] = []
        self.text = [] if program.saves_text else None
        self.trace = trace
        self.live = 0  # sections of open scopes that may find more
        self.waiting: dict[int, list[Match]] = {}  # matches with content to come, by row
        self.names: dict[int, str] = {}
        self.below: dict[str | None, list[tuple[_Scope, _Level]]] = {}  # what waits for descendants, by name
        self.held: dict[tuple[_Scope, _Level], None] = {}  # the same, each once, in their order
        self.frames: list[_Frame] = [_Frame()]
        self._enter(self.frames[0], _Scope(program.plans, program.level, ()), "", 0, 0)

    def _enter(self, frame: _Frame, scope: _Scope, name: str, depth: int, at: int) -> None:
        """A scope of the innermost open element."""
        self.live += scope.left
        frame.scope.append(scope)
        self._wait(frame, scope, scope.level)
        if self.trace is not None:
            self.trace += [("ScopedCursorCreated", name, depth, at, _label(p)) for p in scope.plans]

    def _wait(self, frame: _Frame, scope: _Scope, level: _Level) -> None:
        pair = (scope, level)
        if CHILD in level.by:
            frame.child.append(pair)
        if DESCENDANT in level.by and pair not in self.held:
            self.held[pair] = None
            frame.added.append(pair)
            for name in level.wait_for:
                self.below.setdefault(name, []).append(pair)

    def _candidates(self, frame: _Frame, name: str) -> list[tuple[_Scope, dict[str | None, _Bucket]]]:
        """(scope, buckets) of all that waits for a tag of this name in an element with this frame."""
        found = [(pair[0], pair[1].by[CHILD]) for pair in frame.child]
        if self.trace is not None:
            found += [(s, level.by[DESCENDANT]) for s, level in self.held]
        for key in (name, None, ANY_NAME) if self.trace is None else ():
            pairs = self.below.get(key)
            if pairs:
                if any(not s.left for s, _ in pairs):  # those that found all they can are met once
                    self.below[key] = pairs = [p for p in pairs if p[0].left]
                if key == ANY_NAME:
                    found += [(s, level.by[DESCENDANT]) for s, level in pairs]
                else:
                    found += [(s, {key: level.by[DESCENDANT][key]}) for s, level in pairs]
        if frame.next:
            found += [(s, level.by[NEXT]) for s, level in frame.next]
            frame.next = []
        if frame.later:
            found += [(s, level.by[LATER]) for s, level in frame.later]
        return found

    def open(self, row: int, name: str, attributes: bytes | None, parent: int, depth: int, start: int, inner: int | None, size: int) -> bool:
        around = self.frames[-1]
        trace = self.trace
        if trace is not None:
            trace.append(("OpenTag", name, depth, start, None))
            self.names[row] = name
        elif around is _BARE and not (self.below.get(name) or self.below.get(None) or self.below.get(ANY_NAME)):
            if inner is not None:
                self.frames.append(_BARE)
            return False
        parsed = None
        hits: list[tuple[_Scope, _Step]] = []
        told: set[tuple[_Scope, _Plan]] = set()
        for scope, buckets in self._candidates(around, name):
            if not scope.left:
                continue
            for key in (name, None):
                bucket = buckets.get(key)
                if bucket is None:
                    continue
                hits += [(scope, s) for s in bucket.plain]
                if bucket.tested:
                    if parsed is None:
                        parsed = parse_attributes(attributes) if attributes and not attributes.isspace() else _NO_ATTRIBUTES
                    hits += [(scope, s) for s in bucket.fitting(parsed)]
            if trace is not None:
                self._trace_steps(scope, buckets, hits, told, name, depth, start)
        if not hits:
            if inner is not None:
                self.frames.append(_BARE)
            return False
        frame = _Frame()
        found: list[Match] = []
        ended: set[tuple[_Scope, _Plan]] = set()
        for scope, step in hits:
            for plan in step.ends:
                if plan in scope.done or (scope, plan) in ended:
                    continue
                ended.add((scope, plan))
                if plan.condition is not None:
                    scope.met.add(plan.condition)
                else:
                    if parsed is None:
                        parsed = parse_attributes(attributes) if attributes and not attributes.isspace() else _NO_ATTRIBUTES
                    match = Match(plan, (*scope.path, row), name, parsed, depth)
                    found.append(match)
                    if trace is not None:
                        trace.append(("ElementSaved", name, depth, start, _label(plan)))
                if plan.first and not plan.wanted:  # a match with conditions may still fall away
                    scope.done.add(plan)
                    scope.left -= 1
                    self.live -= 1
            following = step.following
            if following is not None:
                self._wait(frame, scope, following)
                if NEXT in following.by or LATER in following.by:
                    if around is _BARE:
                        self.frames[-1] = around = _Frame()
                    pair = (scope, following)
                    if NEXT in following.by:
                        around.next.append(pair)
                    if LATER in following.by and pair not in around.later:
                        around.later.append(pair)
        self.matches += found
        if inner is None:
            self._leave(frame)
            return bool(ended) and not self.live and not self.waiting and self._exit(name, depth, start)
        self.frames.append(frame)
        if found:
            kept = [m for m in found if m.plan.inner or m.plan.text]
            for m in kept:
                m.inner_start, m.text_start = inner, size
            if kept:
                self.waiting[row] = kept
            for m in found:
                if m.plan.level is not None:
                    m.scope = _Scope(m.plan.inside, m.plan.level, m.path)
                    self._enter(frame, m.scope, name, depth, start)
        return bool(ended) and not self.live and not self.waiting and self._exit(name, depth, start)

    def _leave(self, frame: _Frame) -> None:
        """Nothing waits any more for what waited at a closed element."""
        for pair in reversed(frame.added):
            del self.held[pair]
            for name in pair[1].wait_for:
                pairs = self.below[name]
                if pairs and pairs[-1] == pair:
                    pairs.pop()

    def close(self, row: int, depth: int, last: int, end: int, size: int, reason: str) -> bool:
        frame = self.frames.pop()
        trace = self.trace
        if trace is not None:
            name = self.names.pop(row)
            trace.append(("CloseTag" if reason == "end_tag" else "ImpliedClose", name, depth, end, reason))
        if frame is not _BARE:
            self._leave(frame)
            for s in frame.scope:
                self.live -= s.left
                s.left = 0
                if trace is not None:
                    trace += [("ScopedCursorPruned", name, depth, end, _label(p)) for p in s.plans]
        kept = self.waiting.pop(row, None) if self.waiting else None
        if kept:
            for m in kept:
                m.inner_end, m.text_end = end, size - 1
                if trace is not None:
                    trace.append(("ContentFinalized", name, depth, end, _label(m.plan)))
        if (frame.scope or kept) and not self.live and not self.waiting:
            return self._exit("", depth, end)
        return False

    def _exit(self, name: str, depth: int, at: int) -> bool:
        if self.trace is not None:
            self.trace.append(("EarlyExit", name, depth, at, None))
        return True

    def _trace_steps(self, scope: _Scope, buckets: dict, hits: list, told: set, name: str, depth: int, at: int) -> None:
        """An event for every section whose step waited here, whether the tag fits it or not; none once it is done."""
        fit = {s for owner, s in hits if owner is scope}
        for bucket in buckets.values():
            for step in [*bucket.plain, *bucket.other, *(s for some in (bucket.ids, bucket.classes, bucket.values) for x in some.values() for s in x)]:
                for p in step.plans:
                    if p not in scope.done and (scope, p) not in told:
                        self.trace.append(("TransitionMatched" if step in fit else "TransitionRejected", name, depth, at, _label(p)))
                    if step in fit and p.first and p in step.ends:
                        told.add((scope, p))


def _label(plan: _Plan) -> str:
    return f"{plan.query}.{plan.number}"


def holding(matches: list[Match]) -> list[Match]:
    """Matches that meet their conditions, inside matches that do; of a ``first`` section the first of them."""
    kept: set[tuple] = set()
    taken: set[tuple] = set()
    out = []
    for m in matches:
        plan, around = m.plan, m.path[:-1]
        if not m.holds() or plan.parent is not None and (plan.query, plan.parent.number, around) not in kept:
            continue
        if plan.first:
            if (plan.query, plan.number, around) in taken:
                continue
            taken.add((plan.query, plan.number, around))
        kept.add((plan.query, plan.number, m.path))
        out.append(m)
    return out


def finish(sink: Matcher, data: bytes, program: Program) -> list[Match]:
    """The matches of a walk that is over, with their contents."""
    text = b" ".join(sink.text) if sink.text else b""
    matches = holding(sink.matches) if program.conditions else sink.matches
    for m in matches:
        if m.inner_start is None:
            continue
        if m.plan.inner:
            m.inner_html = data[m.inner_start : m.inner_end].decode("utf-8", "replace")
        if m.plan.text and m.text_end >= m.text_start:
            m.text_content = text[m.text_start : m.text_end].decode("utf-8", "replace")
    return matches


def find_matches(html: str | bytes | None, program: Program, trace: list | None = None) -> list[Match]:
    """All matches of compiled queries, in the order of their start tags; enclosing matches come before inner ones."""
    data = as_bytes(html)
    if trace is not None:
        trace.append(("ParseStarted", None, 0, 0, None))
    sink = Matcher(program, trace)
    walk(data, sink)
    if trace is not None:
        trace.append(("ParseFinished", None, 0, len(data), None))
    return finish(sink, data, program)
