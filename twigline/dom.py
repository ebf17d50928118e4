"""HTML text to interval-coded element rows, with tolerant recovery from errors.

``Walk`` passes over the UTF-8 bytes once, at once or part by part, and reports the tags to a sink: ``parse_html``
collects all elements, and ``twigline.matcher`` evaluates queries on the way.  Elements come in the order of their start tags; an element's subtree
is the run of rows from itself to ``last_id``.  Offsets count bytes.  Recursion-free, and linear in the tags however
deep they nest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed values of the language and of the recovery rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
IMPLIED = {
    "button": [("button",)], "li": [("li",)], "dt": [("dt", "dd")], "dd": [("dt", "dd")], "option": [("option",)],
    "optgroup": [("option",), ("optgroup",)], "tr": [("tr",)], "td": [("td", "th")], "th": [("td", "th")],
}
_DEFAULT = frozenset("applet marquee object table td th html template".split())
BARRIERS = {
    "default": _DEFAULT,
    "list": _DEFAULT | {"ol", "ul"},
    "button": _DEFAULT | {"button"},
    "table": frozenset(("html", "table", "template")),
}
SCOPES = {
    **dict.fromkeys(("li", "dt", "dd"), "list"), "button": "button",
    **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), "table"),
    **dict.fromkeys(("option", "optgroup"), "select"),
}

# groups: comment, end tag, start tag's name and attributes, the same of one with unbalanced quotes
_COMMENT, _END, _ATTRS, _ATTRS2 = 1, 2, 4, 6
_MARKUP = re.compile(
    rb"<(?:"
    rb"!--(.*?)(?:-->|\Z)"
    rb"|[!?][^>]*(?:>|\Z)"
    rb"|/([^>]*)(?:>|\Z)"
    rb"|([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rb"|([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    rb")",
    re.S,
)
_SCRIPT_END = re.compile(rb"</script", re.I)
_ATTRIBUTE = re.compile(
    rb"(?:\"([^\"]*)\"|'([^']*)'|([^\s=\"']+))(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)


@dataclass
class Dom:
    """Columns of a document's elements, and its text."""

    node_id: list[int] = field(default_factory=list)
    parent_id: list[int] = field(default_factory=list)
    prev_id: list[int] = field(default_factory=list)  # the sibling before, or -2
    last_id: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    id: list[str | None] = field(default_factory=list)
    class_: list[str | None] = field(default_factory=list)
    attributes: list[list[tuple[str, str | None]]] = field(default_factory=list)
    inner_start: list[int | None] = field(default_factory=list)
    inner_end: list[int | None] = field(default_factory=list)
    text_start: list[int | None] = field(default_factory=list)
    text_end: list[int | None] = field(default_factory=list)
    close_reason: list[str] = field(default_factory=list)
    text: bytes = b""
    events: list[tuple[str, str, int, int, str | None]] | None = None

    def __len__(self) -> int:
        return len(self.name)


def parse_attributes(raw: bytes) -> tuple[str | None, str | None, list[tuple[str, str | None]]]:
    """(id, class, others): the first valued id and class are set apart; a lone slash is dropped."""
    ident = cls = None
    out: list[tuple[str, str | None]] = []
    for m in _ATTRIBUTE.finditer(raw):
        word = m[3]
        key = word if word is not None else m[1] if m[1] is not None else m[2]
        value = None
        if m.lastindex > 3:
            value = m[m.lastindex].decode("utf-8", "replace")
        elif word is not None and word.endswith(b"/"):
            key = word[:-1]
            if not key:
                continue
        name = key.decode("utf-8", "replace")
        if value is not None and name == "id" and ident is None:
            ident = value
        elif value is not None and name == "class" and cls is None:
            cls = value
        else:
            out.append((name, value))
    return ident, cls, out


class Sink:
    """What a walk over a document reports to. ``open`` and ``close`` return True to end the walk there."""

    #: Runs of text, or None if nobody asks for them.
    text: list[bytes] | None = None

    def open(self, row: int, name: str, attributes: bytes | None, parent: int, depth: int, start: int, inner: int | None, size: int) -> bool:
        """A start tag at ``start``: ``inner`` is where its content starts (None for void elements), ``size`` the text so far."""
        raise NotImplementedError

    def close(self, row: int, depth: int, last: int, end: int, size: int, reason: str) -> bool:
        """The element's content ends at ``end``; ``last`` is the last row inside it."""
        raise NotImplementedError


class Walk:
    """A pass over a document that may come in parts, reporting its elements in the order of their tags.

    The open elements are also kept by name, so that no tag has to search them.  Between parts the walk keeps what is
    open and the bytes it has not read for good: markup that more bytes could change, and text up to the next markup.
    """

    def __init__(self, sink: Sink) -> None:
        self.sink = sink
        self.ended = False  # by the sink, or at the document's end
        self.size = 0  # bytes of text so far, with one space after each run
        self.read = 0  # bytes of a document at hand that were walked over
        self._stack: list[tuple[str, int]] = []  # lower-case name, row
        self._places: dict[str, list[int]] = {}  # levels of the open elements of each name
        self._known: dict[bytes, tuple[str, str]] = {}  # spellings of names met
        self._rows = 0
        self._raw = False  # inside a script
        self._held = bytearray()
        self._at = 0  # where in the held bytes the walk is
        self._scanned = 0  # there is no markup before it
        self._enough = 0  # held bytes that markup without an end is looked at again with
        self._before = 0  # bytes let go of

    def feed(self, part: bytes, keep: int | None = None) -> bool:
        """Walk on with a part; whether the walk has ended. Bytes from offset ``keep`` of the document on are held."""
        if self.ended:
            return True
        gone = min(self._at, self._at if keep is None else max(0, keep - self._before))
        del self._held[:gone]
        self._at, self._scanned, self._enough = self._at - gone, max(0, self._scanned - gone), self._enough - gone
        self._before += gone
        self._held += part
        if len(self._held) >= self._enough:
            self._at = self._run(self._held, self._at, False)
        return self.ended

    def finish(self) -> None:
        """The document has no more parts."""
        if not self.ended:
            self._run(self._held, self._at, True)
            self.ended = True

    def whole(self, data: bytes) -> bool:
        """Walk over a document at hand; whether the sink ended the walk."""
        self.read = self._run(data, 0, True)
        return self.ended

    def held(self, a: int, b: int) -> bytes:
        """Bytes of the document that are still held."""
        return bytes(self._held[a - self._before : b - self._before])

    def _find(self, wanted: tuple[str, ...], scope: str) -> int:
        """Level of the innermost open element with one of these names in scope, or -1."""
        places, stack = self._places, self._stack
        level = -1
        for name in wanted:
            open_ = places.get(name)
            if open_ and open_[-1] > level:
                level = open_[-1]
        if level < 0:
            return -1
        if scope == "select":
            for between in range(len(stack) - 1, level, -1):
                if stack[between][0] not in ("option", "optgroup"):
                    return -1
            return level
        for name in BARRIERS[scope]:
            open_ = places.get(name)
            if open_ and open_[-1] > level:
                return -1
        return level

    def _close(self, level: int, end: int, reason: str) -> bool:
        """Close the open elements from ``level`` on; the outermost for ``reason``, those inside it implicitly."""
        stack, places, closed = self._stack, self._places, self.sink.close
        while len(stack) > level:
            name, row = stack.pop()
            places[name].pop()
            why = "mismatched" if reason == "end_tag" and len(stack) > level else reason
            if closed(row, len(stack) + 1, self._rows - 1, end, self.size, why):
                self.ended = True
                return True
        return False

    def _text(self, run: bytes) -> None:
        run = bytes(run.strip())
        if run and (run[0] >= 128 or run[-1] >= 128):
            run = run.decode("utf-8", "replace").strip().encode("utf-8", "replace")
        if run:
            self.sink.text.append(run)
            self.size += len(run) + 1

    def _run(self, data: bytes, at: int, final: bool) -> int:
        """Walk from ``at`` as far as the bytes tell for good (``final``: to the end); where that is."""
        stack, places, known, before = self._stack, self._places, self._known, self._before
        texts, opened, search = self.sink.text is not None, self.sink.open, _MARKUP.search
        find, close, add_text = self._find, self._close, self._text
        n, scanned = len(data), self._scanned
        while at < n:
            if self._raw:
                stop = _SCRIPT_END.search(data, max(at, scanned))
                if stop is None and not final:
                    self._scanned = max(at, n - 7)
                    return at
                to = stop.start() if stop else n
                if texts:
                    add_text(data[at:to])
                at, scanned, self._raw = to, 0, False
                continue
            m = search(data, max(at, scanned))
            scanned = 0
            if not m:
                if not final:
                    self._scanned = n - 1 if data[n - 1] == 60 else n
                    return at
                if texts:
                    add_text(data[at:n])
                break
            start, kind = m.start(), m.lastindex
            if not final and kind != _ATTRS and (kind == _ATTRS2 or data[m.end() - 1] != 62 or kind == _COMMENT and m.end(_COMMENT) == m.end()):
                self._scanned, self._enough = start, 2 * n - start
                return at
            if texts and start > at:
                add_text(data[at:start])
            at = m.end()
            if kind == _END:
                raw = m[_END]
                names = known.get(raw)
                if names is None:
                    low = raw.decode("utf-8", "replace").strip().lower()
                    known[raw] = names = (low, low)
                low = names[1]
                if stack and stack[-1][0] == low:
                    level = len(stack) - 1
                elif places.get(low):
                    level = find((low,), SCOPES.get(low, "default"))
                else:
                    continue
                if level >= 0 and close(level, before + start, "end_tag"):
                    return at
                continue
            if kind == _ATTRS or kind == _ATTRS2:
                raw, attributes = m.group(kind - 1, kind)
            else:
                continue
            names = known.get(raw)
            if names is None:
                name = raw.decode("utf-8", "replace")
                known[raw] = names = (name, name.lower())
            name, low = names
            if low in CLOSES_P and places.get("p"):
                level = find(("p",), "default")
                if level >= 0 and close(level, before + start, "implied"):
                    return at
            if low in IMPLIED:
                for wanted in IMPLIED[low]:
                    level = find(wanted, SCOPES[low])
                    if level >= 0 and close(level, before + start, "implied"):
                        return at
            void = low in VOID
            row = self._rows
            if opened(row, name, attributes, stack[-1][1] if stack else -1, len(stack) + 1, before + start, None if void else before + at, self.size):
                self.ended = True
                return at
            self._rows = row + 1
            if void:
                continue
            open_ = places.get(low)
            if open_ is None:
                places[low] = [len(stack)]
            else:
                open_.append(len(stack))
            stack.append((low, row))
            self._raw = low == "script"
        self._scanned = 0
        if final:
            close(0, before + n, "eof")
        return n


def walk(data: bytes, sink: Sink) -> bool:
    """Report a document's elements in the order of their tags; whether the sink ended the walk."""
    return Walk(sink).whole(data)


class _DomSink(Sink):
    """Collects the elements with one of ``names`` (None: all)."""

    def __init__(self, dom: Dom, names: frozenset[str] | None = None) -> None:
        self.dom, self.names = dom, names
        self.text = []
        self.latest: dict[int, int] = {}  # the last child so far
        self.place: dict[int, int] = {}  # of open elements, in the columns

    def open(self, row: int, name: str, attributes: bytes | None, parent: int, depth: int, start: int, inner: int | None, size: int) -> bool:
        dom = self.dom
        before = self.latest.get(parent, -2)
        self.latest[parent] = row
        if self.names is not None and name not in self.names:
            return False
        if inner is not None:
            self.place[row] = len(dom.node_id)
        if attributes and not attributes.isspace():
            ident, cls, rest = parse_attributes(attributes)
        else:
            ident, cls, rest = None, None, []
        dom.node_id.append(row)
        dom.name.append(name)
        dom.id.append(ident)
        dom.class_.append(cls)
        dom.attributes.append(rest)
        dom.parent_id.append(parent)
        dom.prev_id.append(before)
        dom.depth.append(depth)
        dom.last_id.append(row)
        dom.inner_start.append(inner)
        dom.inner_end.append(None)
        dom.text_start.append(None if inner is None else size)
        dom.text_end.append(None)
        dom.close_reason.append("void" if inner is None else "")
        if dom.events is not None:
            dom.events.append(("OpenTag", name, depth, start, None))
        return False

    def close(self, row: int, depth: int, last: int, end: int, size: int, reason: str) -> bool:
        at = self.place.pop(row, None)
        if at is None:
            return False
        dom = self.dom
        dom.last_id[at] = last
        dom.inner_end[at] = end
        if size > dom.text_start[at]:
            dom.text_end[at] = size - 1
        else:
            dom.text_start[at] = None
        dom.close_reason[at] = reason
        if dom.events is not None:
            dom.events.append(("CloseTag" if reason == "end_tag" else "ImpliedClose", dom.name[at], depth, end, reason))
        return False


def as_bytes(html: str | bytes | None) -> bytes:
    return html if isinstance(html, bytes) else (html or "").encode("utf-8", "surrogatepass")


def parse_html(html: str | bytes | None, trace: bool = False, names: frozenset[str] | None = None) -> Dom:
    """All elements of a document, or those with one of ``names``. None gives none."""
    dom = Dom(events=[] if trace else None)
    sink = _DomSink(dom, names)
    walk(as_bytes(html), sink)
    dom.text = b" ".join(sink.text)
    return dom
