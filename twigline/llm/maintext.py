"""Main text of web pages by line-block distribution (operator 7).

Markup is stripped into lines, one for each block of the page, each with the length of its text outside links; page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers) has length 0.  Over these
lengths a window of ``WINDOW`` lines slides.  A stretch of lines starts where the window's sum rises above zero and
ends where it falls back to zero; it surges if the sum reaches ``SURGE`` in it.

The surging text decides: it picks the main block (the innermost that holds over half of it), and text outside that
block is kept where it surges itself, so short lines cut off from the story go.  ``article`` and ``main`` are hints:
text in them weighs ``ARTICLE_WEIGHT`` times, and if it outweighs the rest, the main text is what lies in them.  The
distribution cuts there too: where the lengths fall to zero for a whole window, over lines that are nothing but links,
those lines are a menu and go; headings stay and end such a run.

Names that usually mean lists of links (``related``, ``share``) don't decide alone: a block so named is furniture unless
its text surges with few links in it.  One named as a head (``banner``) is none if it holds the page's only ``h1``.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters outside links in a window that make a surge, or the page's most if no window has so many.
SURGE = 80
ARTICLE_WEIGHT = 4
#: Text in links up to this share of a block's text is a story's; a list of links has more.
LINK_SHARE = 0.25
#: How sure a block is to be furniture: not, by what it is or is named, if its text is links, if it is no headline.
NONE, SURE, IF_LINKS, IF_NO_HEADLINE = 0, 1, 2, 3
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# Element classes of HTML: fixed names of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
IMPLIED_SCOPE = ("ul", "ol", "dl", "table", "select", "div", "section", "article")
IN_PARAGRAPH = frozenset("option caption legend summary td th tr tbody thead tfoot".split())
PARAGRAPH_SCOPE = ("td", "th", "table")

FURNITURE = frozenset(
    "head nav footer aside form header menu select button dialog object canvas audio video map datalist fieldset search".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar "
    "comment comments disqus reply replies respond notice notices alert cookie cookies consent gdpr menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead header share sharing social related recommended newsletter "
    "subscribe subscription signup login popup modal overlay widget toolbar pagination pager disclaimer skip".split()
)
#: Of these, the words that name lists of links, and those that name heads of pages or of stories.
LINK_WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended toolbar pagination pager skip".split()
)
HEAD_WORDS = frozenset("banner masthead header".split())
#: Words that say nothing beside a furniture word; any other word makes a name like ``no-sidebar`` speak of the text.
NEUTRAL_WORDS = frozenset(
    "area bar block box container inner item items left link links list main outer page panel primary right row secondary "
    "section site slot text thread top bottom unit wrap wrapper content form global mobile desktop fixed sticky".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACES = re.compile(r"\s+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in RAW}


def named_kind(value: str) -> int:
    """How sure the names in a class or id make page furniture: furniture words, and else only neutral ones or numbers."""
    kinds = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        found = words & FURNITURE_WORDS
        if found and all(w in NEUTRAL_WORDS or w.isdigit() for w in words - found):
            kinds.add(IF_LINKS if found <= LINK_WORDS else IF_NO_HEADLINE if found <= HEAD_WORDS else SURE)
    return SURE if SURE in kinds or len(kinds) > 1 else max(kinds, default=NONE)


def _furniture_kind(name: str, attributes: str, in_article: bool) -> int:
    if name in ("html", "body", "main"):
        return NONE
    if name in FURNITURE and not (name == "header" and in_article):
        return SURE
    if "=" not in attributes and "hidden" not in attributes:
        return NONE
    kinds = {NONE}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if key == "role" and value.lower() in FURNITURE_ROLES:
            return SURE
        if key in ("class", "id"):
            kinds.add(named_kind(value))
    kinds.discard(NONE)
    return SURE if len(kinds) > 1 else max(kinds, default=NONE)


@dataclass
class PageLines:
    """Lines of a page and the blocks that hold them, as runs of lines."""

    texts: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # characters outside links
    names: list[str] = field(default_factory=list)  # of blocks, in the order of their start tags
    first: list[int] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)
    furniture: list[int] = field(default_factory=list)  # kinds


class _Reader:
    """One pass over a page; the open blocks are kept by name, so no tag walks them."""

    def __init__(self) -> None:
        self.out = PageLines()
        self.stack: list[tuple[str, int, bool]] = []  # name, block, article
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.parts: list[str] = []
        self.links: list[str] = []
        self.articles = 0
        self.anchor = False

    def end_line(self) -> None:
        if self.parts:
            text = _SPACES.sub(" ", html_lib.unescape("".join(self.parts))).strip()
            if text:
                linked = len(_SPACES.sub(" ", html_lib.unescape("".join(self.links))).strip())
                self.out.texts.append(text)
                self.out.sizes.append(max(0, len(text) - linked))
            self.parts.clear()
            self.links.clear()

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.anchor:
                self.links.append(text)

    def push(self, name: str, attributes: str) -> None:
        self.end_line()
        kind = _furniture_kind(name, attributes, self.articles > 0)
        article = name in ("article", "main") and kind == NONE
        out = self.out
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, len(out.names), article))
        self.articles += article
        out.names.append(name)
        out.first.append(len(out.texts))
        out.stop.append(-1)
        out.furniture.append(kind)

    def pop_to(self, depth: int) -> None:
        self.end_line()
        while len(self.stack) > depth:
            name, block, article = self.stack.pop()
            self.open[name].pop()
            self.articles -= article
            self.out.stop[block] = len(self.out.texts)

    def last(self, names: tuple[str, ...]) -> int:
        """Place of the innermost open block with one of these names, or -1."""
        return max((places[-1] for n in names if (places := self.open.get(n))), default=-1)

    def close_within(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        at = self.last(names)
        if at >= 0 and at > self.last(scope):
            self.pop_to(at)

    def read(self, page: str) -> PageLines:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                self.add(page[at:])
                break
            self.add(page[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name == "br":
                self.add(" ")
            elif closing:
                if name == "a":
                    self.anchor = False
                elif self.open.get(name):
                    self.pop_to(self.open[name][-1])
                elif name in BLOCK:
                    self.end_line()
            elif name in RAW:
                if not (name == "svg" and attributes.endswith("/")):
                    end = _RAW_END[name].search(page, at)
                    at = end.start() if end else n
            elif name == "a":
                self.anchor = True
            else:
                self.start(name, attributes)
        self.pop_to(0)
        return self.out

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.end_line()
            if name not in IN_PARAGRAPH:  # a block ends an open paragraph
                self.close_within(("p",), PARAGRAPH_SCOPE)
            if name in IMPLIED_END:
                wanted = IMPLIED_END[name]
                self.close_within(wanted, tuple(s for s in IMPLIED_SCOPE if s not in wanted))
            if name == "body":
                self.close_within(("head",), ())
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            return
        if name in BLOCK or _furniture_kind(name, attributes, self.articles > 0):
            self.push(name, attributes)


def page_lines(page: str) -> PageLines:
    return _Reader().read(page)


def _inside(first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` lines, in how many of these runs it lies."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change)[:n]


def window_sums(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of the sizes over a window around each line."""
    half = window // 2
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return total[np.minimum(at + half + 1, len(sizes))] - total[np.maximum(at - half, 0)]


def surges(sizes: np.ndarray, surge: int = SURGE, window: int = WINDOW) -> np.ndarray:
    """Which lines lie between a surge and its dive: in a run of windows above zero that reaches the surge threshold."""
    sums = window_sums(sizes, window)
    if not len(sums) or not sums.max():
        return np.zeros(len(sizes), dtype=bool)
    above = sums > 0
    run = np.cumsum(np.concatenate([[above[0]], above[1:] & ~above[:-1]]))  # number of the run, from 1
    peaks = np.zeros(run[-1] + 1, dtype=sums.dtype)
    np.maximum.at(peaks, run[above], sums[above])
    return above & (peaks[run] >= min(surge, sums.max()))


def link_runs(linked: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which lines lie in a run of linked lines as long as the window or longer: between a dive and the next rise."""
    if not len(linked):
        return linked
    change = np.flatnonzero(np.diff(linked.astype(np.int8))) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(linked)]])
    return linked & np.repeat(ends - starts >= window, ends - starts)


def kept_lines(lines: PageLines) -> np.ndarray:
    n = len(lines.texts)
    sizes = np.array(lines.sizes, dtype=np.int64)
    first, stop = np.array(lines.first, dtype=np.int64), np.array(lines.stop, dtype=np.int64)
    names = np.array(lines.names)
    kinds = np.array(lines.furniture, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.concatenate([[0], np.cumsum([len(t) for t in lines.texts])])
    unlinked, written = total[stop] - total[first], chars[stop] - chars[first]
    story = (kinds == IF_LINKS) & (unlinked >= SURGE) & (unlinked >= (1 - LINK_SHARE) * written)
    h1 = np.flatnonzero(names == "h1")
    headline = np.zeros(len(kinds), dtype=bool)
    if len(h1) == 1 and unlinked[h1[0]]:
        headline = (kinds == IF_NO_HEADLINE) & (first <= first[h1[0]]) & (stop >= stop[h1[0]])
    furniture = (kinds != NONE) & ~story & ~headline
    # furniture that holds the page's heading or main block and most of its text, or all of it, is none (a form round
    # the page, say)
    marks = np.concatenate([[0], np.cumsum(_inside(first[np.isin(names, ["h1", "main"])], stop[np.isin(names, ["h1", "main"])], n) > 0)])
    mass = total[stop] - total[first]
    holds = (marks[stop] > marks[first]) & (2 * mass > total[n]) | (mass == total[n]) & ~np.isin(names, ["nav", "footer", "head", "aside"])
    furniture &= ~(holds & (mass > 0))
    dropped = _inside(first[furniture], stop[furniture], n) > 0
    sizes = np.where(dropped, 0, sizes)

    article = np.isin(names, ["article", "main"])
    in_article = _inside(first[article], stop[article], n) > 0
    lively = surges(sizes)
    heavy = np.where(lively, sizes, 0)
    if ARTICLE_WEIGHT * heavy[in_article].sum() > heavy[~in_article].sum():
        inside = np.flatnonzero(in_article & ~dropped)
        heading = np.isin(names, HEADINGS)
        linked = (sizes == 0) & (_inside(first[heading], stop[heading], n) == 0)
        kept = np.zeros(n, dtype=bool)
        kept[inside[~link_runs(linked[inside])]] = True
        return kept
    # the innermost block with over half of the surging text
    total = np.concatenate([[0], np.cumsum(heavy)])
    most = np.flatnonzero(2 * (total[stop] - total[first]) > total[n])
    home = np.zeros(n, dtype=bool)
    if len(most):
        home[first[most[-1]] : stop[most[-1]]] = True
    return (home | lively) & (sizes > 0)


def main_text(page: str | None) -> str:
    """The kept lines in page order, joined by two line ends; empty if none."""
    lines = page_lines(page or "")
    if not lines.texts:
        return ""
    return "\n\n".join(t for t, k in zip(lines.texts, kept_lines(lines).tolist(), strict=True) if k)


def extract_main_text(df: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """The columns of ``df`` without the html, and the main text. Narrow; reads each whole page once.

    Null html counts as empty and gives empty text; malformed markup is read as browsers mostly do; repeated rows stay;
    a column already named as the result gives way to it; an empty table gives no rows.
    """
    keep = [c for c in df.columns if c not in (html_col, into)]
    schema = df.select(*keep).schema.add(into, "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, into])

    return df.select(*keep, html_col).mapInArrow(extract, schema)


def op7_main_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """Main text of every page."""
    from twigline.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
