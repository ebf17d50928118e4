"""Documents made from each page's heading and language, with the matches that the recovery and selector rules demand.

``{t}`` stands for the heading's text and ``{l}`` for the language.  Rules: (document, selector, texts in order).
"""

from __future__ import annotations

LITERALS: dict[str, tuple[list[str | None], list[tuple[int, str, list[str | None]]]]] = {
    "rule_button": (["<form><button>{t}<button>Send {l}</form>"], [(0, "button", ["{t}", "Send {l}"]), (0, "form > button", ["{t}", "Send {l}"])]),
    "rule_list_item": (
        ["<ol><li>{t}<li>south<ul><li>{l}</ul>tail</ol>", "<li>a<ol><li>{t}</ol>c"],
        [(0, "li", ["{t}", "south {l} tail", "{l}"]), (1, "li", ["a {t} c", "{t}"]), (0, "ol > li", ["{t}", "south {l} tail"]), (1, "ol > li", ["{t}"])],
    ),
    "rule_definition": (["<dl><dt>{t}<dd>sense<dt>{l}<dd>more {t}</dl>"], [(0, "dt", ["{t}", "{l}"]), (0, "dl > dd", ["sense", "more {t}"])]),
    "rule_option": (
        ["<select><optgroup label=warm><option>{t}<option>pink<optgroup label=cold><option>{l}</select>"],
        [(0, "option", ["{t}", "pink", "{l}"]), (0, "optgroup", ["{t} pink", "{l}"])],
    ),
    "rule_table": (["<table><tr><td>{t}<th>2<tr><td>{l}</table>"], [(0, "tr", ["{t} 2", "{l}"]), (0, "td", ["{t}", "{l}"]), (0, "tr > th", ["2"])]),
    "rule_barrier": (
        ["<p>{t}<object><p>{l}</object>", "<table><tr><td><b>{t}</td></tr></table><i>{l}</i>"],
        [(0, "p", ["{t} {l}", "{l}"]), (1, "td", ["{t}"]), (1, "b", ["{t}"]), (1, "i", ["{l}"])],
    ),
    "rule_misnested": (
        ["<div><em>{t}</strong></em>{l}</div>", "<div><em>{t}</div><u>{l}", "</p>x<q>{t}"],
        [(0, "em", ["{t}"]), (0, "div", ["{t} {l}"]), (0, "div > em", ["{t}"]), (1, "em", ["{t}"]), (1, "div", ["{t}"]), (1, "div > em", ["{t}"]), (1, "u", ["{l}"]), (2, "q", ["{t}"])],
    ),
    "sel_id": (["<p id=lead>{t}</p><p id={l}>two</p><p>{t}</p>"], [(0, "p#lead", ["{t}"]), (0, "[id]", ["{t}", "two"])]),
    "sel_classes": (
        ["<i class='b {l} c'>{t}</i><i class={l}>2</i><i class='ab'>{l}</i><i class='c b'>{t}</i>"],
        [(0, ".b.c", ["{t}", "{t}"]), (0, "i.b", ["{t}", "{t}"]), (0, "i.ab", ["{l}"])],
    ),
    "sel_missing_values": (
        ["<a k>{t}</a><a k=''>{l}</a><a k={l}>3</a><a>4</a><a k=v>{t}</a>"],
        [(0, "a[k]", ["{t}", "{l}", "3", "{t}"]), (0, "a[k=v]", ["{t}"]), (0, "a[k^=v]", ["{t}"]), (0, 'a[k*=""]', ["{l}", "3", "{t}"])],
    ),
    "text_trimmed": (
        ["<b>\u00a0\u2003{t} \u3000</b><b> \t</b><b>{l}\u00a0side</b>", None, ""],
        [(0, "b", ["{t}", None, "{l}\u00a0side"])],
    ),
    "end_tags_any_case": (["<em>{t}</EM><em>{l}</Em >c"], [(0, "em", ["{t}", "{l}"])]),
}

#: A traced evaluation: document, selector of a ``first`` query that saves text, and (event, tag, position without the
#: heading, whether the heading comes before) in order.
EVENTS: tuple[str, str, list[tuple[str, str | None, int, bool]]] = (
    "<u>{t}<i>b</i></u><i>c</i>",
    "u > i",
    [
        ("ParseStarted", None, 0, False), ("ScopedCursorCreated", "", 0, False), ("OpenTag", "u", 0, False), ("TransitionMatched", "u", 0, False),
        ("OpenTag", "i", 3, True), ("TransitionMatched", "i", 3, True), ("ElementSaved", "i", 3, True), ("CloseTag", "i", 7, True),
        ("ContentFinalized", "i", 7, True), ("EarlyExit", "", 7, True), ("ParseFinished", None, 23, True),
    ],
)
