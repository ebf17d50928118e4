"""Single documents: recovery, contents, queries, through the local evaluator."""

import json

import pytest

from twigline import Query, Save
from twigline.dom import parse_html
from twigline.local import parse


def run(html, selector, first=False):
    start = Query.first if first else Query.all
    return parse(html, start(selector, Save.all())).get(selector) or []


def texts(html, selector, **k):
    return [e.text_content for e in run(html, selector, **k)]


def inner(html, selector):
    return [e.inner_html for e in run(html, selector)]


@pytest.mark.parametrize(
    ("html", "selector", "expected"),
    [
        ("<td><p>near<div>far</div></td>", "p", ["near"]),
        ("<div><p>near<div>far</div></div>", "div", ["near far", "far"]),
        ("<dl><dt>w<dd>x<dt>y<dd>z</dl>", "dl > dd", ["x", "z"]),
        ("<aside><h2>Top<p>Rest", "h2", ["Top Rest"]),
        ("<nav>1<br>2<img src=q>3</nav>", "nav", ["1 2 3"]),
        ("<div><tt>k</div><div><tt>l</tt></div>", "div > tt", ["k", "l"]),
        ("before<pre>it</pre>", "pre", ["it"]),
        ("<div></div>", "div", [None]),
        ("<!-- a > b -->text<a>y</a>", "a", ["y"]),
        ("a < b <i>c</i>", "i", ["c"]),
        ("<div/>x</div>", "div", ["x"]),
        ("<p>&lt;a&gt;  b</p>", "p", ["&lt;a&gt;  b"]),
        ("<BUTTON>a<button>b</button>", "button", ["b"]),
        ("", "a", []),
        (None, "a", []),
    ],
)
def test_texts(html, selector, expected):
    assert texts(html, selector) == expected


def test_inner_html():
    assert inner("<div><tt>k</none></tt></div>", "tt") == ["k</none>"]
    assert inner("<div><tt>k</div>", "div") == ["<tt>k"]
    assert inner("<nav><a href=q>to", "nav") == ["<a href=q>to"]
    assert inner("<div><p>x</p>", "div") == ["<p>x</p>"]
    assert inner("<img><br>", "img") == [None]
    assert inner("<p>é<b>ß</b></p>", "p") == ["é<b>ß</b>"]


def test_counts_of_quirks():
    assert len(run("<div><div>a</div><div>b</div></div>", "div")) == 3
    assert texts("<div></div><div><a>x</a></div>", "div a", first=True) == ["x"]
    assert len(run("<img><img>", "img", first=True)) == 1
    assert len(run('<p id="i" class="c d">', '[id="i"][class~="d"]')) == 1
    assert len(run("<nav><a href=q>to</a></a></nav>", "nav a")) == 1
    html = "<nav><script>if (1 < 2) write('<a href=no>raw</a>')</script><a href=yes>shown</a></nav>"
    assert [e.attribute("href") for e in run(html, "a")] == ["yes"]
    (script,) = run(html, "script")
    assert "raw" in script.text_content


def test_attributes():
    (a,) = run('<a\nhref="x"\tclass="k" id=i disabled data-e="" href="y"/>', "a")
    assert (a.id, a.class_name, a.attribute("href"), a.attribute("data-e")) == ("i", "k", "x", "")
    assert a.attribute("id") is None and a.attribute("class") is None
    assert a.attributes == {"href": "x", "disabled": None, "data-e": ""}
    dom = parse_html("<q one=1 'two'=2 \"three\"='3 4' four>")
    assert dom.attributes == [[("one", "1"), ("two", "2"), ("three", "3 4"), ("four", None)]]


@pytest.mark.parametrize(
    ("selector", "n"),
    [
        ("a[k]", 4), ("a[k=en-US]", 1), ("a[k~=b]", 1), ("a[k|=en]", 1), ("a[k^=en]", 1), ("a[k$=US]", 1), ("a[k*=n-]", 1),
        ("a[k^=é]", 1), ('a[k^=""]', 3), ("a[k][j]", 1), ("a[k=zz]", 0),
    ],
)
def test_attribute_operators(selector, n):
    html = '<a k="en-US"></a><a k="a b"></a><a k="ée" j></a><a k></a><a></a>'
    assert len(run(html, selector)) == n


def test_nested_results_and_mapping():
    html = "".join(
        f'<div class="lamp"><h1>Lamp {i}</h1><img src="{i}.png"><p>d{i}</p></div>' for i in range(2)
    )
    q = Query.first("#lamps", Save.none()).all(".lamp").then(
        lambda f: [f.first("h1", Save.all()), f.all("img"), f.all("p", Save.only_text_content())]
    )
    store = parse(f'<section id="lamps">{html}</section>', q)
    assert len(store) == 9
    (top,) = store.get("#lamps")
    lamps = top.get(".lamp")
    assert [p.get("h1")[0].inner_html for p in lamps] == ["Lamp 0", "Lamp 1"]
    assert [p.get("img")[0].attribute("src") for p in lamps] == ["0.png", "1.png"]
    with pytest.raises(ValueError):
        top.get("nothing")
    assert store.get("h1") is None
    h1 = lamps[0].get("h1")[0]
    assert h1.keys() == ["name", "id", "class", "attributes", "inner_html", "text_content"]
    assert h1["name"] == "h1" and json.loads(h1.to_json())["text_content"] == "Lamp 0"
    with pytest.raises(KeyError):
        h1["other"]


def test_first_inside_each_match():
    html = "<article><h1>a</h1><h1>b</h1></article><article><h1>c</h1></article>"
    store = parse(html, Query.all("article").first("h1", Save.only_text_content()))
    assert [[h.text_content for h in a.get("h1")] for a in store.get("article")] == [["a"], ["c"]]


def test_deep_nesting():
    assert len(run("<div>" * 5000, "div")) == 5000


def test_generated_pages():
    n = 300
    rows = "".join(f"<tr><th scope=row>{i}<td><q cite=#{i}>&lt;<i>{i * i}</i></q>" for i in range(n))
    found = run(f"<table>{rows}", "tr > td q")
    assert [(e.attribute("cite"), e.inner_html, e.text_content) for e in found] == [
        (f"#{i}", f"&lt;<i>{i * i}</i>", f"&lt; {i * i}") for i in range(n)
    ]


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        ("h1 + p", ["1", "4"]),
        ("h1 ~ p", ["1", "3", "4"]),
        ("p + p", []),
        ("br + i", ["2"]),
        ("h1 + p + h2 ~ p", ["3"]),
        ("div p, h2, p", ["1", "a", "3", "4"]),
        ("h1 + p b", ["b"]),
    ],
)
def test_siblings_and_lists(selector, expected):
    html = "<div><h1>x</h1><p>1</p><h2>a</h2><br><i>2</i><p>3</p></div><h1>y</h1>text<p>4</p>"
    assert texts(html if expected != ["b"] else html + "<h1></h1><p><b>b", selector) == expected


def test_conditions():
    html = "<ul><li>1<b>x</b></li><li>2</li><li>3<ol><li>4<b>y</b></ol></li></ul>"
    of = lambda q: [e.text_content for e in parse(html, q).get("li") or []]
    assert of(Query.all("li", Save.all()).having("b")) == ["1 x", "3 4 y", "4 y"]
    assert of(Query.all("li", Save.all()).having("> b")) == ["1 x", "4 y"]
    assert of(Query.all("li", Save.all()).without("b")) == ["2"]
    assert of(Query.first("li", Save.all()).without("b")) == ["2"]
    assert of(Query.first("li", Save.all()).having("ol").having("b")) == ["3 4 y"]


def test_close_reasons_and_trace():
    dom = parse_html("<div><p>a<div>b</div><span>c</div><i>", trace=True)
    assert dict(zip(dom.name, dom.close_reason, strict=True))["p"] == "implied"
    assert dom.close_reason == ["end_tag", "implied", "end_tag", "mismatched", "eof"]
    assert [e[0] for e in dom.events].count("OpenTag") == 5
