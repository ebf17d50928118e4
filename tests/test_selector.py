import pytest

from twigline import Query, QueryBuilder, Save, SelectorParseError, parse_selector, query
from twigline.query import as_queries
from twigline.selector import AttributeTest, Compound, Step, parse_selectors


def test_compounds_and_combinators():
    assert parse_selector("menu#top.wide > entry") == (Step(" ", Compound("menu", "top", ("wide",))), Step(">", Compound("entry")))
    assert parse_selector("a>b") == parse_selector("a > b")
    assert parse_selector("> a")[0].combinator == ">"
    assert parse_selector("a#one#two")[0].compound.id == "one"
    assert parse_selector(".x.y")[0].compound.classes == ("x", "y")
    assert [s.combinator for s in parse_selector("a+b ~c > d e")] == [" ", "+", "~", ">", " "]


def test_lists():
    assert parse_selectors("a b,c , a b") == (parse_selector("a b"), parse_selector("c"))
    assert parse_selectors('a[k=","]') == (parse_selector('a[k=","]'),)
    with pytest.raises(SelectorParseError):
        parse_selector("a, b")


def test_conditions():
    q = Query.all("a").having("b").all("> c", Save.all()).without("d").build()
    assert q.spec() == {"all": "a", "save": "none", "having": ["b"], "then": [{"all": "> c", "save": "all", "without": ["d"]}]}
    assert query(q.spec()) == q and len(q.sections()) == 2


@pytest.mark.parametrize(
    ("selector", "test"),
    [
        ("a[k]", AttributeTest("k")),
        ("a[k=v]", AttributeTest("k", "exact", "v")),
        ('a[k="v w"]', AttributeTest("k", "exact", "v w")),
        ("a[k~='v']", AttributeTest("k", "word", "v")),
        ("a[k|=v]", AttributeTest("k", "hyphen", "v")),
        ("a[k^=v]", AttributeTest("k", "prefix", "v")),
        ("a[k$=v]", AttributeTest("k", "suffix", "v")),
        ("a[k*=v]", AttributeTest("k", "substring", "v")),
        ('a[k "v"]', AttributeTest("k", "exact", "v")),
    ],
)
def test_attribute_tests(selector, test):
    assert parse_selector(selector)[0].compound.attributes == (test,)


@pytest.mark.parametrize(
    ("selector", "message"),
    [
        ("", "empty selector"),
        ("  ", "empty selector"),
        ("a > ", "missing selector element"),
        (">   ", "missing selector element"),
        (".", "missing class string"),
        ("#", "missing id string"),
        ("a.", "missing class string"),
        ("~ a", "unsupported combinator '~'"),
        (" + a", "unsupported combinator '+'"),
        ("a + ", "missing selector element"),
        ("a,, b", "missing selector element"),
        (", b", "missing selector element"),
        ("a,", "missing selector element"),
        ("a, ~ b", "unsupported combinator '~'"),
        ("| a", "unsupported combinator '|'"),
        ("a[]", "attribute selector is missing a key"),
        ("*", "illegal selector token"),
        ('a[123="321"]', "attribute selector key is invalid"),
        ("a[k=]", "attribute selector is missing a value"),
        ("a[k==v]", "attribute selector has multiple '=' tokens"),
        ('a[k="v]', "attribute selector has an unclosed quoted value"),
        ("a[k=v", "attribute selector is missing a closing ']'"),
        ("a[=v]", "attribute selector is missing a key"),
        ("a[href]foo", "selector has multiple element names"),
        *[(f"a{c}b", "illegal selector token") for c in "!@$%^&()?`<:;"],
    ],
)
def test_errors(selector, message):
    with pytest.raises(SelectorParseError) as e:
        parse_selector(selector)
    assert e.value.message == message
    assert str(e.value) == f"{message} at byte {e.value.position}"


def test_builder_shapes():
    q = Query.all("a").first("b", Save.all()).then(lambda f: [f.all("c"), f.first("d", Save.only_inner_html())]).build()
    assert [(p, s.selector, s.first) for _, p, s in q.sections()] == [
        (-1, "a", False), (0, "b", True), (1, "c", False), (1, "d", True),
    ]
    assert query(q.spec()).root == q.root
    assert len(Query.all("a").append(Query.all("b"))) == 2


def test_builder_errors():
    with pytest.raises(SelectorParseError):
        Query.all("a").then(lambda f: [f.all("b"), f.all("*")])
    with pytest.raises(ValueError):
        Query.all("a").then(lambda f: [f.all("b"), f.all("b")])
    with pytest.raises(ValueError):
        as_queries([])
    with pytest.raises(ValueError):
        as_queries([Query.all("a"), Query.first("a")])
    with pytest.raises(ValueError):
        query({"save": "all"})
    with pytest.raises(ValueError):
        query({"all": "a", "save": "some"})
    assert isinstance(Query.all("a"), QueryBuilder)
