"""Queries over the ``pages`` table, one for each operator, and the same in SQL over the page template's text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from twigline.functions import attribute, attribute_map, has_attribute, match_json
from twigline.operators.extract import elements, except_matches, extract, intersect_matches, nested, select_matches, with_ordinal
from twigline.operators.metrics import extract_observed
from twigline.operators.parts import extract_parts
from twigline.operators.parse import html_events, html_nodes, register_sql, spread
from twigline.plans.literals import EVENTS, LITERALS
from twigline.operators.tables import register_select
from twigline.query import Query, Save, query
from twigline.scratch import shared_path
from twigline.sources.records import register_records
from twigline.streaming.changes import changed_matches, run_available, use_rocksdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Pieces of SQL that read the template.
ART = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
LINKS = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS raw FROM pages"
TEXT = "nullif(trim(raw, chr(32) || chr(9) || chr(10) || chr(13)), '')"
PARAS = (
    f"SELECT page_id, i - 2 AS ordinal, split_part(parts[i], '</p>', 1) AS inner_html FROM (SELECT page_id, string_split({ART}, '<p>') AS parts FROM pages), "
    "LATERAL (SELECT unnest(range(2, len(parts) + 1)) AS i)"
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(pages(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _links(df: DataFrame, selector: str) -> DataFrame:
    found = elements(df, selector, Save.only_text_content(), columns=["attributes", "text_content"])
    return found.select("page_id", attribute("href").alias("href"), F.col("text_content").alias("text"))


def _link_query(name: str, selector: str, where: str = "true") -> None:
    register(name, f"SELECT page_id, href, {TEXT} AS text FROM ({LINKS}) WHERE {where}")(lambda df: _links(df, selector))


_link_query("sel_tag_all_a", "a")
_link_query("sel_attr_presence", "a[href]")
_link_query("sel_attr_exact", 'a[href="/the"]', "href = '/the'")
_link_query("sel_attr_prefix", 'a[href^="/T"]', "starts_with(href, '/T')")
_link_query("sel_attr_suffix", 'a[href$="n"]', "ends_with(href, 'n')")
_link_query("sel_attr_substring", 'a[href*="tion"]', "contains(href, 'tion')")
_link_query("sel_attr_several", 'a[href^="/t"][href$="e"]', "starts_with(href, '/t') AND ends_with(href, 'e')")
_link_query("join_child", "nav > ul > li > a")
_link_query("join_descendant", "body nav a")
_link_query("join_descendant_empty", "article a", "false")


@register("sel_attr_word", "SELECT page_id FROM pages WHERE contains(html, '<div class=\"ad\">')")
def sel_attr_word(df: DataFrame) -> DataFrame:
    return elements(df, "div[class~=ad]").select("page_id")


@register(
    "sel_attr_hyphen",
    "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE regexp_matches(html, '<html lang=\"en[\"-]')",
)
def sel_attr_hyphen(df: DataFrame) -> DataFrame:
    return elements(df, 'html[lang|="en"]').select("page_id", attribute("lang").alias("lang"))


@register("sel_class", f"SELECT page_id, {TEXT} AS text FROM (SELECT page_id, regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1) AS raw FROM pages)")
def sel_class(df: DataFrame) -> DataFrame:
    found = elements(df, "div.ad", Save.only_text_content())
    return found.select("page_id", F.col("text_content").alias("text"))


@register("sel_compound", "SELECT page_id, 'utf-8' AS charset FROM pages WHERE contains(html, '<meta charset=\"utf-8\">')")
def sel_compound(df: DataFrame) -> DataFrame:
    return elements(df, 'head > meta[charset="utf-8"]').select("page_id", attribute("charset").alias("charset"))


@register("join_descendant_p", f"SELECT page_id, CAST(len(regexp_extract_all({ART}, '<p>')) AS BIGINT) AS n FROM pages WHERE contains({ART}, '<p>')")
def join_descendant_p(df: DataFrame) -> DataFrame:
    return elements(df, "article p").groupBy("page_id").agg(F.count("*").alias("n"))


@register(
    "first_root",
    f"SELECT page_id, {TEXT} AS text FROM (SELECT page_id, regexp_extract(html, '<li><a[^>]*>([^<]*)</a></li>', 1) AS raw FROM pages WHERE contains(html, '<li>'))",
)
def first_root(df: DataFrame) -> DataFrame:
    found = elements(df, "li", Save.only_text_content(), first=True, columns=["text_content"])
    return found.select("page_id", F.col("text_content").alias("text"))


NESTED = query({"all": "nav", "then": [{"first": "a", "save": "text_content"}, {"all": "li", "save": "all"}]})


@register(
    "nested_then",
    f"""WITH l AS (SELECT page_id, {TEXT} AS text, '<a href="' || href || '">' || raw || '</a>' AS inner_html,
       row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal
     FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
       unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS raw,
       unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS i FROM pages))
    SELECT page_id, 'nav' AS selector, CAST(0 AS BIGINT) AS ordinal, NULL AS inner_html, NULL AS text FROM pages
    UNION ALL SELECT page_id, 'a', 0, NULL, text FROM l WHERE ordinal = 0
    UNION ALL SELECT page_id, 'li', ordinal, inner_html, text FROM l""",
)
def nested_then(df: DataFrame) -> DataFrame:
    found = with_ordinal(extract(df, NESTED), ["page_id"])
    return found.select(
        "page_id", "selector", F.col("ordinal").cast("long").alias("ordinal"), "inner_html", F.col("text_content").alias("text")
    )


@register(
    "nested_arrays",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '<li>')) > 0 AS BIGINT) AS firsts FROM pages",
)
def nested_arrays(df: DataFrame) -> DataFrame:
    rows = nested(df, NESTED).select("page_id", F.explode("matches").alias("m"))
    return rows.select(
        "page_id", F.size("m.children_1").cast("long").alias("items"), F.size("m.children_0").cast("long").alias("firsts")
    )


@register("child_of_match", f"SELECT page_id, {TEXT} AS text FROM ({LINKS})")
def child_of_match(df: DataFrame) -> DataFrame:
    found = extract(df, Query.all("ul").all("> li", Save.only_text_content()))
    return select_matches(found, "> li", root=False).select("page_id", F.col("text_content").alias("text"))


@register(
    "inner_html",
    "SELECT page_id, 'title' AS selector, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS inner_html FROM pages "
    "UNION ALL SELECT page_id, 'ul', regexp_extract(html, '<ul>(.*?)</ul>', 1, 's') FROM pages",
)
def inner_html(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all(s, Save.only_inner_html()) for s in ("title", "ul")])
    return found.select("page_id", "selector", "inner_html")


@register(
    "text_content",
    "SELECT page_id, selector, nullif(trim(raw, chr(32) || chr(9) || chr(10) || chr(13)), '') AS text FROM ("
    "SELECT page_id, 'h1' AS selector, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS raw FROM pages UNION ALL "
    "SELECT page_id, 'title', regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages UNION ALL "
    f"SELECT page_id, 'nav', (SELECT string_agg({TEXT.replace('raw', 'x')}, ' ' ORDER BY i) FROM (SELECT unnest(xs) AS x, unnest(range(len(xs))) AS i)) "
    "FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS xs FROM pages))",
)
def text_content(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all(s, Save.only_text_content()) for s in ("h1", "title", "nav")], columns=["selector", "text_content"])
    return found.select("page_id", "selector", F.col("text_content").alias("text"))


@register("script_raw", "SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS inner_html FROM pages")
def script_raw(df: DataFrame) -> DataFrame:
    return elements(df, "script", Save.all()).select("page_id", "inner_html")


@register("void_br", "SELECT page_id, NULL AS inner_html, NULL AS text_content FROM (SELECT page_id, unnest(regexp_extract_all(html, '<br>')) FROM pages)")
def void_br(df: DataFrame) -> DataFrame:
    found = elements(df, "br", Save.all())
    return found.select("page_id", "inner_html", "text_content")


@register("implied_p_close", f"SELECT page_id, CAST(ordinal AS BIGINT) AS ordinal, inner_html FROM ({PARAS})")
def implied_p_close(df: DataFrame) -> DataFrame:
    found = with_ordinal(elements(df, "p", Save.only_inner_html()), ["page_id"])
    return found.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "inner_html")


@register(
    "eof_drain",
    "SELECT page_id, CASE WHEN contains(html, '</body>') THEN regexp_extract(html, '<body>(.*)</body>', 1, 's') "
    "ELSE regexp_extract(html, '<body>(.*)', 1, 's') END AS inner_html FROM pages",
)
def eof_drain(df: DataFrame) -> DataFrame:
    return elements(df, "body", Save.only_inner_html()).select("page_id", "inner_html")


@register(
    "multi_query",
    "SELECT page_id, s AS selector, CAST(len(regexp_extract_all(html, '<' || s || '[ >]')) AS BIGINT) AS n "
    "FROM pages, (VALUES ('a'), ('li'), ('p')) t(s) WHERE regexp_matches(html, '<' || s || '[ >]')",
)
def multi_query(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all(s) for s in ("a", "li", "p")], columns=["selector"])
    return found.groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@register("join_plan", f"SELECT page_id, {TEXT} AS text FROM ({LINKS})")
def join_plan(df: DataFrame) -> DataFrame:
    found = extract(df, Query.all("nav").all("ul > li a", Save.only_text_content()), plan="joins")
    return found.filter("section_ix = 1").select("page_id", F.col("text_content").alias("text"))


@register("count_matches", "SELECT page_id, CAST(2 * len(regexp_extract_all(html, '<li>')) + 1 AS BIGINT) AS n FROM pages")
def count_matches(df: DataFrame) -> DataFrame:
    return extract(df, Query.all("nav").all("li").all("a")).groupBy("page_id").agg(F.count("*").alias("n"))


@register(
    "element_table",
    "SELECT s AS name, CAST(sum(len(regexp_extract_all(html, '<' || s || '[ >]'))) AS BIGINT) AS n "
    "FROM pages, (VALUES ('html'), ('head'), ('meta'), ('title'), ('style'), ('script'), ('body'), ('nav'), ('ul'), ('li'), ('a'), ('div'), ('article'), ('h1'), ('p'), ('b'), ('br'), ('footer')) t(s) "
    "GROUP BY s",
)
def element_table(df: DataFrame) -> DataFrame:
    return html_nodes(df).groupBy("name").agg(F.count("*").alias("n"))


@register("close_reasons", "SELECT CAST(count(*) FILTER (NOT contains(html, '</body>')) AS BIGINT) AS bodies_at_end, CAST(sum(len(regexp_extract_all(html, '<b>'))) AS BIGINT) AS b_unclosed FROM pages")
def close_reasons(df: DataFrame) -> DataFrame:
    nodes = html_nodes(df)
    return nodes.agg(
        F.count_if((F.col("name") == "body") & (F.col("close_reason") == "eof")).alias("bodies_at_end"),
        F.count_if((F.col("name") == "b") & (F.col("close_reason") != "end_tag")).alias("b_unclosed"),
    )


@register("trace_events", "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS opened, CAST(len(regexp_extract_all(html, '</li>')) AS BIGINT) AS closed FROM pages")
def trace_events(df: DataFrame) -> DataFrame:
    of_li = html_events(df).filter("tag = 'li'").select("page_id", "event")
    counts = of_li.groupBy("page_id").agg(
        F.count_if(F.col("event") == "OpenTag").alias("opened"), F.count_if(F.col("event") == "CloseTag").alias("closed")
    )
    return df.select("page_id").join(counts, "page_id", "left").na.fill(0)


@register("attribute_functions", f"SELECT page_id, href, true AS has, href AS by_map, false AS other FROM ({LINKS})")
def attribute_functions(df: DataFrame) -> DataFrame:
    return elements(df, "a").select(
        "page_id", attribute("href").alias("href"), has_attribute("href").alias("has"),
        attribute_map()["href"].alias("by_map"), has_attribute("class").alias("other"),
    )


@register("to_json", "SELECT page_id, '{\"name\":\"br\",\"id\":null,\"class\":null,\"attributes\":{},\"inner_html\":null,\"text_content\":null}' AS json FROM (SELECT page_id, unnest(regexp_extract_all(html, '<br>')) FROM pages)")
def to_json(df: DataFrame) -> DataFrame:
    return elements(df, "br", Save.all()).select("page_id", match_json().alias("json"))


@register(
    "agg_links_by_lang",
    "SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(count(*) AS BIGINT) AS pages, CAST(sum(len(regexp_extract_all(html, '<a href='))) AS BIGINT) AS links FROM pages GROUP BY 1",
)
def agg_links_by_lang(df: DataFrame) -> DataFrame:
    found = extract(df, Query.all("html").all("a"), columns=["section_ix", "attributes"])
    lang = F.first(attribute("lang"), ignorenulls=True).alias("lang")
    per_page = found.groupBy("page_id").agg(lang, F.count_if(F.col("section_ix") == 1).alias("n"))
    return per_page.groupBy("lang").agg(F.count("*").alias("pages"), F.sum("n").alias("links"))


@register(
    "window_top_links",
    f"SELECT href, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS place FROM (SELECT href, CAST(count(*) AS BIGINT) AS n FROM ({LINKS}) GROUP BY href) QUALIFY rank() OVER (ORDER BY n DESC) <= 10",
)
def window_top_links(df: DataFrame) -> DataFrame:
    counts = _links(df, "a").groupBy("href").agg(F.count("*").alias("n"))
    # a filter on the rank itself lets every partition keep its own first ten before they meet
    ranked = counts.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).filter("r <= 10")
    return ranked.select("href", "n", F.col("r").cast("long").alias("place"))


def _sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_sql(spark)
    pages(spark, sf_dir).createOrReplaceTempView("_twigline_pages")
    return spark.sql("SELECT page_id, n.text_content AS text FROM _twigline_pages, LATERAL html_nodes(html) n WHERE n.name = 'h1'")


QUERIES["sql_table_function"] = _sql_surface
ORACLE_SQL["sql_table_function"] = (
    f"SELECT page_id, {TEXT} AS text FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS raw FROM pages)"
)


def _sql_text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


#: A page's heading and language, and the same in SQL.
_HEADING, _LANG = r"<h1>\s*([^<]*?)\s*</h1>", '<html lang="([^"]*)"'
_MADE = {"{t}": _HEADING, "{l}": _LANG}
_MADE_SQL = {mark: f"regexp_extract(html, '{pattern}', 1)" for mark, pattern in _MADE.items()}


def _filled(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    pieces = re.split(r"(\{[tl]\})", template)
    return F.concat(*[F.regexp_extract("html", _MADE[p], 1) if p in _MADE else F.lit(p) for p in pieces])


def _filled_sql(template: str | None) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    return " || ".join(_MADE_SQL.get(p, _sql_text(p)) for p in re.split(r"(\{[tl]\})", template) if p)


def _literal(selectors: list[str], documents: list[str | None]):  # noqa: ANN202
    def run(df: DataFrame) -> DataFrame:
        made = df.select("page_id", F.posexplode(F.array(*[_filled(d) for d in documents])).alias("doc", "html"))
        found = with_ordinal(extract(made, [Query.all(s, Save.only_text_content()) for s in selectors]), ["page_id", "doc"])
        return found.select("page_id", "doc", "selector", F.col("ordinal").cast("long").alias("ordinal"), F.col("text_content").alias("text"))

    return run


# queries over documents made from the pages, against the rows that the rules demand
for _name, (_documents, _expected) in LITERALS.items():
    _selectors = list(dict.fromkeys(s for _, s, _ in _expected))
    _rows = [
        f"SELECT page_id, {_doc} AS doc, {_sql_text(_selector)} AS selector, CAST({_n} AS BIGINT) AS ordinal, {_filled_sql(_t)} AS text FROM pages"
        for _doc, _selector, _texts in _expected
        for _n, _t in enumerate(_texts)
    ]
    register(_name, " UNION ALL ".join(_rows))(_literal(_selectors, _documents))


@register(
    "trace_evaluation",
    f"SELECT page_id, CAST(a AS BIGINT) AS seq, e AS event, t AS tag, CAST(p + CASE WHEN after THEN strlen({_MADE_SQL['{t}']}) ELSE 0 END AS BIGINT) AS position "
    "FROM pages, (VALUES " + ", ".join(f"({_k}, {_sql_text(_e)}, {_sql_text(_t)}, {_p}, {_after})" for _k, (_e, _t, _p, _after) in enumerate(EVENTS[2])) + ") v(a, e, t, p, after)",
)
def trace_evaluation(df: DataFrame) -> DataFrame:
    html, selector, _ = EVENTS
    events = html_events(df.select("page_id", _filled(html).alias("html")), queries=Query.first(selector, Save.only_text_content()))
    return events.select("page_id", F.col("seq").cast("long").alias("seq"), "event", "tag", F.col("position").cast("long").alias("position"))


LINK_ROWS = (
    "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, "
    "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS raw, "
    "unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>')))) AS i FROM pages"
)


@register("join_next_sibling", f"SELECT page_id, inner_html FROM ({PARAS}) WHERE ordinal = 0")
def join_next_sibling(df: DataFrame) -> DataFrame:
    return elements(df, "h1 + p", Save.only_inner_html()).select("page_id", "inner_html")


@register("join_later_sibling", f"SELECT page_id, {TEXT} AS text FROM ({LINK_ROWS}) WHERE i > 0")
def join_later_sibling(df: DataFrame) -> DataFrame:
    return elements(df, "li ~ li", Save.only_text_content()).select("page_id", F.col("text_content").alias("text"))


@register(
    "join_sibling",
    f"SELECT page_id, 'li + li a' AS selector, CAST(count(*) AS BIGINT) AS n FROM ({LINK_ROWS}) WHERE i > 0 GROUP BY page_id "
    f"UNION ALL SELECT page_id, 'h1 ~ p', CAST(count(*) AS BIGINT) FROM ({PARAS}) GROUP BY page_id",
)
def join_sibling(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all("li + li a"), Query.all("h1 ~ p")], plan="joins")
    return found.groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@register(
    "selector_list",
    f"SELECT page_id, CAST(i AS BIGINT) AS ordinal, 'a' AS name FROM ({LINK_ROWS}) UNION ALL "
    f"SELECT page_id, CAST(ordinal + (SELECT count(*) FROM ({LINK_ROWS}) l WHERE l.page_id = p.page_id) AS BIGINT), 'p' FROM ({PARAS}) p",
)
def selector_list(df: DataFrame) -> DataFrame:
    found = with_ordinal(elements(df, "nav a, article p, ul > li > a"), ["page_id"])
    return found.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "name")


@register("list_joined", f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id FROM ({LINK_ROWS}) UNION ALL SELECT page_id FROM ({PARAS})) GROUP BY page_id")
def list_joined(df: DataFrame) -> DataFrame:
    return extract(df, Query.all("nav a, article p, ul > li > a"), plan="joins").groupBy("page_id").agg(F.count("*").alias("n"))


def _conditions(name: str, kind: str, where: str, plan: str) -> None:
    @register(name, f"SELECT page_id, {TEXT} AS text FROM ({LINK_ROWS}) WHERE {where}")
    def run(df: DataFrame) -> DataFrame:
        q = getattr(Query.all("li", Save.only_text_content()), kind)('a[href^="/t"]')
        return extract(df, q, plan=plan).select("page_id", F.col("text_content").alias("text"))


for _plan, _mark in (("local", ""), ("joins", "_joined")):
    _conditions(f"having{_mark}", "having", "starts_with(href, '/t')", _plan)
    _conditions(f"without{_mark}", "without", "NOT starts_with(href, '/t')", _plan)


@register(
    "having_first",
    f"SELECT page_id, {TEXT} AS text FROM ({LINK_ROWS}) WHERE starts_with(href, '/t') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1",
)
def having_first(df: DataFrame) -> DataFrame:
    """The first list item that holds such a link, of each page."""
    found = extract(df, Query.all("ul").first("li", Save.only_text_content()).having('a[href^="/t"]'))
    return found.filter("section_ix = 1").select("page_id", F.col("text_content").alias("text"))


@register("intersect_matches", f"SELECT page_id, href FROM ({LINKS}) WHERE starts_with(href, '/t') AND ends_with(href, 'e')")
def intersect_(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all('a[href^="/t"]'), Query.all('nav a[href$="e"]')])
    both = intersect_matches(select_matches(found, 'a[href^="/t"]'), select_matches(found, 'nav a[href$="e"]'), ["page_id"])
    return both.select("page_id", attribute("href").alias("href"))


@register("except_matches", f"SELECT page_id, href FROM ({LINKS}) WHERE starts_with(href, '/t') AND NOT ends_with(href, 'e')")
def except_(df: DataFrame) -> DataFrame:
    found = extract(df, [Query.all('a[href^="/t"]'), Query.all('nav a[href$="e"]')])
    rest = except_matches(select_matches(found, 'a[href^="/t"]'), select_matches(found, 'nav a[href$="e"]'), ["page_id"])
    return rest.select("page_id", attribute("href").alias("href"))


_PAIRS = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]


@register(
    "many_selectors",
    f"SELECT 'nav a[href=\"' || href || '\"]' AS selector, CAST(count(*) AS BIGINT) AS n FROM ({LINKS}) WHERE regexp_matches(href, '^/[a-t][a-t]$') GROUP BY href",
)
def many_selectors(df: DataFrame) -> DataFrame:
    """400 queries in one pass."""
    found = extract(df, [Query.all(f'nav a[href="/{p}"]') for p in _PAIRS], columns=["selector"])
    return found.groupBy("selector").agg(F.count("*").alias("n"))


@register("resumable_parts", f"SELECT page_id, href, {TEXT} AS text FROM ({LINKS})")
def resumable_parts(df: DataFrame) -> DataFrame:
    """Pages cut every 100 bytes, as a log or a crawl may deliver them."""
    cut = df.select("page_id", F.encode("html", "UTF-8").alias("raw"))
    cut = cut.select("page_id", "raw", F.explode(F.expr("sequence(0, octet_length(raw) div 100)")).alias("seq"))
    cut = cut.select("page_id", "seq", F.substring("raw", F.col("seq") * 100 + 1, F.lit(100)).alias("part"))
    found = extract_parts(cut, Query.all("a", Save.only_text_content()), ["page_id"], ["seq"])
    return found.select("page_id", attribute("href").alias("href"), F.col("text_content").alias("text"))


def _sql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_select(spark)
    pages(spark, sf_dir).createOrReplaceTempView("_twigline_pages")
    return spark.sql(
        "SELECT page_id, attributes[0].value AS href, text_content AS text "
        "FROM html_select(TABLE(SELECT page_id, html FROM _twigline_pages), 'nav a[href]', 'text_content')"
    )


QUERIES["sql_select"] = _sql_select
ORACLE_SQL["sql_select"] = f"SELECT page_id, href, {TEXT} AS text FROM ({LINKS})"


def _page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as records and read back by splits smaller than the files, with a filter that passes over blocks."""
    register_records(spark)
    path = shared_path(spark, "records")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows.sortWithinPartitions("page_id").write.format("html_records").option("block_bytes", 64_000).mode("append").save(path)
    back = spark.read.format("html_records").option("split_bytes", 50_000).load(path).filter("page_id >= 20")
    return _links(back.select("page_id", "html"), "a")


QUERIES["page_records"] = _page_records
ORACLE_SQL["page_records"] = f"SELECT page_id, href, {TEXT} AS text FROM ({LINKS}) WHERE page_id >= 20"


def _stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two versions, the second with a link more and one less; the stream is restarted between."""
    use_rocksdb(spark)
    folder = shared_path(spark, "changes")
    first = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lit("2030-01-01").cast("timestamp").alias("crawled"), "html")
    less = F.regexp_replace("html", '<li><a href="/the">[^<]*</a></li>', "")
    more = F.regexp_replace(less, "</ul></nav>", '<li><a href="/new">new</a></li></ul></nav>')
    second = first.filter("page_id % 2 = 0").select("page_id", F.lit("2030-01-08").cast("timestamp").alias("crawled"), more.alias("html"))
    for rows in (first, second):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        run_available(changed_matches(stream, Query.all("nav a", Save.only_text_content())), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    day = F.date_format("crawled", "yyyy-MM-dd").alias("day")
    return out.select("page_id", day, "change", F.get_json_object("attributes", "$[0][1]").alias("href"), F.col("text_content").alias("text"), F.col("times").cast("long").alias("times"))


QUERIES["stream_changes"] = _stream_changes
ORACLE_SQL["stream_changes"] = (
    f"WITH l AS (SELECT page_id, href, {TEXT} AS text, count(*) AS n FROM ({LINKS}) GROUP BY ALL) "
    "SELECT page_id, '2030-01-01' AS day, 'added' AS change, href, text, n AS times FROM l "
    "UNION ALL SELECT page_id, '2030-01-08', 'added', '/new', 'new', 1 FROM pages WHERE page_id % 2 = 0 "
    "UNION ALL SELECT page_id, '2030-01-08', 'removed', href, text, n FROM l WHERE page_id % 2 = 0 AND href = '/the'"
)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two extractions took: one of all links and items, one that ends at the first item."""
    rows = []
    for name, queries, wanted in (
        ("all", [Query.all("a"), Query.all("nav li")], ["documents", "bytes", "bytes_read", "early_ends", "eof", "matches_0", "matches_1"]),
        ("first", [Query.first("li")], ["documents", "bytes", "early_ends", "matches_0"]),
    ):
        seen = Observation()
        extract_observed(pages(spark, sf_dir), queries, seen).write.format("noop").mode("overwrite").save()
        rows += [(name, k, seen.get[k]) for k in wanted]
    return spark.createDataFrame(rows, "name string, figure string, value long")


QUERIES["observed_metrics"] = _observed
ORACLE_SQL["observed_metrics"] = (
    "WITH p AS (SELECT count(*) AS documents, sum(strlen(html)) AS bytes, 2 * count(*) FILTER (NOT contains(html, '</body>')) AS eof, "
    "count(*) FILTER (contains(html, '<li>')) AS li, sum(len(regexp_extract_all(html, '<li>'))) AS n FROM pages) "
    "SELECT name, figure, CAST(value AS BIGINT) AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{figure}' AS figure, {value} AS value FROM p"
        for name, figures in (
            ("all", {"documents": "documents", "bytes": "bytes", "bytes_read": "bytes", "early_ends": "0", "eof": "eof", "matches_0": "n", "matches_1": "n"}),
            ("first", {"documents": "documents", "bytes": "bytes", "early_ends": "li", "matches_0": "li"}),
        )
        for figure, value in figures.items()
    )
    + ")"
)
