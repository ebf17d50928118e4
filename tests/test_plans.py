"""Both Spark plans against the local evaluator, on random trees and hand-made documents."""

import random

import pytest
from pyspark.sql import functions as F

from twigline import Query, Save, query
from twigline.functions import attribute, attribute_map, match_json
from twigline.local import match_paths, parse
from twigline.matcher import compile_queries, find_matches
from twigline.operators import elements, extract, html_nodes, nested, register_sql
from twigline.operators.extract import with_ordinal
from twigline.plans import joins
from twigline.sources import from_strings, read_html_bytes, read_html_text, write_jsonl
from twigline.streaming import read_stream, stream_matches

QUERIES = [
    query({"all": "div", "save": "all", "then": [{"first": "> p", "save": "all"}, {"all": "a b", "then": [{"all": "i"}]}]}),
    query({"first": "p .x", "save": "text_content"}),
    query({"all": "> div > p", "save": "inner_html"}),
    query({"all": "div a[k^=v]"}),
    query({"all": "a + b", "save": "all"}),
    query({"all": "p ~ .x i"}),
    query({"all": "li ~ li + br, ul b, b", "save": "inner_html"}),
    query({"all": "div, p", "having": ["b"], "then": [{"all": "a ~ i"}]}),
    query({"first": "div div", "without": ["> a"], "then": [{"first": "b + i, a", "having": ["i"]}]}),
    query({"all": "p", "without": ["b", "i + a"], "having": ["a"]}),
]


def random_html(rng, size=60):
    parts = []
    for _ in range(size):
        tag = rng.choice(["div", "p", "a", "b", "i", "br", "li", "ul", "td", "table"])
        kind = rng.random()
        if kind < 0.5:
            parts.append(f"<{tag}{rng.choice(['', ' class=x', ' k=v1', ' id=i', ' k'])}>")
        elif kind < 0.8:
            parts.append(f"</{tag}>")
        else:
            parts.append(rng.choice(["text", " ü ", "<!-- c -->", "a<b", "&amp;"]))
    return "".join(parts)


def expected(documents):
    rows = []
    for d, html in enumerate(documents):
        store = parse(html, QUERIES)
        for k, q in enumerate(QUERIES):
            for number, path in match_paths(q, store.dom):
                section = q.sections()[number][2]
                from twigline.local import Element

                e = Element(store, section, path)
                rows.append((d, k, number, list(path), e.name, e.id, e.class_name, e.inner_html, e.text_content))
    return sorted(rows, key=str)


@pytest.mark.parametrize(("plan", "size"), [("local", 0), ("joins", 1 << 16), ("joins", 7)])
def test_plans_agree(spark, monkeypatch, plan, size):
    """Ranges of 7 elements cut every document, with ancestors carried over the cuts."""
    monkeypatch.setattr(joins, "RANGE", size)
    rng = random.Random(5)
    documents = [random_html(rng) for _ in range(25)] + ["", None]
    df = from_strings(spark, documents)
    got = extract(df, QUERIES, keep=["doc_id"], plan=plan).select(
        "doc_id", "query_ix", "section_ix", "path", "name", "id", "class", "inner_html", "text_content"
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(documents)


def test_joins_take_null_and_repeated_rows_like_local(spark):
    df = spark.createDataFrame([(None, "<p><a>x</a>", 1), (1, "<p>", 2), (1, "<p><b><a>y</a>", 3), (1, "<p>", 2), (2, None, 4)], "k int, html string, _doc int")
    q = query({"all": "p", "save": "all", "then": [{"all": "a", "save": "text_content"}]})
    got = [sorted((str(tuple(r)) for r in extract(df, q, plan=p).collect())) for p in ("local", "joins")]
    assert got[0] == got[1] and len(got[0]) == 6
    odd = df.withColumnsRenamed({"k": "m", "_doc": "_nodes"}).withColumns({"n": F.lit(1), "_html": F.lit(2), "_keep": F.lit(3)})
    assert all(set(odd.columns) - {"html"} <= set(extract(odd, q, plan=p).columns) for p in ("local", "joins"))


def test_one_large_document_is_dealt_over_tasks(spark, monkeypatch):
    n = 60_000
    html = "<ul>" + "<li><a k=v><b>x</b></a>" * n + "</ul>"
    q = query({"all": "ul", "then": [{"all": "li a > b"}, {"all": "li + li"}]})
    df = from_strings(spark, [html, "<ul><li><a><b>y</ul>"])
    dealt = []
    merged = joins._merge
    monkeypatch.setattr(joins, "RANGE", 10_000)
    monkeypatch.setattr(joins, "_merge", lambda *a: dealt.append(merged(*a)) or dealt[-1])
    found = extract(df, q, keep=["doc_id"], plan="joins").groupBy("doc_id", "section_ix").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 0, 1), (0, 1, n), (0, 2, n - 1), (1, 0, 1), (1, 1, 1)]
    rows = dealt[1].select(F.expr("node_id div 10000").alias("r"), F.spark_partition_id().alias("task"))
    per_range = rows.groupBy("r").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks")).collect()
    assert len(per_range) == 19 and all(r["tasks"] == 1 for r in per_range) and max(r["n"] for r in per_range) < 10_000
    assert rows.select("task").distinct().count() > 1


def test_many_queries_cost_little_more_than_one():
    import time

    html = "<nav>" + "".join(f"<li class='c{i % 50} z' k=v{i % 70}><i>x</i><a href='/{i}'>y</a></li>" for i in range(4000))

    def took(queries):
        program = compile_queries([Query.all(s).build() for s in queries])
        best, n = 9.0, 0
        for _ in range(3):
            began = time.perf_counter()
            n = len(find_matches(html, program))
            best = min(best, time.perf_counter() - began)
        return n, best

    for one, many, n in (
        ("nav > li.c1", [f"nav > li.c{i}" for i in range(400)], 4000),
        ("nav a[href='/1']", [f"nav a[href='/{i}']" for i in range(400)], 400),
        ("t1 a", [f"t{i} a" for i in range(400)], 0),
        ("i", [f"li i t{i}" for i in range(400)], 0),
    ):
        count, some = took([one])
        found, all_ = took(many)
        assert found == n and all_ < 4 * some + 0.02, (one, some, all_)


def test_evaluation_stops_and_is_linear():
    import time

    seen = []
    find_matches("<a>1</a>" + "<p>" * 10, compile_queries([Query.first("a", Save.all()).build()]), seen)
    assert [e[0] for e in seen].count("OpenTag") == 1 and seen[-2][0] == "EarlyExit"
    began = time.perf_counter()
    assert len(find_matches("<div>" * 50_000, compile_queries([Query.all("div > div").build()]))) == 49_999
    scopes = query({"all": "div", "then": [{"first": "a"}]})
    assert len(find_matches("<div>" * 20_000 + "<a><a>", compile_queries([scopes]))) == 40_000
    for name in ("<" + "a" * 1_000_000, "<a<" * 20_000, "<a " * 20_000):
        find_matches(name, compile_queries([Query.all("b").build()]))
    rows = "".join(f"<section class=s><h3>{i}</h3><b>x</b></section>" for i in range(4000))
    q = query({"all": "section.s", "save": "all", "then": [{"first": "> h3", "save": "text_content"}, {"all": "b"}]})
    assert len(find_matches(rows, compile_queries([q]))) == 12_000
    assert time.perf_counter() - began < 10


def test_no_shuffle_and_pruned_scan(spark, tmp_path):
    df = from_strings(spark, ["<a>x</a>"]).selectExpr("*", "'u' as url")
    df.write.parquet(str(tmp_path / "t"))
    found = elements(spark.read.parquet(str(tmp_path / "t")), "a", keep=["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "url" not in plan


def test_nested_ordinal_json(spark):
    df = from_strings(spark, ["<ul><li>a<li>b</ul><ul><li k=1 k=2>c</ul>"])
    q = query({"all": "ul", "then": [{"all": "> li", "save": "text_content"}]})
    rows = nested(df, q).first()["matches"]
    assert [[c["text_content"] for c in m["children_0"]] for m in rows] == [["a", "b"], ["c"]]
    flat = with_ordinal(extract(df, q), ["doc_id"]).filter("section_ix = 1").orderBy("node_id")
    assert [r["ordinal"] for r in flat.collect()] == [0, 1, 0]
    last = flat.select(attribute("k").alias("k"), attribute_map()["k"].alias("m"), match_json().alias("j")).collect()[-1]
    assert (last["k"], last["m"]) == ("1", "1") and '"id":null' in last["j"]


def test_columns_asked_for(spark):
    df = from_strings(spark, ["<a k=v>x</a><a>y", None]).withColumn("path", F.lit(1))
    for plan in ("local", "joins"):
        got = extract(df, Query.all("a", Save.all()), plan=plan, columns=["text_content", "attributes"])
        assert got.columns == ["doc_id", "path", "text_content", "attributes"]
        assert sorted((r["text_content"], len(r["attributes"])) for r in got.collect()) == [("x", 1), ("y", 0)]
        assert extract(df, Query.all("a"), plan=plan, columns=[]).count() == 2
    with pytest.raises(ValueError, match="nothing"):
        extract(df, Query.all("a"), columns=["nothing"])


def test_errors_on_the_driver(spark):
    df = from_strings(spark, ["<a>"])
    with pytest.raises(ValueError):
        extract(df, [])
    with pytest.raises(ValueError):
        extract(df, Query.all("a"), plan="other")
    with pytest.raises(ValueError, match="name"):
        extract(df.selectExpr("html", "1 as name"), Query.all("a"))


def test_sql_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.html").write_text("<p>hé</p>", encoding="utf-8")
    for df in (read_html_text(spark, str(tmp_path / "in")), read_html_bytes(spark, str(tmp_path / "in"))):
        assert elements(df, "p", Save.all()).first()["inner_html"] == "hé"
    register_sql(spark)
    df.selectExpr("decode(html, 'UTF-8') as html").createOrReplaceTempView("files")
    row = spark.sql("SELECT n.* FROM files, LATERAL html_nodes(html) n").first()
    assert (row["name"], row["text_content"]) == ("p", "hé")
    write_jsonl(elements(df, "p", keep=["file"]), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert html_nodes(df).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<ul><li>{i}<li>x</ul>") for i in range(20)], "page_id long, url string, html string")
    pages.repartition(4).write.parquet(str(tmp_path / "pages"))
    q = Query.all("li", Save.only_text_content())
    stream = stream_matches(read_stream(spark, str(tmp_path / "pages")), q)
    run = stream.writeStream.format("memory").queryName("found").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("found").select("page_id", "text_content").collect()
    batch = extract(pages, q).select("page_id", "text_content").collect()
    assert sorted(got) == sorted(batch) and len(got) == 40
