"""Documents in parts, table functions, page records, changed matches and observed figures."""

import datetime
import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from twigline import Query, Save, query
from twigline.matcher import compile_queries, find_matches
from twigline.operators import extract, extract_observed, extract_parts
from twigline.operators.tables import register_select
from twigline.sources import from_strings
from twigline.sources.records import register_records
from twigline.stepping import Stepper
from twigline.streaming.changes import changed_matches, run_available, use_rocksdb

QUERIES = [
    query({"all": "p", "save": "all", "then": [{"first": "b", "save": "all"}, {"all": "i + a", "save": "text_content"}]}),
    query({"all": "script, td", "save": "inner_html"}),
    query({"first": "a[k]"}),
]
ODD = [
    "<p>a<script>if (a<b) '</p>'; <!-- </script>b<b>ü</b></p>", '<td a="x>y">q<a k>', "<p t='un>closed <b>x</b> it's>y", "<!-->--><p>", "<!doctype x><p>é<b>",
    "</ ><p><i></i><a>z</a>", "<p> a <b>  </b>", "<p><b>1</b", "<script>", "<", "", "<p>" * 40 + "<b>deep",
]


def key(m):
    return (m.plan.query, m.plan.number, m.path, m.name, str(m.attributes), m.inner_html, m.text_content)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_steps_find_what_the_whole_document_holds(size):
    rng = random.Random(size)
    pieces = [*ODD, "<li>", "</p>", "text", "<!-- c -->", "<a k=v>"]
    for q in (QUERIES, [query({"all": "p", "having": ["b"], "save": "all"})]):
        program = compile_queries(q)
        for _ in range(60):
            data = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))).encode()
            steps = Stepper(program)
            got = [m for i in range(0, len(data), size) for m in steps.feed(data[i : i + size])] + steps.finish()
            assert sorted(map(key, got), key=str) == sorted(map(key, find_matches(data, program)), key=str), data


def test_steps_end_early_and_hold_little():
    steps = Stepper(Query.first("a", Save.only_text_content()))
    assert steps.feed("<p><a>x") == [] and [m.text_content for m in steps.feed("y</a><b>")] == ["xy"] and steps.ended
    assert steps.feed("<a>z</a>") == [] and steps.finish() == []
    steps = Stepper(Query.all("li", Save.all()))
    found = 0
    for i in range(3000):
        found += len(steps.feed(f"<ul><li>{i} " + "x" * 50))
        found += len(steps.feed("</li></ul><!-- "))
        steps.feed("comment -->")
        walk = steps._sink.walk
        assert len(walk._held) < 2000 and len(steps._sink.text.runs) < 2000
    assert found == 3000
    waits = Stepper(Query.all("b"))
    waits.feed("<b t='")
    for _ in range(20_000):  # looked at again only when it has doubled
        waits.feed("y" * 20)
    assert len(waits.feed("'>")) + len(waits.finish()) == 1


def test_parts_in_any_order(spark):
    pages = [(i, s) for i, s in enumerate(ODD)] + [(None, "<p>of no id</p>"), (99, None)]
    rows = []
    for i, s in pages:
        data = None if s is None else s.encode()
        rows += [(i, "x", 0, None, 7)] if data is None else [(i, "x", n, data[n * 5 : n * 5 + 5], 7) for n in range(len(data) // 5 + 1)]
    random.Random(1).shuffle(rows)
    parts = spark.createDataFrame(rows, "k int, selector2 string, seq int, part binary, path int").repartition(3)
    whole = spark.createDataFrame(pages, "k int, html string")
    for q in (QUERIES, [query({"all": "p", "without": ["b"]})]):
        got = extract_parts(parts, q, ["k"], ["seq"])
        want = extract(whole, q, keep=["k"])
        assert got.columns == want.columns
        assert sorted((str(tuple(r)) for r in got.collect())) == sorted((str(tuple(r)) for r in want.collect()))
    assert extract_parts(parts.filter("false"), QUERIES, ["k"], ["seq"]).count() == 0
    with pytest.raises(ValueError, match="path"):
        extract_parts(parts, QUERIES, ["path"], ["seq"])


def test_select_takes_tables(spark):
    from_strings(spark, ["<nav><a href=x>1</a><a>2</a></nav>", None, "<a href=y>3"]).selectExpr("doc_id as page_id", "html", "1 as other").createOrReplaceTempView("t_pages")
    register_select(spark)
    got = spark.sql("SELECT page_id, name, text_content FROM html_select(TABLE(t_pages), 'a[href]', 'text_content')").collect()
    assert sorted(tuple(r) for r in got) == [(0, "a", "1"), (2, "a", "3")]
    spec = json.dumps({"all": "nav", "then": [{"all": "a", "save": "inner_html"}]})
    got = spark.sql(f"SELECT section_ix, inner_html FROM html_select(TABLE(t_pages) PARTITION BY (page_id), '{spec}', 'none')").collect()
    assert sorted((tuple(r) for r in got), key=str) == [(0, None), (1, "1"), (1, "2")]
    assert spark.sql("SELECT * FROM html_select(TABLE(SELECT * FROM t_pages WHERE false), 'a', 'none')").count() == 0
    with pytest.raises(ValueError, match="depth"):
        register_select(spark, "depth int")


def test_page_records(spark, tmp_path):
    register_records(spark)
    path = str(tmp_path / "pages")
    rows = [(i, f"u{i}", f"<p>{i} ü" + "x" * (i * 37 % 900)) for i in range(300)] + [(None, None, None), (7, "again", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("extra", F.lit(1)).coalesce(2)
    read = lambda **o: spark.read.format("html_records").options(**o).load(path)
    assert spark.read.format("html_records").load(str(tmp_path / "none")).count() == 0
    df.write.format("html_records").option("block_bytes", 2000).mode("append").save(path)
    in_order = lambda x: sorted((tuple(r) for r in x.select("page_id", "url", "html").collect()), key=str)
    for split in (100, 5000, 10**9):  # splits smaller than a block, than a file, and larger
        again = read(split_bytes=split)
        assert in_order(again) == sorted(rows, key=str)
    assert read(split_bytes=5000).rdd.getNumPartitions() > 3
    for where in ("page_id = 7", "page_id > 290", "page_id in (3, 4)", "page_id is null", "page_id <= 2 and url like 'u%'"):
        assert in_order(read().filter(where)) == in_order(df.filter(where))
    df.limit(3).write.format("html_records").mode("append").save(path)
    assert read().count() == 305
    with pytest.raises(Exception, match="broken"):
        def fail(x):
            raise RuntimeError("broken")

        df.withColumn("html", F.udf(fail)("html")).write.format("html_records").mode("append").save(path)
    assert read().count() == 305  # as it was
    df.limit(2).write.format("html_records").mode("overwrite").save(path)
    assert read().count() == 2


def test_filters_pass_over_blocks(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    from twigline.sources.records import RecordsReader

    register_records(spark)
    path = str(tmp_path / "pages")
    df = spark.range(2000).selectExpr("id as page_id", "'u' as url", "repeat('x', 100) as html").coalesce(1)
    df.write.format("html_records").option("block_bytes", 5000).mode("append").save(path)
    reader = RecordsReader(path, 1 << 30)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2000
    for f, most in ((EqualTo(("page_id",), 500), 100), (GreaterThan(("page_id",), 1900), 200)):
        reader = RecordsReader(path, 1 << 30)
        assert list(reader.pushFilters([f])) == [f]
        assert 0 < sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) <= most


def test_changes_survive_a_restart(spark, tmp_path):
    use_rocksdb(spark)
    day = lambda n: datetime.datetime(2030, 1, n)
    kinds = "page string, at timestamp, _body string, us int"
    batches = [
        [("a", day(2), "<i>1</i><i>1</i><b>x</b>", 0), ("b", day(2), "<i>2</i>", 0), ("c", day(2), None, 0), (None, day(2), "<i>", 0), ("d", None, "<i>", 0)],
        [("a", day(4), "<i>1</i><i k=v>3</i>", 0), ("a", day(3), "<i>between</i>", 0), ("c", day(4), "<i>new</i>", 0)],
        [("a", day(3), "<i>old copy</i>", 0), ("b", day(5), "", 0), ("c", day(5), "<i>new</i>", 0)],
    ]
    where = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    for rows in batches:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(where["in"])
        stream = spark.readStream.schema(kinds).parquet(where["in"])
        found = changed_matches(stream, Query.all("i", Save.only_text_content()), "page", "at", "_body", late="10 days")
        run_available(found, where["out"], where["state"])
    got = spark.read.parquet(where["out"])
    rows = sorted((r["page"], r["at"].day, r["change"], r["text_content"], r["attributes"], r["times"]) for r in got.collect())
    assert rows == [
        ("a", 2, "added", "1", "[]", 2), ("a", 3, "added", "between", "[]", 1), ("a", 3, "removed", "1", "[]", 2),
        ("a", 4, "added", "1", "[]", 1), ("a", 4, "added", "3", '[["k", "v"]]', 1), ("a", 4, "removed", "between", "[]", 1),
        ("b", 2, "added", "2", "[]", 1), ("b", 5, "removed", "2", "[]", 1), ("c", 4, "added", "new", "[]", 1),
    ]


def test_changes_take_few_state_calls():
    """A page is plain rows and costs three calls to the state store, four when it comes again."""
    from pyspark.sql import Row

    from twigline.query import as_queries
    from twigline.streaming.changes import _LastVersion

    class Store:
        kept, calls = None, ()

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def __getattr__(self, name):
            def call(*args):
                self.calls += (name,)
                if name == "update":
                    self.kept = args[0]
                return self.kept

            return call

    store = Store()
    pages = _LastVersion(as_queries(Query.all("i", Save.only_text_content())), 10, ["key", "us", *"abcdefgh"])
    pages.init(store)
    row = Row("us", "html")
    assert [(r.key, r.us, r.a) for r in pages.handleInputRows(("k",), iter([row(5, "<i>1</i>"), row(5, None)]), None)] == [("k", 5, "added")]
    assert store.calls == ("get", "registerTimer", "update")
    store.calls = ()
    assert [(r.us, r.a) for r in pages.handleInputRows(("k",), iter([row(7, ""), row(4, "<i>old</i>")]), None)] == [(7, "removed")]
    assert store.calls == ("get", "deleteTimer", "registerTimer", "update")
    store.calls = ()
    assert not list(pages.handleInputRows(("k",), iter([row(7, "")]), None)) and store.calls == ("get", "update")


def test_observed_figures(spark):
    pages = ["<ul><li>ä<li>b</ul><a>", "<p><b>x</p>", None, "<li>z"]
    df = from_strings(spark, pages)
    q = [Query.all("li", Save.all()), Query.all("b")]
    seen = Observation("figures")
    got = extract_observed(df, q, seen)
    assert sorted(map(str, got.collect())) == sorted(map(str, extract(df, q).collect()))
    sizes = sum(len(p.encode()) for p in pages if p)
    assert seen.get == {
        "documents": 4, "bytes": sizes, "bytes_read": sizes, "early_ends": 0, "implied": 1, "mismatched": 2, "eof": 2, "matches_0": 3, "matches_1": 1,
    }
    seen = Observation()
    assert extract_observed(df, Query.first("li"), seen, keep=[]).count() == 2
    assert (seen.get["early_ends"], seen.get["bytes_read"] < sizes) == (2, True)
    seen = Observation()
    assert extract_observed(df.filter("false"), q, seen).count() == 0 and seen.get["documents"] == 0
