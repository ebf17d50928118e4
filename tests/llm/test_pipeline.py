import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    en, de = ["the", "ing", "ther", "wh", "and", "moron"], ["sch", "ung", "der", "ü", "und", "idiot"]
    text = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(80))
    rows = [(i, text(en if i % 2 else de), "en" if i % 2 else "de", "s", 1) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " end", rows[i][2], "s", 1) for i in range(30)]
    rows += [(2000, "123 456", None, "s", 1), (2001, None, None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "language ID":
            assert 2000 not in ids and 2001 not in ids and len(ids) >= 149
        if name == "SimHash near-dedup":
            assert set(range(120)) <= ids | {2000} and len(ids) < 149
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= set(range(120)) | set(range(1000, 1030))


def test_mixing_keeps_what_is_not_surely_toxic(spark, tmp_path):
    """Copies of every document: at least one unless it is surely toxic, and few of those that are."""
    rng = random.Random(11)
    words = {"good": ["apple", "river", "stone", "cloud"], "low": ["click", "cheap", "deal"], "toxic": ["moron", "trash", "loser"]}
    kinds = [("good", "good", "low", "toxic")[i % 4] for i in range(400)]
    text = lambda k: " ".join(rng.choices(words[k] + ["the", "of", "it"], k=60))
    docs = spark.createDataFrame([(i, text(k), "s") for i, k in enumerate(kinds)], "doc_id long, text string, source string")
    labels = [(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kinds[:200])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    times = {r.doc_id: r["count"] for r in pipeline.mixing(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) >= 1 for i, k in enumerate(kinds) if k != "toxic")
    assert 5 <= sum(n for i, n in times.items() if kinds[i] == "toxic") <= 50  # 25 of 100 expected
    assert 200 <= sum(n for i, n in times.items() if kinds[i] == "good") <= 235  # 210 of 200


def test_near_duplicates_keep_one_row_of_every_group(spark):
    rng = random.Random(10)
    a, b, c, d = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=150)) for _ in range(4)]
    rows = [(None, a), (None, a), (None, b), (5, b), (7, c), (7, d), (7, d), (9, d + " tail"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == 5 and {(None, a), (5, b), (7, c), (7, d)} < set(got) and not [t for i, t in got if (i, t) not in rows]
    assert pipeline.near_duplicates(spark, df.filter("false"), "").count() == 0


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i} the and" for i in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long, tokens int, row int, rate int, hash int, id int"
    docs = spark.createDataFrame([(i, text + f" {i}" * 40, "en", "s", 1, 1, 1, 1, 1, 1) for i in range(6)], kind)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns), name


def test_pipeline_against_its_operators(spark, tmp_path):
    """The pipeline's result, retraced from each stage's own decisions by plain Python."""
    from twigline.llm import simhash, tokens

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = pipeline.language(spark, docs, data)
    kept.write.parquet(str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a"))
    rows = {r.doc_id: r.text for r in kept.collect()}
    fps = {i: simhash.fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    one = pipeline.near_duplicates(spark, kept, data)
    assert {r.doc_id for r in one.collect()} == {i for i in fps if find(i) == i}
    one.write.parquet(str(tmp_path / "b"))
    one = spark.read.parquet(str(tmp_path / "b"))
    mixed = pipeline.mixing(spark, one, data)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    pieces = {}
    for r in pipeline.run(spark, data).collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    enc = tokens.encoder()
    assert pieces == {i: n * len(enc.encode_document(rows[i])) for i, n in times.items()}
