import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twigline.llm import ann, mixing, preference, queries, sharding

DATA = "/root/testdata/sf0.001"


def plain_neighbours(rows, asked, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in asked:
        if q in usable:
            found = sorted(((-float((v * usable[q]).sum()), i) for i, v in usable.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_neighbours_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0] * 7 + [float("nan")]), (203, [1.0] * 7 + [None]), (204, [1.0] * 7 + [float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[5]]], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 5 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain_neighbours(rows, [i for i, _ in rows if i % 5 == 0], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    two = df.filter("vec_id in (1, 2)")
    assert ann.nearest_neighbours(two, two).count() == 2
    assert ann.nearest_neighbours(df.filter("false"), df).count() == 0


@pytest.mark.parametrize("spread_", [0.0, 1.0])
def test_neighbours_recall(spark, spread_):
    """Isotropic and clustered vectors, far more lists than are probed in the latter; all queries count."""
    rng = np.random.default_rng(2)
    centres = 3 * spread_ * rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    model = ann.train(x, ann.list_count(len(x)))
    n = ann.probe_count(x, model, 20, len(x))
    assert len(model.centroids) > 300 and n < len(model.centroids) * (0.2 if spread_ else 0.7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 6000, 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    hits = sum(len(got[q] & set(b)) for q, b in zip(asked.tolist(), best.tolist(), strict=True))
    assert all(len(g) == 20 for g in got.values()) and hits / 20 / len(asked) >= 0.9


@pytest.mark.parametrize("kind", ["small", "large", "crowd", "long", "askers"])
def test_neighbours_recall_on_other_rows(spark, kind):
    """Components beyond single precision's products, a crowd of near copies, many components, queries unlike the rest."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 256 if kind == "long" else 24))
    if kind == "crowd":
        x[::2] = x[0] + 0.001 * x[::2]
    if kind == "askers":
        x[::40] = 0.05 * x[::40] - x[1::2].mean(axis=0) - 2
    x *= {"small": 1e-30, "large": 1e25}.get(kind, 1)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 40 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, 2400, 40)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    hits = sum(len(got[q] & set(b)) for q, b in zip(asked.tolist(), best.tolist(), strict=True))
    assert all(len(g) == 20 for g in got.values()) and hits / 20 / len(asked) >= 0.94


def test_blocks_hold_all_lists(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 60, 40)
    sizes[7] = 500
    block, parts = ann.list_blocks(rng.normal(size=(40, 8)), sizes)
    for b in range(block.max() + 1):
        of = np.flatnonzero(block == b)
        assert len(of) and (len(of) == 1 or sizes[of].sum() <= 50)
    assert parts[7] == 10


def test_ids_with_several_vectors_keep_their_scores(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [1.0, 1.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.score) for r in ann.nearest_neighbours(df, df.filter("vec_id = 2")).collect()}
    assert got == {(1, 1.0), (1, 5.0), (3, 2.0)}


def test_nearest_query_against_brute_force(spark):
    got = {}
    for r in queries.QUERIES["op2_nearest"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    of = {i: np.array(v, float) for i, v in rows}
    want = plain_neighbours(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, 21))
        for (_, i, s), (_, j, t) in zip(found, found[1:], strict=False):
            assert (-s, i) < (-t, j)
        assert all(abs(float((of[i] * of[q]).sum()) - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits / 20 / len(want) >= 0.9


def test_preferences(spark):
    kind = "array<struct<role:string,text:string>>"
    user, yes, no = ("user", "hi"), ("assistant", "yes"), ("assistant", None)
    rows = [
        (1, [user, yes], [user, no], 7), (2, [user, yes], [user, yes], 7), (3, [user], [user, yes], 7), (4, None, [no], 7),
        (5, [("system", "<|end|>"), user, yes, user], [("system", "<|end|>"), yes], 7), (6, [], [], 7), (6, [], [], 7),
        (7, [(None, None), user], [(None, None), yes], 7),
    ]
    df = spark.createDataFrame(rows, f"k int, chosen {kind}, rejected {kind}, prompt int")
    out = preference.format_preferences(df).orderBy("k").collect()
    assert [r.common_turns for r in out] == [1, 2, 1, 0, 1, 0, 0, 1]
    head = "<|turn user|>\nhi<|end|>\n"
    assert out[0].prompt == head and out[0].chosen_text == "<|turn assistant|>\nyes<|end|>\n"
    assert out[0].chosen_mask == "19:0,11:1" and out[0].rejected_text == "<|turn assistant|>\n<|end|>\n"
    assert out[1].chosen_text == out[1].rejected_text == "" and out[2].chosen_text == ""
    assert "<\\|end|>" in out[4].prompt and out[4].prompt.count("<|end|>") == 1
    assert "<|turn unknown|>" in out[7].prompt
    for r in out:
        for text, mask in ((r.chosen_text, r.chosen_mask), (r.rejected_text, r.rejected_mask)):
            assert sum(int(x.split(":")[0]) for x in mask.split(",") if x) == len(text)
    assert preference.format_preferences(df.filter("false")).count() == 0


def test_escapes_can_be_undone(spark):
    texts = ["<|end|>", "<\\|x", "<\\\\|", "a < | b", "<||>", "<<|", "", "\\<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", preference._safe(F.col("t")).alias("s"), preference.unescape(preference._safe(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.s


def test_every_conversation_finds_a_partner_by_its_opening(spark, monkeypatch):
    monkeypatch.setattr(preference, "PAIR_BUCKETS", 7)
    hot = [(i, t, r, x) for i in range(0, 80, 2) for t, r, x in [(0, "user", "hi"), (1, "assistant", f"a{i % 4}"), (2, "user", f"b{i}")]]
    rest = [(101, 0, "user", "alone"), (103, 5, None, None), (105, 5, None, None), (107, 1, "user", "q"), (107, 1, "user", "q"), (None, 0, "user", "hi")]
    df = spark.createDataFrame(hot + rest, "conv_id long, turn long, role string, text string")
    of = {r.conv_id: r.partner for r in preference.partners(df).collect()}
    assert of.keys() == {*range(0, 80, 2), 101, 103, 105, 107} and of[101] is of[107] is None and (of[103], of[105]) == (105, 103)
    assert all(of[i] is not None and of[i] % 2 == 0 and of[i] != i for i in range(0, 80, 2))
    out = {r.conv_id: r for r in preference.format_preferences(preference.paired_conversations(df)).collect()}
    assert len(out) == 44 and all(out[i].common_turns == (2 if of[i] % 4 == i % 4 else 1) for i in range(0, 80, 2))
    assert out[103].common_turns == 1 and out[103].chosen_text == "" and out[101].rejected_text == "" and out[107].chosen_text.count("q") == 2
    assert preference.paired_conversations(df.filter("false")).count() == 0


def test_answers_are_paired(spark, monkeypatch):
    rows = [(i, n, "assistant" if n % 2 else "user", f"{i}.{n}") for i in range(60) for n in range(2 + i % 9)]
    rows += [(200, 0, "user", "no answer"), (201, 0, None, None), (202, 0, "assistant", "at once"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of = {i: [(r[2], r[3]) for r in rows if r[0] == i] for i in {r[0] for r in rows}}
    out = {r.conv_id: r for r in preference.format_preferences(preference.answer_pairs(df), "chosen", "rejected").collect()}
    pairs = {r.conv_id: r for r in preference.answer_pairs(df).collect()}
    assert out.keys() == pairs.keys() == of.keys() - {None}
    for i, r in pairs.items():
        chosen, rejected = ([tuple(t) for t in x or []] for x in (r.chosen, r.rejected))
        assert chosen == of[i]
        if i in (200, 201):
            assert r.rejected_id is None and rejected == [] and out[i].rejected_text == ""
            continue
        cut = out[i].common_turns
        assert r.rejected_id != i and rejected[:cut] == chosen[:cut] and chosen[cut][0] == rejected[cut][0] == "assistant"
        assert rejected[cut:] == of[r.rejected_id][-len(rejected[cut:]) :] and out[i].rejected_text and out[i].chosen_text
    assert len({r.common_turns for r in out.values()}) > 3
    alone = preference.answer_pairs(df.filter("conv_id in (3, 200)")).collect()
    assert len(alone) == 2 and all(r.rejected_id in (None, r.conv_id) for r in alone)
    assert preference.answer_pairs(df.filter("false")).count() == 0


def test_clashing_columns(spark):
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("user", "x")], [("user", "y")], 1, 2, 3, 4)], f"chosen {kind}, rejected {kind}, _a int, _b int, _p int, _keep int")
    out = preference.format_preferences(df)
    assert out.columns[:4] == ["_a", "_b", "_p", "_keep"] and out.first()["_b"] == 2
    docs = spark.createDataFrame([(i, "x" * 300, 1, 2, 3, 4) for i in range(20)], "doc_id long, text string, _h int, _size int, depth int, cell int")
    shards = sharding.assign_shards(docs, limit=1000)
    assert shards.columns == [*docs.columns, *sharding.MADE] and {r.depth for r in shards.collect()} == {3}


def plans_of(spark, monkeypatch, name):
    """Plans of all that a query executes, intermediate tables included."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen = []
    plain = DataFrameWriter.parquet

    def parquet(self, *a, **k):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    seen.append(queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    return seen


@pytest.mark.parametrize("name", ["op6_preference", "op10_mixing"])
def test_native_plans_hold_no_python(spark, monkeypatch, name):
    for plan in plans_of(spark, monkeypatch, name):
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def check_shards(rows, limit):
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.shard_bytes_each)
    for name, s in sizes.items():
        assert sum(s) <= limit or (len(s) == 1 and "!" in name)
    names = [n for n in sizes if "!" not in n]
    for a in names:  # no bucket lies inside another
        assert not any(b != a and b.startswith(a) and "+" not in b[len(a) :][:1] for b in names)
    return sizes


def test_sharding(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(n), 1) for i, n in enumerate(rng.integers(0, 400, 300))]
    rows += [(1000, "big" * 1000, 1), (None, "n", 1), (None, None, 1)]
    rows += [(2000, "hot" * 30, 1)] * 120  # a key with more than a shard's bytes
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.assign_shards(df, limit=2000).collect()
    assert len(out) == len(rows)
    sizes = check_shards(out, 2000)
    assert sum("+" in n for n in sizes) > 1
    one = sharding.assign_shards(df.filter("doc_id < 20"), limit=10**6).collect()
    assert {r.shard for r in one} == {""}
    assert sharding.assign_shards(df.filter("false")).count() == 0


def test_shards_split_only_where_over(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("y" * 50).alias("text"))
    out = sharding.assign_shards(df, limit=1000).collect()
    names = {r.shard for r in out}
    sizes = check_shards(out, 1000)
    for n in names:  # a bucket was split because both halves together were over
        under = sum(sum(s) for m, s in sizes.items() if m.startswith(n[:-1]))
        assert under > 1000


def test_shard_files(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("y" * 50).alias("text"))
    sharding.write_shards(df, str(tmp_path / "s"), limit=500)
    back = sharding.read_shards(spark, str(tmp_path / "s"), df.schema)
    assert back.count() == 50 and back.columns == ["doc_id", "text", "shard_bits", "shard_bytes_each", "shard"]
    assert max(r["n"] for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect()) <= 500
    want = {r.doc_id: r.shard for r in sharding.assign_shards(df, limit=500).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    sharding.write_shards(df.filter("false"), str(tmp_path / "e"))
    assert sharding.read_shards(spark, str(tmp_path / "e"), df.schema).count() == 0


def test_large_directories_are_joined(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("y" * 50).alias("text"))
    small = {r.doc_id: r.shard for r in sharding.assign_shards(df, limit=500).collect()}
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 0)
    assert {r.doc_id: r.shard for r in sharding.assign_shards(df, limit=500).collect()} == small


def labelled(spark, n=600):
    rng = np.random.default_rng(4)
    words = {"good": ["apple", "river", "stone"], "low": ["###", "$$$", "zzz"], "toxic": ["moron", "trash", "loser"]}
    common = ["a", "of", "it", "we", "on"]
    rows, labels = [], []
    for i in range(n):
        d = ("good", "good", "low", "toxic")[i % 4]
        text = " ".join(rng.choice(common + words[d], size=30))
        rows.append((i, text, 5))
        if i % 2 == 0 or i % 4 == 3:
            labels.append((i, 0 if d == "low" else 1, int(d == "toxic")))
    docs = spark.createDataFrame([*rows, (n, None, 5), (n + 1, "", 5), (None, "river", 5)], "doc_id long, text string, rate int")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (9999, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def plain_rates(p, mass, target, steps=3000):
    """The same objective by plain projected gradients in numpy."""
    m = (p * mass[:, None]).T @ p
    m += np.eye(p.shape[1]) * (mixing.DAMPING * np.trace(m) / p.shape[1] + 1e-9)
    r = np.ones(len(p))
    for _ in range(steps):
        r = np.maximum(0, r - p @ np.linalg.solve(m, (p * (mass * r)[:, None]).sum(axis=0) - target))
    return r


def test_mixing(spark):
    docs, labels = labelled(spark)
    weights = {"good": 0.6, "low": 0.3, "toxic": 0.1}
    out = mixing.mixing_rates(docs, labels, weights).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    mass = out.tokens.to_numpy(float)
    reached = (p * (mass * out.rate.to_numpy())[:, None]).sum(axis=0)
    target = np.array([weights[d] for d in mixing.DOMAINS]) * mass.sum()
    assert np.allclose(reached, target, rtol=1e-4)
    truth = out.doc_id.map(lambda i: ("good", "good", "low", "toxic")[int(i) % 4] if i == i and i < 600 else None)
    known = truth.notna()
    assert (p[known].argmax(axis=1) == truth[known].map(mixing.DOMAINS.index)).mean() > 0.97
    assert np.allclose(reached, target, rtol=1e-5)  # of the documents' own posteriors
    assert np.allclose(out.rate.to_numpy(), plain_rates(p, mass, target), atol=0.03)  # cells share a rate
    assert mixing.mixing_rates(docs.filter("false"), labels, weights).count() == 0
    assert mixing.mixing_rates(docs, labels.filter("false"), weights).count() == len(out)


def test_targets_out_of_reach_are_approached(spark):
    """The plain distance ends near that of a plain projected gradient, and never above the start's."""
    docs, labels = labelled(spark, 200)
    for weights in ({"good": 1.0}, {"toxic": 0.999, "low": 0.001}):
        out = mixing.mixing_rates(docs, labels, weights).toPandas()
        p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
        mass = out.tokens.to_numpy(float)
        target = np.array([weights.get(d, 0) for d in mixing.DOMAINS]) * mass.sum()
        far = lambda r: np.linalg.norm((p * (mass * r)[:, None]).sum(axis=0) - target)  # noqa: B023, E731
        rates, top = np.ones(len(p)), np.linalg.eigvalsh((p * mass[:, None]).T @ p)[-1]
        for _ in range(5000):
            rates = np.maximum(0, rates - p @ ((p * (mass * rates)[:, None]).sum(axis=0) - target) / top)
        assert (out.rate >= 0).all() and far(out.rate.to_numpy()) <= far(rates) + 0.01 * mass.sum() and far(out.rate.to_numpy()) < far(1)


def test_nearly_equal_posteriors_do_not_blow_up(spark):
    """Where no rates can tell two domains apart, the fit stays as near as it began, at least."""
    rows = [(40 + i % 3, 1000 + i, 500_000 + 3000 * (i % 5), 480_000 - 2000 * (i % 7)) for i in range(50)]
    rows = [(i, t, a, b, mixing.UNIT - a - b) for i, t, a, b in rows]
    cells = spark.createDataFrame([(t, a, b, c, a // 10_000, b // 10_000, 100 - a // 10_000 - b // 10_000) for _, t, a, b, c in rows], "tokens long, q0 long, q1 long, q2 long, p0 int, p1 int, p2 int")
    _, report = mixing.fit_rates(cells, gains={"good": 1.05, "low": 1.0, "toxic": 0.25})
    far = lambda x: sum((a - b) ** 2 for a, b in zip(x, report["target"], strict=True))
    assert far(report["reached"]) < far(report["present"])


def test_least_rates_hold_and_gains_are_met(spark):
    """With ``thinned`` no document under its posterior falls below 1, and the totals still meet their targets."""
    docs, labels = labelled(spark)
    gains, thinned = {"good": 1.05, "low": 1.0, "toxic": 0.25}, {"toxic": 0.9}
    rates, report = mixing.mix(docs, labels, gains=gains, thinned=thinned)
    out = rates.toPandas()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    mass, least = out.tokens.to_numpy(float), (out.p_toxic < 0.9).to_numpy(float)
    assert (out.rate >= least).all() and (out.rate[least == 0] < 0.6).any()
    have, bound = mass @ p, (mass * least) @ p
    assert np.allclose(report["target"], [1.05 * have[0], have[1], bound[2] + 0.25 * (have[2] - bound[2])], rtol=1e-6)
    assert report["matched"] and np.allclose((mass * out.rate.to_numpy()) @ p, report["target"], rtol=1e-4)
    # nothing may be thinned: all rates are at least 1, whatever is missed
    rates, report = mixing.mix(docs, labels, gains={"toxic": 0.25}, thinned={})
    assert rates.filter("rate < 1").count() == 0 and report["matched"]


def test_labels_of_unknown_documents_teach_nothing(spark):
    docs, labels = labelled(spark, 200)
    odd = labels.unionByName(spark.range(50_000, 50_400).selectExpr("id as doc_id", "0 as quality", "1 as toxic"))
    assert mixing.train_domains(docs, odd).priors == mixing.train_domains(docs, labels).priors


def test_mixing_says_what_it_misses(spark):
    docs, labels = labelled(spark, 200)
    _, report = mixing.mix(docs, labels, {"good": 0.5, "low": 0.3, "toxic": 0.2})
    assert report["matched"] and report["gap"] <= mixing.TOLERANCE
    clean = docs.filter("doc_id % 4 < 2")
    with pytest.warns(UserWarning, match="missed"):
        mixing.mixing_rates(clean, labels.filter("toxic = 0"), {"toxic": 1.0})


def test_mixing_takes_clashing_columns_and_other_domains(spark):
    docs, labels = labelled(spark, 200)
    odd = docs.withColumnsRenamed({"rate": "_t"}).withColumns({c: F.lit(1) for c in ("tokens", "_f", "_keep", "p0", "q1", "p_good", "_s1")})
    out = mixing.mixing_rates(odd, labels, {"good": 0.6, "low": 0.3, "toxic": 0.1}, keep=odd.columns)
    assert len(set(out.columns)) == len(out.columns) and out.count() == docs.count()
    kind = F.when(F.col("toxic") == 1, "bad").otherwise("fine")
    two = mixing.mixing_rates(docs, labels, {"fine": 0.9, "bad": 0.1}, domain=kind, domains=("fine", "bad"))
    assert two.columns == ["doc_id", "tokens", "p_fine", "p_bad", "rate"] and two.count() == docs.count()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op6_preference", "op9_sharding"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    clean = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert clean(a) == clean(b)


def test_evidence_of_the_whole_text_counts(spark):
    docs, labels = labelled(spark)
    long = [(700, " ".join(["of it we on"] * 300 + ["moron trash loser"]), 5), (701, " ".join(["of it we on"] * 300 + ["apple river stone"]), 5)]
    model = mixing.train_domains(docs, labels)
    members = mixing.memberships(docs.unionByName(spark.createDataFrame(long, docs.schema)), model, ["doc_id"])
    out = {r["_keep"].doc_id: r for r in members.collect()}
    assert all(r.q0 + r.q1 + r.q2 == mixing.UNIT and r.p0 + r.p1 + r.p2 == mixing.GRID for r in out.values())
    assert out[700].p2 > 90 and out[701].p0 > 90


def test_temperature_softens_scores_that_mislead():
    right = [(d, [0.0, 9.0 * (d == 1), 0.0]) for d in (0, 1)] * 20
    priors = [np.log(0.5), np.log(0.4), np.log(0.1)]
    assert mixing.fit_temperature([], priors) == 1 and mixing.fit_temperature(right, priors) < 1.1
    assert mixing.fit_temperature([*right, *[(0, [0.0, 9.0, 0.0])] * 10], priors) > 5
