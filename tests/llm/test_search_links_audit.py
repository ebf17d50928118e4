"""Operators 11 to 13 against plain versions."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from twigline.llm import divergence, maxscore, pigeonhole, queries

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_embedding_dedup", "op13_source_audit"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLE_SQL[name])
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=str)


# ranked search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    held = [(i, Counter(t)) for i, text in docs if (t := plain_terms(text))]
    total, size = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * total) // size
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs", [5, 1000])
def test_search_against_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(maxscore, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    words = ["the", "Of", "naïve", "ÄPFEL", "x9", "rare", "w1", "w2", "w3", "日本", "and", "zeta"]
    odds = np.array([30, 20, 3, 3, 2, 0.2, 4, 4, 4, 1, 20, 1.0])
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 40), p=odds / odds.sum())) for _ in range(150)]
    docs = list(enumerate(texts)) + [(200 + i, texts[3]) for i in range(30)] + [(5, texts[9]), (None, texts[3]), (300, None), (301, ""), (302, "?! -")]
    items = [(i, " ".join(rng.choice(words, size=6))) for i in range(7)] + [(20, "rare Rare,RARE;zeta"), (21, "absent"), (22, ""), (23, None), (20, "rare Rare,RARE;zeta"), (24, texts[3])]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank int, n int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    assert rows_of(maxscore.ranked_search(d, q), "item_id", "rank", "doc_id", "score") == plain_search(docs, [x for x in items if x[1]])
    assert maxscore.ranked_search(d.filter("false"), q).count() == maxscore.ranked_search(d, q.filter("false")).count() == 0


def test_lists_below_the_floor_only_serve_probes():
    s = maxscore.Searches([], [], 100, 1000)
    rng = np.random.default_rng(5)
    term, lengths = [], []
    for _ in range(400):
        mine = np.flatnonzero(rng.random(6) < [0.9, 0.8, 0.7, 0.5, 0.1, 0.02])
        term += mine.tolist()
        lengths.append(len(mine))
    shard = maxscore.Shard.build(np.full(400, 10), np.array(lengths), np.array(term), rng.integers(1, 9, len(term)), s)
    terms, weights = np.arange(6), np.array([1, 2, 3, 8, 60, 400])
    at, scores = maxscore.search_shard(shard, terms, weights, 0, 400)
    for floor in (int(scores[9]), int(scores[9]) + 1, int(scores[0]) + 1):
        keep = scores >= floor
        pruned = maxscore.search_shard(shard, terms, weights, floor, 10)
        assert pruned[0].tolist() == at[keep][:10].tolist() and pruned[1].tolist() == scores[keep][:10].tolist()
    # a document without an essential term isn't looked at
    probed = []
    docs, impact, most = shard.lists[0]

    class Watched(np.ndarray):
        def __getitem__(self, key):
            probed.append(np.size(key))
            return super().__getitem__(key)

    shard.lists[0] = (docs.view(Watched), impact, most)
    maxscore.search_shard(shard, terms, weights, int(scores[2]), 10)
    assert max(probed, default=0) < len(docs) / 4


# near-duplicate embeddings


def plain_links(rows, threshold):
    """rows: distinct (id, label, vector)."""
    ok = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min(least[find(i)], default=None)
        out.append((r[0], links[i], c, r[0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize(("tile", "d"), [(8, 20), (40, 20), (8192, 20), (8, 3), (8, 1)])
def test_links_against_brute_force(spark, monkeypatch, tile, d):
    monkeypatch.setattr(pigeonhole, "TILE", tile)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(40):  # groups of all densities, some around the threshold
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows) * 7 % 1009, int(k % 3), (centre + rng.normal(size=d) * rng.choice([0.05, 0.25, 0.4])).tolist()))
    rows += [(2000 + i, rows[i][1], [x * 4.0 for x in rows[i][2]]) for i in range(20)]  # other lengths, same direction
    rows += [(2100 + i, 1, rows[2][2]) for i in range(25)]  # copies
    rows += [(2200, None, rows[2][2]), (2201, 1, None), (2202, 1, [0.0] * d), (2203, 1, [float("nan")] * d), (2204, 1, [None, *rows[2][2][1:]]), (2205, 1, []), (2206, 1, [*rows[2][2], 0.0])]
    rows += [(2207, 1, [x * 1e200 for x in rows[2][2]]), (2208, 1, [x * 1e-200 for x in rows[2][2]]), (None, 1, rows[2][2]), (None, 2, [1.0] * (d + 3))]
    df = spark.createDataFrame([(*r, 5, "x") for r in [*rows, rows[0], rows[4]]], "vec_id long, label int, embedding array<double>, m int, cell string")
    got = pigeonhole.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows_of(got, *got.columns) == plain_links(rows, 0.93)


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, [0.0])], "vec_id long, label int, embedding array<float>")
    assert rows_of(pigeonhole.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pigeonhole.near_duplicates(df.filter("false")).count() == 0


def test_cells_prune_and_lose_no_pair(monkeypatch):
    """Clustered vectors: few pairs are tested in any block, and all similar ones in one."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(150, 24)), 4, axis=0) + 0.1 * rng.normal(size=(600, 24))
    monkeypatch.setattr(pigeonhole, "TILE", 16)
    x = pigeonhole.scaled(x)
    blocks = pigeonhole.fit(x, 0.93, len(x))
    assert blocks.axes > 0 and abs(blocks.budgets.sum() - 0.14) < 1e-6
    cells = defaultdict(lambda: ([], []))
    for b, at, names, home in pigeonhole._placed(blocks, x):
        for i, c, h in zip(at.tolist(), names, home.tolist(), strict=True):
            cells[b, c][0 if h else 1].append(i)
    tested, found = 0, []
    for (b, _), (homes, guests) in cells.items():
        if not homes:
            continue
        mine = pigeonhole.Tile(blocks, b, x[homes])
        for other in (None, pigeonhole.Tile(blocks, b, x[guests])) if guests else (None,):
            names = np.array(homes)[mine.order], np.array(homes)[mine.order] if other is None else np.array(guests)[other.order]
            tested += sum(len(p) for p, _ in mine.pairs(other))
            found += [tuple(sorted(z)) for p, q in pigeonhole.linked(mine, other, 0.93) for z in zip(names[0][p].tolist(), names[1][q].tolist(), strict=True)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500
    assert tested < 0.1 * 600 * 599 / 2


# source audit


def plain_audit(docs, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        group = (lang or "", source or "")
        groups.add(group)
        words = term.findall((text or "").translate(lower))
        counts[group].update(words)
        held[group[0]].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in held.items()}
    p = {}
    for name, members in [(g, [g]) for g in groups] + [((lang,), [g for g in groups if g[0] == lang]) for lang, _ in groups]:
        c = sum((counts[g] for g in members), Counter())
        n, v = sum(c[t] for t in kept[name[0]]), len(kept[name[0]])
        p[name] = {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept[name[0]]}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for g in groups:
        pairs = [(-sum(f(p[g][t], p[o][t]) for t in kept[g[0]]), o[1].encode(), o[1]) for o in groups if o[0] == g[0] and o != g]
        out += [(*g, "pair", s, -v, n + 1) for n, (v, _, s) in enumerate(sorted(pairs))]
        terms = [(-f(p[g][t], p[g[:1]][t]), t.encode(), t) for t in kept[g[0]] if counts[g][t] and p[g][t] > p[g[:1]][t]]
        out += [(*g, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out, key=str)


def test_audit_against_brute_force(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "Beta", "ÜBER", "über", "it's", "x1y", "日本", "gamma", "DELTA", "once"]
    docs = []
    for k in range(120):
        odds = rng.random(len(words)) + (np.arange(len(words)) == k % 5)
        docs.append((" ".join(rng.choice(words, size=rng.integers(0, 30), p=odds / odds.sum())), ["en", "de", None][k % 3 if k % 7 else 0], [f"s{k % 5}", None, ""][0 if k % 4 else k % 3]))
    docs += [docs[5]] * 4 + [("lonely word", "xx", "a"), ("other", "xx", "b"), (None, "yy", "a"), ("", "yy", "b"), (None, "en", "empty"), ("long " * 20_000, "en", "s1")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "text string, lang string, source string, n int, p int")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for top in (200, 2):
        got = divergence.source_divergence(df, top=top)
        assert got.columns == columns
        assert rows_of(got, *columns) == plain_audit(docs, top=top)
    assert divergence.source_divergence(df.filter("false")).count() == 0


def test_audit_counts_by_group_numbers(spark):
    """Words are hashed and shuffled with one number, not two names; groups without terms stay; wide products are exact."""
    rows = [("x", "a", "B b c"), ("x", None, "b"), (None, "a", ""), (None, "a", None)]
    counts = divergence.term_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert [line.split("Aggregate")[1].split("]")[0].count("#") for line in plan.splitlines() if "Aggregate" in line] == [2]
    got = {(r["lang"], r["source"], r["term"], r["n"], r["docs"]) for r in counts.collect()}
    assert got == {("x", "a", "b", 2, 1), ("x", "a", "c", 1, 1), ("x", "", "b", 1, 1), ("", "a", None, 0, 0)} or got == {
        ("x", "a", "b", 2, 1), ("x", "a", "c", 1, 1), ("x", "", "b", 1, 1), ("", "a", None, 0, 2)
    }
    sizes = [(0, 5), (7, 9), (9_223_372_034, 10**10), (9_223_372_035, 10**10), (9_223_372_036, 10**10), (10**12, 3 * 10**12)]
    df = spark.createDataFrame([(n, total, 3) for n, total in sizes], "n long, total long, terms long")
    assert [r[0] for r in df.select(divergence._probability("n", "total", "terms")).collect()] == [1 + 10**9 * (n + 1) // (total + 3) for n, total in sizes]
