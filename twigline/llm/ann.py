"""Approximate nearest neighbours by largest inner product (operator 2): inverted file with product quantisation.

Coarse centroids (k-means) cut the vectors into lists; residuals are product-quantised; a query's asymmetric distance
tables score the codes of the lists it probes, and those that may be among the best are ranked again by exact inner
products.  After Jégou, Douze and Schmid, "Product Quantization for Nearest Neighbor Search" (2011).

Inside, vectors are divided by the largest component and queries by their length, as table sums have single precision.

Equal vectors are one class with its smallest ids, so any number of copies costs one candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twigline.llm.common import staged

#: Distinct vectors that the centroids and codebooks are fitted on, at most.
TRAIN_ROWS = 16_384
#: Distinct vectors, drawn apart from those, that say how far a query has to look: what is fitted lies nearer its centroid.
FIT_ROWS = 8192
MAX_LISTS = 4096
SUBSPACE_WIDTH = 4
CODES = 256
#: Best codes of a block that bound a query's k-th score there; every code that may pass the bound is ranked exactly.
REFINE = 48
#: Share of a query's neighbours whose codes are to reach their exact scores with the margin added.
MARGIN_RECALL = 0.99
#: Numbers multiplied at a time in exact ranking.
EXACT_CELLS = 1 << 22
#: Share of a query's neighbours that are to lie in the lists it probes, and sample queries that fit their number to it.
PROBE_RECALL, PROBE_QUERIES = 0.97, 512
#: Vectors of a block (several small lists, or a part of a large one), and queries on it, that are handled together.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK_QUERIES = 4096, 8192, 512


@dataclass
class IvfPq:
    centroids: np.ndarray  # lists x dimension
    books: np.ndarray  # subspaces x codes x width
    dimension: int  # before padding to whole subspaces

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(self.padded(x), self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = self.padded(x) - self.centroids[lists]
        w = self.books.shape[2]
        codes = [_nearest(r[:, m * w : (m + 1) * w], self.books[m]) for m in range(len(self.books))]
        return np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's subvectors with all codewords: queries x subspaces x codes."""
        q = self.padded(q).reshape(len(q), len(self.books), -1)
        return np.einsum("qmw,mcw->qmc", q, self.books).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, max(1, len(x)), 4096)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), size=int((~full).sum()))]
    return centres


def train(sample: np.ndarray, lists: int, seed: int = 11) -> IvfPq:
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    w = min(SUBSPACE_WIDTH, dimension)
    x = np.pad(sample, ((0, 0), (0, -dimension % w))).astype(np.float64)
    centroids = _kmeans(x, min(lists, len(x)), rng)
    r = x - centroids[_nearest(x, centroids)]
    r = r[rng.permutation(len(r))[:8192]]
    books = np.zeros((x.shape[1] // w, CODES, w))
    for m in range(len(books)):
        part = r[:, m * w : (m + 1) * w]
        k = min(CODES, len(part))
        books[m, :k] = _kmeans(part, k, rng, 5)
        books[m, k:] = books[m, 0]
    return IvfPq(centroids, books, dimension)


def list_count(classes: int) -> int:
    return max(1, min(MAX_LISTS, round(4 * math.sqrt(classes))))


def directions(q: np.ndarray) -> np.ndarray:
    """Vectors of length 1, however large or small the components are."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.sqrt((q**2).sum(axis=1, keepdims=True))


def _sample_neighbours(x: np.ndarray, asked: np.ndarray, k: int, total: int) -> np.ndarray:
    """Places in the sample of each query's neighbours, equal vectors left out; so many that they lie about as near as
    the ``k`` nearest of all ``total`` vectors, or at least one."""
    near = min(len(x) - 1, max(1, round(k * len(x) / max(1, total))))
    if near < 1 or not len(asked):
        return np.empty((0, 0), dtype=np.int64)
    scores = asked @ x.T
    place = {v.tobytes(): i for i, v in enumerate(x)}
    for i, v in enumerate(asked):
        if v.tobytes() in place:
            scores[i, place[v.tobytes()]] = -np.inf
    return np.argpartition(-scores, near - 1, axis=1)[:, :near]


def probe_count(sample: np.ndarray, model: IvfPq, k: int, total: int, seed: int = 5, asked: np.ndarray | None = None) -> int:
    """Lists to probe, in the order of their centroids' inner products, for ``PROBE_RECALL`` of the true neighbours.

    Fitted on sample queries, ``asked`` or some of the sample itself, and their exact neighbours among the sample.
    """
    if asked is None:
        asked = sample[np.random.default_rng(seed).permutation(len(sample))[:PROBE_QUERIES]]
    best = _sample_neighbours(sample.astype(np.float64), asked.astype(np.float64), k, total)
    if not best.size or len(model.centroids) == 1:
        return len(model.centroids)
    order = np.argsort(-(model.padded(asked) @ model.centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    found = np.take_along_axis(place, model.assign(sample)[best], axis=1)
    return int(np.quantile(found, PROBE_RECALL, method="higher")) + 1


def code_margin(sample: np.ndarray, model: IvfPq, k: int, total: int, asked: np.ndarray) -> float:
    """What part of a code's error, times the query's length, brings ``MARGIN_RECALL`` of the true neighbours' code
    scores up to their exact ones; with 1 none can be lost."""
    best = _sample_neighbours(sample, asked, k, total)
    if not best.size:
        return 1.0
    error = model.padded(sample)
    lists = model.assign(sample)
    error = error - model.decode(model.encode(sample, lists), lists)
    size = np.sqrt((error**2).sum(axis=1))
    lost = np.take_along_axis(model.padded(directions(asked)) @ error.T, best, axis=1) / np.maximum(size[best], 1e-300)
    return float(min(1.0, max(0.0, np.quantile(lost, MARGIN_RECALL, method="higher"))))


def list_blocks(centroids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, parts) of every list: lists that lie near each other share a block of about ``BLOCK_ROWS`` vectors; a
    larger list is a block by itself, in so many parts."""
    order = []
    todo = [np.arange(len(centroids))]
    while todo:  # halves along the axis on which the centroids differ most
        at = todo.pop()
        if len(at) <= 2:
            order += at.tolist()
            continue
        x = centroids[at]
        line = np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")
        todo += [at[line[len(at) // 2 :]], at[line[: len(at) // 2]]]
    block, parts = np.zeros(len(centroids), dtype=np.int32), np.ones(len(centroids), dtype=np.int32)
    now, held = -1, BLOCK_ROWS
    for i in order:
        if held + sizes[i] > BLOCK_ROWS:
            now, held = now + 1, 0
        block[i], held = now, held + sizes[i]
        parts[i] = max(1, -(-int(sizes[i]) // BLOCK_ROWS))
    return block, parts


def usable(vec: str | Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64) if len(column) else np.empty((0, 1))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    probes: int | None = None,
    refine: int = REFINE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors``, its own id left out.

    ``queries`` has the same two columns.  score is the exact inner product in double precision; ties go to the smaller
    id.  How many lists a query probes is fitted on the sample (``probe_count``) unless given as ``probes``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with another
    length than the most frequent one (ties: the shorter), nor null ids.  A repeated (id, vector) row counts once, an id
    with several vectors as each of them; rows with the query's id are never its neighbours.  Fewer candidates than k give fewer rows; empty tables give none.

    Skew: copies are one class; small lists share a block, large lists and the queries on a block are cut into parts of
    bounded size; a query is sent once to every block that holds one of its lists.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return rows.filter(F.col("id").isNotNull() & usable("v"))

    rows = clean(vectors)
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("count"), largest.alias("largest")).orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    dimension, scale = lengths["d"], lengths["largest"]
    rows, asked = (x.filter(F.size("v") == dimension).distinct() for x in (rows, clean(queries)))

    # classes of equal vectors, each with its k + 1 smallest ids; "c" numbers them, "least" is the smallest id
    first = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    numbered = [F.monotonically_increasing_id().alias("c"), F.col("ids")[0].alias("least"), "v", "ids"]
    classes = staged(classes.select(*numbered), "classes")
    total = classes.count()
    # one row for each distinct query vector; "q" numbers them
    asking = staged(asked.select("v").distinct().select("v", F.monotonically_increasing_id().alias("q")), "asking")
    def some(df: DataFrame, seed: int, n: int) -> np.ndarray:
        return _matrix(df.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(n).select("v").toArrow().column(0))

    model = train(some(classes, 1, TRAIN_ROWS) / scale, list_count(total))
    lists = len(model.centroids)
    fit, fit_asked = some(classes, 2, FIT_ROWS) / scale, some(asking, 3, PROBE_QUERIES) / scale
    n_probes = probes or probe_count(fit, model, k, total, asked=fit_asked)
    margin = code_margin(fit, model, k, total, fit_asked)
    # at most MAX_LISTS centroids, CODES codewords and FIT_ROWS vectors
    shared, bounding = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(fit)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2)) / scale
                where = m.assign(x)
                codes = [r.tobytes() for r in m.encode(x, where)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(where.astype(np.int32)), pa.array(codes, pa.binary()), batch.column(2)],
                    ["c", "least", "list", "code", "v"],
                )

    kind = "c long, least long, list int, code binary, v array<double>"
    indexed = staged(classes.select("c", "least", "v").mapInArrow(index, kind), "index")
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    size = np.array([sizes.get(i, 0) for i in range(lists)])
    block, parts = list_blocks(model.centroids, size)
    least = 8 * (k + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that holds a list to probe."""
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = directions(_matrix(part.column(0)))
                # the k + 1 best of the fitted sample: no neighbour lies farther
                bound = np.full(len(x), -np.inf)
                if len(bounding.value) > k:
                    for lo in range(0, len(x), 256):
                        bound[lo : lo + 256] = np.partition(x[lo : lo + 256] @ bounding.value.T, -k - 1, axis=1)[:, -k - 1]
                order = np.argsort(-(m.padded(x) @ m.centroids.T), axis=1, kind="stable")
                # so many lists that there are candidates enough
                need = np.maximum(n_probes, (np.cumsum(size[order], axis=1) < least).sum(axis=1) + 1)
                owner, blocks, chosen = [], [], []
                for i, n in enumerate(np.minimum(need, lists)):
                    mine = order[i, :n]
                    mine = mine[np.argsort(block[mine], kind="stable")]
                    names, starts = np.unique(block[mine], return_index=True)
                    owner += [i] * len(names)
                    blocks += names.tolist()
                    chosen += [run.astype("<i4").tobytes() for run in np.split(mine, starts[1:])]
                names = part.column(1).take(pa.array(owner)), part.column(0).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [names[0], pa.array(blocks, pa.int32()), pa.array(chosen, pa.binary()), names[1], pa.array(bound[owner])],
                    ["q", "block", "lists", "qv", "bound"],
                )

    probed = staged(asking.select("v", "q").mapInArrow(probe, "q long, block int, lists binary, qv array<double>, bound double"), "probes")
    asks = {r["block"]: r["count"] for r in probed.groupBy("block").count().collect()}  # at most as many rows as lists
    blocks = int(block.max()) + 1
    in_parts = np.ones(blocks, dtype=np.int64)
    np.maximum.at(in_parts, block, parts)
    in_asks = [max(1, -(-asks.get(b, 0) // BLOCK_QUERIES)) for b in range(blocks)]

    def of_block(values: list[int]) -> Column:
        return F.array(*[F.lit(int(x)) for x in values])[F.col("block")]

    left = indexed.withColumn("block", F.array(*[F.lit(int(x)) for x in block])[F.col("list")])
    left = left.withColumn("b", F.pmod(F.xxhash64("c"), of_block(in_parts).cast("long")).cast("int"))
    left = left.withColumn("a", F.explode(F.sequence(F.lit(0), of_block(in_asks) - 1)))
    right = probed.withColumn("a", F.pmod(F.xxhash64("q"), of_block(in_asks).cast("long")).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), of_block(in_parts) - 1)))

    def search(key: tuple, cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(cand):
            cand = cand.sort_values("list", kind="stable")
            m = shared.value
            x = np.stack(cand["v"].to_numpy())
            c, ids = cand["c"].to_numpy(), cand["least"].to_numpy()
            codes = np.stack([np.frombuffer(b, np.uint8) for b in cand["code"]])
            names, starts = np.unique(cand["list"].to_numpy(), return_index=True)
            runs = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True), strict=True))
            spread = code_spread(m, x / scale, cand["list"].to_numpy(), codes, margin)
            for at in range(0, len(ask), CHUNK_QUERIES):
                asks = ask.iloc[at : at + CHUNK_QUERIES]
                out.append(_search(m, x, c, ids, codes, runs, asks, k, refine, spread, scale))
        q_, c_, i_, s_ = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"q": q_, "c": c_, "least": i_, "score": s_})

    keys = ["block", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q long, c long, least long, score double")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "least", "c")
    top = found.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1)
    # ids of the classes; per query vector the k + 1 best ids
    items = top.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    items = items.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    best = items.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    best = best.join(asking, "q").select("v", "best")
    per_query = asked.select(F.col("id").alias("query_id"), "v").join(best, "v")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return per_query.select("query_id", F.posexplode(others).alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"
    )


def code_spread(m: IvfPq, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, margin: float) -> np.ndarray:
    """How far above its code's score a vector's own may lie for a query of length 1, rounding included."""
    x = m.padded(x)
    length = lambda y: np.sqrt((y**2).sum(axis=1))
    return margin * length(x - m.decode(codes, lists)) + 1e-6 * (length(m.centroids[lists]) + length(x))


def _products(x: np.ndarray, q: np.ndarray, at: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Inner products of pairs; one after the other, so that a score does not depend on what else is searched."""
    step = max(1, EXACT_CELLS // x.shape[1])
    parts = [(x[at[i : i + step]] * q[who[i : i + step]]).sum(axis=1) for i in range(0, len(at), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _search(m: IvfPq, x, c, ids, codes, runs: dict, ask: pd.DataFrame, k: int, refine: int, spread, scale: float):  # noqa: ANN001, ANN202
    """The best of a block for some queries: by asymmetric distances in the lists each of them probes, then exactly."""
    q = np.stack(ask["qv"].to_numpy())
    unit, scaled = directions(q), x / scale
    bound = ask["bound"].to_numpy().copy()
    names = ask["q"].to_numpy()
    wanted = [np.frombuffer(b, "<i4") for b in ask["lists"]]
    owner = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
    asked = np.concatenate(wanted)
    order = np.argsort(asked, kind="stable")
    asked, owner = asked[order], owner[order]
    tables = m.tables(unit)
    # the highest scores that the codes allow
    most = np.full((len(q), len(x)), -np.inf, dtype=np.float32)
    lists, starts = np.unique(asked, return_index=True)
    for number, a, b in zip(lists.tolist(), starts.tolist(), [*starts[1:].tolist(), len(asked)], strict=True):
        if number not in runs:
            continue
        lo, hi = runs[number]
        who, code = owner[a:b], codes[lo:hi]
        part = (m.padded(unit[who]) @ m.centroids[number])[:, None].astype(np.float32) + spread[lo:hi].astype(np.float32)
        mine = tables if len(who) == len(q) else tables[who]
        for s in range(code.shape[1]):
            part += mine[:, s, :].take(code[:, s], axis=1)
        most[who, lo:hi] = part
    # where many may pass the bound, the exact scores of the best codes raise it
    r = max(refine, k + 1)
    many = np.flatnonzero((most >= bound[:, None]).sum(axis=1) > r)
    if len(many):
        best = np.argpartition(-(most[many] - spread.astype(np.float32)), r - 1, axis=1)[:, :r]
        exact = _products(scaled, unit, best.ravel(), np.repeat(many, r)).reshape(len(many), r)
        exact[np.take_along_axis(most[many], best, axis=1) == -np.inf] = -np.inf
        bound[many] = np.maximum(bound[many], np.partition(exact, r - k - 1, axis=1)[:, r - k - 1])
    who, at = np.nonzero((most >= bound[:, None]) & (most > -np.inf))
    exact = _products(x, q, at, who)
    order = np.lexsort((ids[at], -exact, who))
    who, at, exact = who[order], at[order], exact[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank <= k
    who, at = who[keep], at[keep]
    return names[who], c[at], ids[at], exact[keep]


def op2_nearest(spark, sf_dir):  # noqa: ANN001, ANN201
    """The 20 nearest of every vector whose id is divisible by 20, among all other vectors."""
    from twigline.llm.common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))
