"""Near-duplicate embeddings by a subspace pigeonhole join (operator 12): exact, no pair of similar vectors is lost.

Unit vectors with a cosine of c or more have a squared distance of at most D = 2 - 2c.  All vectors are rotated onto the
principal axes of a sample, and the axes dealt over blocks of a few dimensions (axes with next to no variance are left
out).  Each block gets a share of D in proportion to the variance in it: two similar vectors are within the share in at
least one block, else all blocks together would exceed D.  So each block is range-joined under its own budget (cells
along its leading axes, then the distances in the block), and the union of the candidates is verified by exact cosines.

A pair is counted in the first block that has it within budget, so neither pairs nor candidates are ever written: a task
returns counts of links and a forest that connects what it has linked.  Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FloatType, LongType, StructType

from twigline.llm.ann import usable
from twigline.llm.common import staged, table
from twigline.llm.components import connected_components

THRESHOLD = 0.93
#: Classes that the rotation, the budgets and the number of cells' axes are fitted on, at most; any fit gives the same links.
SAMPLE_ROWS = 16_384
BLOCK_WIDTH = 8
#: Vectors of a cell that one task compares with each other, or with as many others; larger cells are cut into tiles.
TILE = 8192
#: Leading axes of a block that make cells, at most.
MAX_AXES = 4
#: Axes with less than so much of the greatest variance are in no block; what is left out only shortens distances.
LEAST_VARIANCE = 1e-3
#: Added to squared distances and cells' widths, for rounding.
SLACK = 1e-9
#: Pairs tested at once.
CHUNK = 1 << 18


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with a largest component between 0.5 and 1, by an exact power of two: squares neither overflow nor vanish."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, in double precision, after ``scaled``."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


@dataclass
class Blocks:
    """A rotation whose axes are dealt over blocks, leading ones first in each, and the blocks' budgets."""

    rotation: np.ndarray  # columns are axes, block after block
    starts: list[int]  # first axis of each block, and the end
    budgets: np.ndarray
    axes: int  # that make cells

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors on the axes.  Every component is summed in one order, whatever else is rotated with it: two tasks
        that meet a pair agree on the blocks in which it is within budget."""
        out = np.zeros((len(x), self.rotation.shape[1]))
        for j, row in enumerate(self.rotation):
            out += x[:, j : j + 1] * row
        norm = np.zeros(len(x))
        for j in range(x.shape[1]):
            norm += x[:, j] * x[:, j]
        return out / np.sqrt(norm)[:, None]

    def cells(self, y: np.ndarray, b: int) -> np.ndarray:
        """(least, home, most), each axes x rows: cells along each axis that hold what may be within budget of a row."""
        width = np.sqrt(self.budgets[b]) + SLACK
        part = y[:, self.starts[b] : self.starts[b] + self.axes].T
        return np.stack([np.floor((part + s * width) / width) for s in (-1, 0, 1)]).astype(np.int64)


def fit(sample: np.ndarray, threshold: float, largest: int, seed: int = 3) -> Blocks:
    """sample: rows after ``scaled``; largest: classes of the largest group of vectors that are compared."""
    d = sample.shape[1]
    x = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
    spread = np.cov(x.T).reshape(d, d) if len(x) > 1 else np.zeros((d, d))
    values, vectors = np.linalg.eigh(spread)
    values, vectors = np.maximum(values, 0)[::-1], vectors[:, ::-1]
    used = max(1, int((values > LEAST_VARIANCE * values[0]).sum()))
    count = -(-used // BLOCK_WIDTH)
    # leading axes first, each to the block with the least variance that has room
    blocks: list[list[int]] = [[] for _ in range(count)]
    held = np.zeros(count)
    for axis in range(used):
        b = min((b for b in range(count) if len(blocks[b]) < BLOCK_WIDTH), key=lambda b: (held[b], len(blocks[b])))
        blocks[b].append(axis)
        held[b] += values[axis]
    share = np.array([values[b].sum() for b in blocks]) + 1e-6
    starts = np.cumsum([0, *(len(b) for b in blocks)]).tolist()
    out = Blocks(vectors[:, np.concatenate(blocks)], starts, (2 - 2 * threshold + SLACK) * share / share.sum(), 0)
    most = min(MAX_AXES, *(len(b) for b in blocks))
    y = out.rotated(sample)
    while out.axes < most:  # as many axes as make the fullest cells small enough
        full = max(np.unique(out.cells(y, b)[1], axis=1, return_counts=True)[1].max() if out.axes else len(y) for b in range(len(blocks)))
        if full * largest <= TILE * len(y):
            break
        out.axes += 1
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of a list array, with zeros up to ``dimension``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), dimension))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _placed(blocks: Blocks, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray]]:
    """(block, rows, cells, whether it is the row's home): a row's home, and the later cells that it may have partners in.

    Two rows that may be within budget meet in one cell, the home of that whose home comes later in the order of cells.
    """
    y = blocks.rotated(x)
    for b in range(len(blocks.budgets)):
        if not blocks.axes:
            yield b, np.arange(len(y)), [b""] * len(y), np.ones(len(y), bool)
            continue
        least, home, most = blocks.cells(y, b)
        at, cells = np.arange(len(y)), home[:0].T
        for a in range(blocks.axes):
            # a cell below the home's on an earlier axis is an earlier cell; only later ones and the home remain
            width = (most[a] - least[a] + 1)[at]
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            at, cells = np.repeat(at, width), np.repeat(cells, width, axis=0)
            cells = np.column_stack([cells, least[a][at] + step]) if a else (least[a][at] + step)[:, None]
            own = home[: a + 1].T[at]
            differs = cells != own
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), 0)
            lines = np.arange(len(at))
            keep = cells[lines, first] >= own[lines, first]
            at, cells = at[keep], cells[keep]
        yield b, at, [c.tobytes() for c in cells.astype("<i4")], (cells == home.T[at]).all(axis=1)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) that connect what the links connect, by repeated minima."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


class Tile:
    """Rows of a cell, in the order of the block's leading axis, and pairs among them within the block's budget."""

    def __init__(self, blocks: Blocks, b: int, x: np.ndarray) -> None:
        y = blocks.rotated(x)
        lo, hi = blocks.starts[b], blocks.starts[b + 1]
        self.order = np.argsort(y[:, lo], kind="stable")
        self.blocks, self.b = blocks, b
        self.x, self.y = x[self.order], y[self.order]
        self.part = self.y[:, lo:hi]

    def pairs(self, other: Tile | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs that may be within budget, with another tile's or (None) among its own rows, each once."""
        budget = self.blocks.budgets[self.b] + SLACK
        reach = np.sqrt(budget) + SLACK
        to = self if other is None else other
        lead, size = to.part[:, 0], (to.part**2).sum(axis=1)
        for i in range(0, len(self.x), 512):
            some = self.part[i : i + 512]
            a = i if other is None else np.searchsorted(lead, some[0, 0] - reach)
            z = np.searchsorted(lead, some[-1, 0] + reach, side="right")
            for j in range(int(a), int(z), 4096):
                near = (some**2).sum(axis=1)[:, None] + size[j : min(z, j + 4096)] - 2 * some @ to.part[j : min(z, j + 4096)].T
                p, q = np.nonzero(near <= budget + SLACK)
                p, q = p + i, q + j
                if other is None:
                    p, q = p[p < q], q[p < q]
                for s in range(0, len(p), CHUNK):
                    yield p[s : s + CHUNK], q[s : s + CHUNK]

    def within(self, other: Tile, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether this block is the first with the pairs within budget."""
        first = np.ones(len(p), bool)
        for b in range(self.b + 1):
            distance = np.zeros(len(p))
            for j in range(self.blocks.starts[b], self.blocks.starts[b + 1]):
                step = self.y[p, j] - other.y[q, j]
                distance += step * step
            inside = distance <= self.blocks.budgets[b]
            first &= inside if b == self.b else ~inside
        return first


def linked(tile: Tile, other: Tile | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs with a cosine of the threshold or more that this block is to count."""
    to = tile if other is None else other
    for p, q in tile.pairs(other):
        near = cosines(tile.x[p], to.x[q]) >= threshold
        p, q = p[near], q[near]
        first = tile.within(to, p, q)
        if first.any():
            yield p[first], q[first]


def _links(classes: DataFrame, blocks: Blocks, threshold: float, group: list[str]) -> DataFrame:
    """(u, v, n): links of a class to n other vectors (v null), and links (u, v) that connect the linked classes."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(blocks)
    d = len(blocks.rotation)
    schema = classes.select(*group).schema

    def place(with_vectors: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    for b, rows, cells, home in _placed(shared.value, scaled(_matrix(part.column(part.num_columns - 1), d))):
                        kept = part.take(pa.array(rows)).columns
                        kept = kept if with_vectors else kept[: len(group)]
                        made = [pa.array(np.full(len(rows), b, np.int32)), pa.array(cells, pa.binary()), pa.array(home)]
                        yield pa.RecordBatch.from_arrays([*made, *kept], names if with_vectors else names[: 3 + len(group)])

        names = ["block", "cell", "home", *group, "c", "m", "v"]
        kinds = StructType.fromDDL("block int, cell binary, home boolean").fields + schema.fields
        if with_vectors:
            kinds += classes.select("c", "m", "v").schema.fields
        return classes.select(*group, "c", "m", "v").mapInArrow(run, StructType(list(kinds)))

    key = ["block", "cell", *group]
    # only cells with too many rows for one tile are told apart: at most one in TILE rows
    sizes = place(False).groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).filter(F.col("rows") > TILE)
    sizes = staged(sizes.select(*key, F.ceil(F.col("homes") / TILE).cast("int").alias("p"), F.ceil(F.col("rows") / TILE).cast("int").alias("r")), "cells")
    points = place(True).join(sizes, key, "left").na.fill(1, ["p", "r"])
    # homes are dealt over tiles 0 .. p - 1, all others over p .. r + p - 1; a tile of homes meets itself and later tiles
    guests = F.col("r")
    own = F.when(F.col("home"), F.pmod(F.xxhash64("c"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("c"), guests)).cast("int")
    tiles = F.col("p") + F.col("r")
    as_first = F.transform(F.sequence("own", tiles - 1), lambda t: F.struct(F.col("own").alias("s"), t.alias("t"), F.lit(True).alias("left")))
    as_second = F.transform(
        F.sequence(F.lit(0), F.least(F.col("own"), F.col("p")) - 1), lambda s: F.struct(s.alias("s"), F.col("own").alias("t"), F.lit(False).alias("left"))
    )
    empty = F.slice(as_first, 1, 0)
    cells = F.concat(F.when(F.col("home"), as_first).otherwise(empty), F.when(F.col("own") > 0, as_second).otherwise(empty))
    points = points.withColumn("own", own).select(*key, "c", "m", "v", "home", F.explode(F.when(F.col("r") == 1, F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t"), F.col("home").alias("left")))).otherwise(cells)).alias("tile"))
    points = points.select(*key, "c", "m", "v", "tile.*")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        bl, b = shared.value, int(rows["block"].iloc[0])
        left, right = rows[rows["left"]], rows[~rows["left"]]
        us, vs, counts = [], [], {}
        if len(left):
            x = scaled(np.stack([np.pad(v, (0, d - len(v))) for v in left["v"]]).astype(np.float64))
            mine = Tile(bl, b, x)
            c, m = left["c"].to_numpy()[mine.order], left["m"].to_numpy()[mine.order]
            runs = [(None, mine, c, m)] if left["s"].iloc[0] == left["t"].iloc[0] else []
            if len(right):
                theirs = Tile(bl, b, scaled(np.stack([np.pad(v, (0, d - len(v))) for v in right["v"]]).astype(np.float64)))
                runs.append((theirs, theirs, right["c"].to_numpy()[theirs.order], right["m"].to_numpy()[theirs.order]))
            for other, to, c2, m2 in runs:
                n1, n2 = np.zeros(len(c), np.int64), np.zeros(len(c2), np.int64)
                for p, q in linked(mine, other, threshold):
                    np.add.at(n1, p, m2[q])
                    np.add.at(n2, q, m[p])
                    u, v = _forest(c[p], c2[q])
                    us.append(u)
                    vs.append(v)
                for names, n in ((c, n1), (c2, n2)):
                    for i in np.flatnonzero(n):
                        counts[int(names[i])] = counts.get(int(names[i]), 0) + int(n[i])
        u, v = _forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
        found = pd.DataFrame({"u": [*counts, *u.tolist()], "v": pd.array([None] * len(counts) + v.tolist(), "Int64"), "n": pd.array([*counts.values(), *[None] * len(u)], "Int64")})
        return found.astype({"u": "int64"})

    return points.groupBy(*key, "s", "t").applyInPandas(compare, "u long, v long, n long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector.

    Vectors link if their labels and lengths are equal, not null, and their cosine is ``threshold`` (above 0, below 1)
    or more.  n_links counts the other vectors linked directly, component_id is the smallest id reachable, and kept marks
    the row that has it.  Vectors that are null, zero, or hold null or non-finite components, and those without a label,
    link with nothing: they are kept.  A repeated (id, vector, label) row counts once; an id with several vectors has a
    row for each.  A null id is a vector like others but never the smallest id, unless its component has no other; it
    is kept only then.  An empty table gives no rows; other columns are not read.

    Skew: copies are one class; a cell with more than ``TILE`` rows is cut into tiles, and each two of them are a group
    of their own; a task returns counts and forests, not pairs.
    """
    spark = vectors.sparkSession
    ids = vectors.schema[id_col].dataType
    # single precision stays what it is until it is compared: half the bytes to shuffle
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "array<float>" if isinstance(element, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v")).distinct()
    takes_part = F.col("label").isNotNull() & usable("v")
    group = ["label", "size"]
    classes = rows.filter(takes_part).groupBy("label", "v").agg(F.count("*").alias("m"), F.min("i").alias("least"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("c"), "label", F.size("v").alias("size"), "m", "least", "v"), "classes")
    largest = classes.groupBy(*group).count().agg(F.max("count"), F.max("size")).first()
    out = StructType().add(id_col, ids).add("n_links", LongType()).add("component_id", ids).add("kept", BooleanType())
    named = [F.col("i").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("root").alias("component_id"), F.col("i").eqNullSafe(F.col("root")).alias("kept")]
    if largest[0] is None:
        return rows.withColumn("links", F.lit(0)).withColumn("root", F.col("i")).select(*named).to(out)
    sample = classes.orderBy(F.xxhash64("v"), "least", "label").limit(SAMPLE_ROWS).select("v").toArrow().column(0).combine_chunks()
    blocks = fit(scaled(_matrix(sample, largest[1])), threshold, largest[0])
    found = staged(_links(classes, blocks, threshold, group), "links")
    links = found.filter("v is null").groupBy(F.col("u").alias("c")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("v is not null").select("u", "v"))
    info = classes.select("c", "label", "v", "m", "least").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    info = info.withColumn("root_c", F.coalesce("root", "c")).drop("root")
    info = staged(info, "classes-linked")
    smallest = info.filter("n is not null").groupBy("root_c").agg(F.min("least").alias("root"))
    info = info.join(smallest, "root_c", "left")
    info = info.select("label", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("root"))
    member = rows.filter(takes_part).join(info, ["label", "v"])
    alone = rows.filter(~F.coalesce(takes_part, F.lit(False))).withColumn("links", F.lit(0)).withColumn("root", F.col("i"))
    return member.select(*named).unionByName(alone.select(*named))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of a label, at a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id != b.vec_id
    AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD} AND NOT isnan(list_cosine_similarity(a.v, b.v))),
reached AS (SELECT vec_id AS u, vec_id AS r FROM e UNION SELECT l.u, reached.r FROM links l JOIN reached ON reached.u = l.w)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept
FROM e JOIN reached ON u = vec_id GROUP BY vec_id"""
