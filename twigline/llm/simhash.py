"""SimHash near-duplicate detection by a binary-trie self-join (operator 8).

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.  Distinct fingerprints are joined with
themselves by walking pairs of nodes of a binary trie together, adding up the bits in which the two branches differ,
and dropping a pair of nodes as soon as the sum exceeds its budget.

Of two fingerprints at most ``d`` bits apart, either the leading halves differ in at most d // 2 bits, or the trailing
halves in at most d - d // 2 - 1.  So two walks with small budgets on the leading half, one over the trie of the
fingerprints and one over the trie of the fingerprints with their halves swapped, find every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twigline.llm.common import staged
from twigline.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: Fingerprints in a trie node that is handled as one task's side, on average.
NODE_SIZE = 4096
#: Node pairs held by a walk at once, more are put off, and fingerprints compared at once: bounds on a worker's arrays.
FRONTIER, COMPARED = 1 << 15, 1 << 17


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority vote of the shingle hashes of a whole text; zero for no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle_words, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    votes, n = np.zeros(64, dtype=np.int64), len(first)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 32768):
        spans = zip(first[at : at + 32768].tolist(), last[at : at + 32768].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long, and text_hash if asked. Narrow; reads whole texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if hashed:
        rows = rows.select("doc_id", text_hash("text").alias("text_hash"), "text")
    names = rows.columns[:-1]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            fps = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(compute, "doc_id long, text_hash string, fp long" if hashed else "doc_id long, fp long")


def text_hash(text_col: str) -> Column:
    """128 bits of a text as a string; null for null."""
    return F.md5(F.col(text_col).cast("string"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Labels:
    """Union-find over positions, joined in bulk; remembers which runs of positions are one component already."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.changes = np.zeros(n, dtype=np.int64)
        self._refresh()

    def _refresh(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        self.label = label
        self._refresh()

    def joined(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Where all positions of both runs already are in one component."""
        c, label = self.changes, self.label
        return (c[alo] == c[ahi - 1]) & (c[blo] == c[bhi - 1]) & (label[alo] == label[blo])


def trie_links(fps: np.ndarray, left: int, top: int, lead_budget: int, budget: int, labels: _Labels) -> None:
    """Walk pairs of trie nodes over ``fps``: the first ``left`` fingerprints against the rest, or all with themselves.

    Each side is sorted.  ``left`` is 0 for a self-join.  ``top`` is the highest bit in which the members of one side
    may differ.  Links (at most ``lead_budget`` differing bits in the leading 32 and ``budget`` in all) go to labels.
    """
    n = len(fps)
    if left:
        lo, hi, at_lo, at_hi = [0], [left], [left], [n]
        err = [int(popcount((fps[:1] ^ fps[left : left + 1]) >> np.uint64(top + 1))[0]) if top < 63 else 0]
    else:
        lo, hi, at_lo, at_hi, err = [0], [n], [0], [n], [0]
    todo = [(top, *(np.array(x, dtype=np.int64) for x in (lo, hi, at_lo, at_hi, err)))]

    def middle(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """First position in each run whose bit is set."""
        one = np.uint64(1 << bit)
        target = (fps[lo] & ~np.uint64((1 << (bit + 1)) - 1)) | one
        if left:
            out = np.where(lo < left, np.searchsorted(fps[:left], target), left + np.searchsorted(fps[left:], target))
        else:
            out = np.searchsorted(fps, target)
        return np.clip(out, lo, hi)

    while todo:
        bit, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONTIER:  # put half off: memory stays bounded
            h = len(alo) // 2
            todo.append((bit, alo[h:], ahi[h:], blo[h:], bhi[h:], err[h:]))
            alo, ahi, blo, bhi, err = alo[:h], ahi[:h], blo[:h], bhi[:h], err[:h]
        keep = ~labels.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, err = alo[keep], ahi[keep], blo[keep], bhi[keep], err[keep]
        if not len(alo):
            continue
        pairs = (ahi - alo) * (bhi - blo)
        small = (pairs <= 32) | (bit < 0)
        if small.any():
            _compare(fps, alo[small], ahi[small], blo[small], bhi[small], lead_budget, budget, labels)
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
            if not len(alo):
                continue
        amid, bmid = middle(alo, ahi, bit), middle(blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        limit = lead_budget if bit >= 32 else budget
        cross = err + 1 <= limit
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            tuple(x[cross] for x in (alo, amid, bmid, bhi, err + 1)),
            tuple(x[cross & ~same] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        full = (alo < ahi) & (blo < bhi)
        if full.any():
            todo.append((bit - 1, alo[full], ahi[full], blo[full], bhi[full], err[full]))


def _compare(fps, alo, ahi, blo, bhi, lead_budget, budget, labels) -> None:  # noqa: ANN001
    """Compare all members of small node pairs (or of full-depth nodes) bit by bit."""
    width = bhi - blo
    pairs = (ahi - alo) * width
    ends = np.cumsum(pairs)
    at = 0
    while at < len(pairs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, side="right")))
        reps = pairs[at:stop]
        k = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        w = np.repeat(width[at:stop], reps)
        i, j = np.repeat(alo[at:stop], reps) + k // w, np.repeat(blo[at:stop], reps) + k % w
        x = fps[i] ^ fps[j]
        near = (popcount(x) <= budget) & (popcount(x >> np.uint64(32)) <= lead_budget) & (i != j)
        if near.any():
            labels.join(i[near], j[near])
        at = stop


def links_in_task(a: np.ndarray, b: np.ndarray, top: int, lead_budget: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two trie nodes (or within one, for empty b), as pairs of fingerprints."""
    fps = np.concatenate([np.sort(a), np.sort(b)])
    left = len(a) if len(b) else 0
    labels = _Labels(len(fps))
    if budget > 1:  # close ones first: runs that are one component already need no further walk
        trie_links(fps, left, top, min(1, lead_budget), 1, labels)
    trie_links(fps, left, top, lead_budget, budget, labels)
    away = np.flatnonzero(labels.label != np.arange(len(fps)))
    return fps[away], fps[labels.label[away]]


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(min(bits, budget) + 1) for c in combinations(range(bits), k)]


def fingerprint_links(distinct: DataFrame, n: int, max_distance: int = MAX_DISTANCE, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp), enough to connect all that are near.

    The trie is cut at a depth where nodes hold about ``node_size`` fingerprints on average; every pair of cut nodes
    within the leading budget is one group, and a fingerprint goes to the groups of its node.  A group of over
    4 x node_size fingerprints is split into cells by further trie bits, again only for pairs of cells within budget.
    """
    depth = max(0, min(20, math.ceil(math.log2(max(1, n) / node_size))))
    half = max_distance // 2
    parts = [_walk(distinct.select("fp"), depth, half, max_distance, node_size, swap=False)]
    if max_distance - half - 1 >= 0:
        swapped = distinct.select(F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)").alias("fp"))
        parts.append(_walk(swapped, depth, max_distance - half - 1, max_distance, node_size, swap=True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _walk(fps: DataFrame, depth: int, lead_budget: int, budget: int, node_size: int, swap: bool) -> DataFrame:
    deep = min(31, depth + 8)  # the further bits that split crowded nodes
    node = F.shiftrightunsigned("fp", 64 - depth).cast("int") if depth else F.lit(0)
    fine = F.shiftrightunsigned("fp", 64 - deep).cast("int").bitwiseAND((1 << (deep - depth)) - 1)
    fps = fps.select("fp", node.alias("node"), fine.alias("fine"))
    # one row per node: bits by which a crowded node is split
    crowd = fps.groupBy("node").agg(F.count("*").alias("size"))
    crowd = crowd.filter(F.col("size") > 4 * node_size).select(
        "node", F.least(F.lit(deep - depth), F.ceil(F.log2(F.col("size") / node_size)).cast("int")).alias("split")
    )
    masks = F.array(*[F.lit(m) for m in _masks(depth, lead_budget)])
    rows = fps.select("*", F.explode(masks).alias("mask"))
    rows = rows.withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    # at most 2 ** 20 rows of two integers, whatever the input
    rows = rows.join(F.broadcast(crowd.withColumnRenamed("split", "s1")), "node", "left")
    rows = rows.join(F.broadcast(crowd.select(F.col("node").alias("other"), F.col("split").alias("s2"))), "other", "left")
    rows = rows.withColumn("split", F.greatest(F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0))))
    # cells of crowded pairs: leading bits of "fine", and the masks between cells that are within the budget
    cell = F.expr(f"cast(shiftrightunsigned(fine, {deep - depth} - split) as int)")
    left_over = lead_budget - F.bit_count("mask")
    choices = F.array(F.array(F.array(F.lit(0))), *[
        F.array(*[F.array(*[F.lit(m) for m in _masks(s, b)]) for b in range(lead_budget + 1)]) for s in range(1, deep - depth + 1)
    ])
    picked = F.when(F.col("split") == 0, F.array(F.lit(0))).otherwise(
        F.element_at(F.element_at(choices, F.col("split") + 1), left_over.cast("int") + 1)
    )
    rows = rows.withColumn("cell", cell).withColumn("cell_mask", F.explode(picked))
    rows = rows.withColumn("cell_to", F.col("cell").bitwiseXOR(F.col("cell_mask")))
    # a pair of (node, cell) is named by its smaller end; rows of that end are the left side
    mine = F.struct("node", "cell")
    theirs = F.struct(F.col("other").alias("node"), F.col("cell_to").alias("cell"))
    rows = rows.select(
        "fp", F.least(mine, theirs).alias("low"), "mask", "cell_mask", "split", (mine <= theirs).alias("is_low")
    ).select("fp", "low.node", "low.cell", "mask", "cell_mask", "split", "is_low")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        low = pdf["is_low"].to_numpy(bool)
        itself = key[2] == 0 and key[3] == 0
        a, b = (fp, fp[:0]) if itself else (fp[low], fp[~low])
        if not itself and (not len(a) or not len(b)):
            u = v = fp[:0]
        else:
            u, v = links_in_task(a, b, 63 - depth - int(key[4]), lead_budget, budget)
        if swap:
            u, v = ((x << np.uint64(32)) | (x >> np.uint64(32)) for x in (u, v))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return rows.groupBy("node", "cell", "mask", "cell_mask", "split").applyInPandas(join, "u long, v long")


def _rooted(by_fp: DataFrame, max_distance: int) -> DataFrame:
    """(fp, first, root): the component of every distinct fingerprint."""
    links = fingerprint_links(by_fp, by_fp.count(), max_distance)
    roots = connected_components(links)
    named = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return staged(named.select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")


def simhash_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, text_hash) of one row of every component: the smallest id, nulls last, then the smallest hash.

    Rows of one id with different texts may be of different components; null ids are told apart by their texts.  Rows
    equal in id and text are one component and one key.  Null and empty texts are one component with all that is near.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    by_fp = fingerprints(docs, id_col, text_col, hashed=True).groupBy("fp").agg(F.min(key).alias("first"))
    named = _rooted(staged(by_fp, "distinct"), max_distance)
    return named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_distance`` differing bits, itself
    included.  Null and empty texts (no words) have fingerprint zero and are linked like any other; a null doc_id is
    carried along and never is a component id unless all ids of the component are null; repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    by_doc = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = staged(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = _rooted(by_fp, max_distance)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "component_id")
    out = by_doc.join(of_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir):  # noqa: ANN001, ANN201
    """Near-duplicate components of all documents."""
    from twigline.llm.common import table

    return simhash_components(table(spark, sf_dir, "documents"))
