"""Packing of documents into fixed-length token sequences (operator 1).

First-fit decreasing on a tournament tree of bin capacities, run independently in randomised groups of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigline.llm.common import stable_key

#: Tokens of one randomised group; bounds a task's memory (16 bytes a token at most).
GROUP_TOKENS = 2_000_000
SEQUENCE_TOKENS = 2048
#: Tasks that equal rows are dealt over.
SALTS = 1024


class CapacityTree:
    """Tournament tree over bins: every inner node holds the largest free capacity below it.

    ``place`` finds the leftmost bin with room in O(log bins).
    """

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)
        self.capacity = capacity
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece; sizes above the capacity are an error."""
        free, node = self.free, 1
        if size > free[1]:
            raise ValueError(f"no bin has room for {size}")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bin_, offset = node - self.leaves, self.capacity - free[node]
        left = free[node] - size
        free[node] = left
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        self.used = max(self.used, bin_ + 1)
        return bin_, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """(bin, offset) of each size, and the number of bins. Ties keep their order."""
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    if not sizes:
        return places, 0
    tree = CapacityTree(len(sizes), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        places[i] = tree.place(sizes[i])
    return places, tree.used


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    vocabulary: str | None = None,
    group_tokens: int = GROUP_TOKENS,
    cache_words: int | None = None,
    slice_bytes: int = 4_000_000,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence and its ids (little-endian unsigned 32 bits).

    Documents are shuffled by a hash of id and text, so every group is a random draw; within a task, groups close at
    ``group_tokens``.  Copies of a row are dealt over ``SALTS`` tasks.  A document is cut at multiples of the sequence length; its full-length pieces are sequences by
    themselves, and the remainders of a group are packed by first-fit decreasing.  Sequence ids are unique over the
    table (task number and running number), offsets gapless from 0.

    Null text counts as empty (a piece with the end id alone); null ids stay null; repeated rows are packed once each;
    an empty table gives no rows; other columns are ignored, whatever their names.  ``cache_words`` bounds the words a
    worker remembers, ``slice_bytes`` the texts it encodes at once (less memory, more time; the ids are the same).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    rows = rows.withColumns({"_h": stable_key("doc_id", "text"), "_s": salt})
    rows = rows.repartition("_h", "_s").sortWithinPartitions("_h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from twigline.llm.tokens import encoder, in_slices

        enc = encoder(vocabulary, *([] if cache_words is None else [cache_words]))
        first = TaskContext.get().partitionId() << 40
        group: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            out: list[tuple] = []
            ends: list[tuple] = []
            for doc, ids in group:
                n = len(ids)
                whole = n - n % sequence_tokens
                for at in range(0, whole, sequence_tokens):
                    out.append((doc, at, sequence_tokens, n, first, 0, ids[at : at + sequence_tokens].tobytes()))
                    first += 1
                if whole < n:
                    ends.append((doc, whole, n, ids))
            places, bins = first_fit_decreasing([n - at for _, at, n, _ in ends], sequence_tokens)
            for (doc, at, n, ids), (bin_, offset) in zip(ends, places, strict=True):
                out.append((doc, at, n - at, n, first + bin_, offset, ids[at:].tobytes()))
            first += bins
            group.clear()
            for at in range(0, len(out), 2000):
                cols = list(zip(*out[at : at + 2000], strict=True))
                kinds = [pa.int64()] * 6 + [pa.binary()]
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for at, texts in in_slices(batch.column(1), slice_bytes):
                for i, ids in enumerate(enc.encode_documents(texts), at):
                    group.append((docs_[i], ids))
                    held += len(ids)
                    if held >= group_tokens:
                        yield from flush()
                        held = 0
        if group:
            yield from flush()

    return rows.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def op1_packing(spark, sf_dir):  # noqa: ANN001, ANN201
    """Digest of the packing of all documents: one row per piece."""
    from twigline.llm.common import table

    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
