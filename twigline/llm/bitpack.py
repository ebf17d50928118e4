"""Token-id files with fixed-width bit packing (operator 3).

A file is a row of records, each followed by ``SEPARATOR``; a record is read without the others, so neither the writer
nor a reader holds a whole file as one value, and their order in the file does not matter.  In a record, ``MARK`` (the
separator without its line end) is followed by a ``-``, so the separator stands between records only.  A record is, all
little-endian:

    uint64 x 2      tokens of the file before this record, tokens of the whole file
    segment         whole documents, about ``SEGMENT_TOKENS`` tokens

and a segment:

    magic  8 bytes  TWGBITS1
    uint64 x 6      bits, block size, documents, tokens, blocks, byte length of the segment
    int64 x docs    document ids
    uint8 x docs    1 where the document id is null (padded with zeros to 8 bytes)
    uint64 x docs+1 token offset of every document
    uint64 x blocks+1  byte offset of every block, from the start of the segment
    blocks          ids of ``block size`` tokens, each in ``bits`` bits, low bits first, padded to 64-bit words

A byte after a segment's end is ignored.  Blocks start at word borders, so any block is unpacked alone, by whole-array
numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twigline.llm.common import scratch_path

MAGIC = b"TWGBITS1"
BLOCK = 4096
#: Tokens at which a file is closed.
FILE_TOKENS = 8_000_000
#: Tokens at which a segment is closed: about 200 kB, so that the JVM's copies of a record are no humongous objects.
SEGMENT_TOKENS = 100_000
#: Ends a record.  The first sign occurs only once in it, so no other can start within it.
MARK = b"|end of segments"
SEPARATOR = MARK + b"\n"


def vocabulary_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids in ``bits`` bits each, as 64-bit words; 64 ids fill ``bits`` words exactly."""
    rows = -(-len(ids) // 64)
    grid = np.zeros((rows, 64), dtype=np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    words = np.zeros((rows, bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = len(words) // bits
    words = words[: rows * bits].reshape(rows, bits)
    grid = np.empty((rows, 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        grid[:, j] = (x & mask).astype(np.uint32)
    return grid.reshape(-1)[:n]


def write_blob(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """One segment's bytes."""
    ends = np.cumsum([0, *map(len, docs)], dtype=np.uint64)
    ids = np.concatenate(docs) if docs else np.empty(0, dtype=np.uint32)
    if block % 64:
        raise ValueError("a block needs a multiple of 64 ids")
    # many blocks are packed in one call: full blocks hold whole groups of 64 ids, so their words follow each other
    many, words = 16 * block, block // 64 * bits
    runs = [pack_bits(ids[at : at + many], bits) for at in range(0, len(ids), many)]
    blocks = [run[at : at + words] for run in runs for at in range(0, len(run), words)]
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    nulls = bytes(d is None for d in doc_ids)
    nulls += bytes(-len(nulls) % 8)
    start = 8 + 48 + len(keys) + len(nulls) + 8 * (len(docs) + 1) + 8 * (len(blocks) + 1)
    offsets = start + 8 * np.cumsum([0, *map(len, blocks)], dtype=np.uint64)
    head = np.array([bits, block, len(docs), len(ids), len(blocks), int(offsets[-1])], dtype="<u8")
    parts = [MAGIC, head.tobytes(), keys, nulls, ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes()]
    return b"".join(parts + [r.astype("<u8").tobytes() for r in runs])


def record(segment: bytes, before: int, file_tokens: int) -> bytes:
    """A segment with its place in its file, without the separator."""
    return (np.array([before, file_tokens], dtype="<u8").tobytes() + segment).replace(MARK, MARK + b"-")


def from_record(raw: bytes) -> tuple[bytes, int, int]:
    """Undoes ``record``."""
    raw = raw.replace(MARK + b"-", MARK)
    before, file_tokens = np.frombuffer(raw, "<u8", 2).tolist()
    return raw[16:], before, file_tokens


class BitFile:
    """Random access to one segment's bytes."""

    def __init__(self, blob: bytes) -> None:
        if blob[:8] != MAGIC:
            raise ValueError("not a token file")
        head = np.frombuffer(blob, "<u8", 6, 8).astype(np.int64).tolist()
        self.bits, self.block, self.docs, self.tokens, self.blocks, self.size = head
        if len(blob) < self.size:
            raise ValueError("the token file is cut off")
        at, self.blob = 56, blob
        self.keys = np.frombuffer(blob, "<i8", self.docs, at)
        at += 8 * self.docs
        self.nulls = np.frombuffer(blob, "u1", self.docs, at)
        at += self.docs + -self.docs % 8
        self.ends = np.frombuffer(blob, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.offsets = np.frombuffer(blob, "<u8", self.blocks + 1, at).astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop): only the blocks that hold them are unpacked."""
        start, stop = max(0, start), min(stop, self.tokens)
        if start >= stop:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        at, end = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.blob, "<u8", (end - at) // 8, at)
        # all blocks but the last are full, and a full block has whole groups of 64 ids
        out = unpack_bits(words, self.bits, (last + 1 - first) * self.block)
        return out[start - first * self.block : stop - first * self.block]

    def doc_id(self, i: int) -> int | None:
        return None if self.nulls[i] else int(self.keys[i])

    def doc(self, i: int) -> np.ndarray:
        return self.read(int(self.ends[i]), int(self.ends[i + 1]))


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Encode every whole text and write files under ``path`` in ascending order of document id.

    One range shuffle by id, then by a hash of the text, so neither a null nor a repeated id fills one task; a task then
    streams its documents into files of about ``file_tokens`` tokens, written record by record by Spark's own file writer
    (its commit protocol, any Hadoop file system).  A file's folder is named ``shard=<task><number>-<tokens>-<bytes>``: 8
    digits of the task's number and 8 of the file's number in it, so names sort as the documents do, and how many tokens
    and bytes the file holds, so that a reader can place files without opening them twice; it compares the name with the
    file.

    Null text counts as empty; null ids come first; equal ids are ordered by a hash of the text; an empty table
    gives no files.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal rows are told apart by a row number; which comes first does not show
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_n")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from twigline.llm.tokens import encoder, in_slices

        enc = encoder(vocabulary)
        bits = vocabulary_bits(enc.vocab_size)
        task, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        segments: list[tuple[bytes, int]] = []
        size = before = 0

        def close_segment() -> None:
            nonlocal before
            segments.append((write_blob(keys, held, bits), before))
            before = size
            keys.clear()
            held.clear()

        def file() -> Iterator[pa.RecordBatch]:
            nonlocal number, size, before
            if keys:
                close_segment()
            records = [record(segment, at, size) for segment, at in segments]
            total = sum(map(len, records)) + len(records) * len(SEPARATOR)
            name = pa.array([f"{task:08d}{number:08d}-{size}-{total}"], pa.string())
            segments.clear()
            number, size, before = number + 1, 0, 0
            for r in records:
                yield pa.RecordBatch.from_arrays([name, pa.array([r], pa.binary())], ["shard", "value"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in in_slices(batch.column(1)):
                for i, tokens in enumerate(enc.encode_documents(texts), at):
                    keys.append(ids[i])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= file_tokens:
                        yield from file()
                    elif size - before >= SEGMENT_TOKENS:
                        close_segment()
        if size:
            yield from file()

    blobs = rows.mapInArrow(write, "shard string, value binary")
    # the text writer puts a string's bytes down as they are
    lines = blobs.select("shard", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("shard").text(path, compression="none", lineSep=SEPARATOR.decode())


READ_SCHEMA = "shard string, doc_id long, local_start long, n_tokens long, file_tokens long, ids binary"


def read_token_files(spark: SparkSession, path: str, values: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per document of the files: its ids (little-endian unsigned 32 bits) and where they start.

    ``values`` are the SQL expressions of ``ids`` to return: what needs only a digest does not carry the ids further.

    ``start`` counts the ids of all documents before it, over all files; it needs one row per file, not per document,
    and takes the files' sizes from their names; a file whose own count or length differs from its name raises.
    """
    from pyspark.sql import Window

    def named(part: int) -> Column:
        return F.regexp_extract("path", r"/shard=([0-9]+)-([0-9]+)-([0-9]+)/", part)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(F.col("path").contains("/shard="))
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(" has not the length in its name")))
    whole = F.when(F.col("length") == named(3).cast("long"), named(2).cast("long")).otherwise(wrong)
    sizes = files.select(named(1).alias("shard"), whole.alias("n"))
    records = spark.read.text(path, lineSep=SEPARATOR.decode(), recursiveFileLookup=True)
    records = records.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    records = records.filter(F.col("path").contains("/shard="))
    records = records.select(named(1).alias("shard"), named(2).cast("long").alias("n"), "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, size, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment, before, file_tokens = from_record(raw.as_py())
                if file_tokens != size:
                    raise ValueError(f"file {shard} holds {file_tokens} tokens, its name says {size}")
                f = BitFile(segment)
                at = 0
                while at < f.docs:
                    stop = at + 1
                    while stop < f.docs and f.ends[stop + 1] - f.ends[at] <= 500_000:
                        stop += 1
                    base = int(f.ends[at])
                    ids = f.read(base, int(f.ends[stop])).astype("<u4")
                    n = stop - at
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * n, pa.string()),
                            pa.array([f.doc_id(i) for i in range(at, stop)], pa.int64()),
                            pa.array(before + f.ends[at:stop], pa.int64()),
                            pa.array(np.diff(f.ends[at : stop + 1]), pa.int64()),
                            pa.array([file_tokens] * n, pa.int64()),
                            pa.array(
                                [ids[int(f.ends[i]) - base : int(f.ends[i + 1]) - base].tobytes() for i in range(at, stop)],
                                pa.binary(),
                            ),
                        ],
                        ["shard", "doc_id", "local_start", "n_tokens", "file_tokens", "ids"],
                    )
                    at = stop

    # first sums of the writer's tasks, one row each, then of the files of each task
    sizes = sizes.withColumn("task", F.substring("shard", 1, 8))
    by_task = sizes.groupBy("task").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("task_base"))
    before = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(by_task, "task")
    bases = bases.select("shard", (F.col("task_base") + F.col("base")).alias("base"))
    docs = records.mapInArrow(read, READ_SCHEMA).selectExpr("shard", "doc_id", "local_start", "n_tokens", *values)
    start = (F.col("base") + F.col("local_start")).alias("start")
    rest = [c for c in docs.columns if c not in ("shard", "doc_id", "local_start", "n_tokens")]
    return docs.join(bases, "shard").select("doc_id", start, "n_tokens", *rest, "shard")


def op3_token_files(spark, sf_dir):  # noqa: ANN001, ANN201
    """Digest of what is read back from the files of all documents."""
    from twigline.llm.common import table

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    back = read_token_files(spark, path, values=("crc32(ids) AS ids_crc32",))
    return back.drop("shard")
