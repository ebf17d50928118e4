"""A data source for collections of pages: ``spark.read.format("html_records")`` after ``register_records``.

A collection is a folder of container files.  A file starts with a magic word, the schema and a random mark of 16 bytes;
then come blocks: the mark, the block's length and its least and greatest key, and the page records, compressed.  A
reader starts anywhere, at the first mark it meets, so large files are split at record borders.  Blocks whose keys a
filter rules out are passed over.  Writes are transactions: a manifest, moved into place as the last step, names the
files that count; a failed write leaves it as it was.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

MAGIC, MARK = b"TWIGREC1", 16
MANIFEST = "_manifest.json"
#: Uncompressed bytes of a block, and bytes of a file that one task reads, unless told otherwise.
BLOCK_BYTES, SPLIT_BYTES = 1 << 20, 32 << 20
SCHEMA = "page_id bigint, url string, html string"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
#: Of a block, behind its mark: length of the data, whether keys are bounded, the least and the greatest.
_HEAD = struct.Struct("<Q?qq")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Spark's ``file:/x`` counts too."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _files(fs: pafs.FileSystem, folder: str) -> list[str]:
    """Files that count: those that the manifest names; none before the first write."""
    info = fs.get_file_info(f"{folder}/{MANIFEST}")
    if info.type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(info.path) as f:
        return json.loads(f.read())["files"]


@dataclass
class _Split(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


@dataclass
class _Bounds:
    """Keys that pushed filters allow."""

    least: int | None = None
    most: int | None = None

    def narrow(self, least: int | None, most: int | None) -> None:
        if least is not None:
            self.least = least if self.least is None else max(self.least, least)
        if most is not None:
            self.most = most if self.most is None else min(self.most, most)

    def excludes(self, bounded: bool, low: int, high: int) -> bool:
        """Whether no key from ``low`` to ``high`` is allowed; a block without any key only has nulls."""
        if self.least is None and self.most is None:
            return False
        return not bounded or self.least is not None and high < self.least or self.most is not None and low > self.most


class RecordsReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes, self.bounds = path, split_bytes, _Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the key pass over blocks; Spark still tests every row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page_id",):
                if isinstance(f, EqualTo):
                    self.bounds.narrow(f.value, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds.narrow(f.value, None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.bounds.narrow(None, f.value)
                elif isinstance(f, In) and f.value:
                    self.bounds.narrow(min(f.value), max(f.value))
            yield f

    def partitions(self) -> Sequence[_Split]:
        fs, folder = _open(self.path)
        out = []
        for name in _files(fs, folder):
            size = fs.get_file_info(f"{folder}/{name}").size
            out += [_Split(name, a, min(a + self.split_bytes, size)) for a in range(0, size, self.split_bytes)]
        return out

    def read(self, partition: _Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no partitions
            return
        fs, folder = _open(self.path)
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            size = f.size()
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{partition.file} is no file of page records")
            mark = f.read(MARK)
            at = _next_mark(f, mark, max(partition.start, len(MAGIC) + MARK), partition.end)
            while at is not None and at < min(partition.end, size):
                f.seek(at)
                if f.read(MARK) != mark:
                    raise ValueError(f"{partition.file} is damaged at byte {at}")
                length, bounded, low, high = _HEAD.unpack(f.read(_HEAD.size))
                if not self.bounds.excludes(bounded, low, high):
                    data = f.read(length)
                    if len(data) < length:
                        raise ValueError(f"{partition.file} ends within a block")
                    with pa.ipc.open_stream(zlib.decompress(data)) as stream:
                        yield from stream
                at += MARK + _HEAD.size + length


def _next_mark(f: pa.NativeFile, mark: bytes, at: int, end: int) -> int | None:
    """Where the first block that starts in [at, end) does."""
    while at < end:
        f.seek(at)
        piece = f.read(min(1 << 20, end - at) + MARK - 1)
        found = piece.find(mark)
        if found >= 0:
            return at + found
        at += 1 << 20
    return None


class RecordsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, block_bytes: int) -> None:
        self.path, self.overwrite, self.block_bytes = path, overwrite, block_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        name, mark = f"pages-{uuid.uuid4().hex}.rec", os.urandom(MARK)
        out = None
        for batch in iterator:
            rows = pa.table([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in _ARROW], schema=_ARROW)
            sizes = rows.column("html").combine_chunks()
            start, held = 0, 0
            for i in range(rows.num_rows):
                held += len(sizes[i].as_buffer() or b"") + 64
                if held >= self.block_bytes or i == rows.num_rows - 1:
                    if out is None:
                        out = fs.open_output_stream(f"{folder}/{name}")
                        out.write(MAGIC + mark)
                    _write_block(out, mark, rows.slice(start, i + 1 - start))
                    start, held = i + 1, 0
        if out is not None:
            out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        new = sorted(m.file for m in messages if m is not None and m.file)
        files = new if self.overwrite else _files(fs, folder) + new
        draft = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(draft, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, folder = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{folder}/{m.file}")


def _write_block(out: pa.NativeFile, mark: bytes, rows: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW) as stream:
        stream.write_table(rows)
    data = zlib.compress(sink.getvalue().to_pybytes(), 3)
    keys = pa.compute.min_max(rows.column("page_id")).as_py()
    bounded = keys["min"] is not None
    out.write(mark + _HEAD.pack(len(data), bounded, keys["min"] if bounded else 0, keys["max"] if bounded else 0) + data)


class HtmlRecords(DataSource):
    """Options: ``path``; ``split_bytes`` of a file that one task reads; ``block_bytes`` of a block before compression."""

    @classmethod
    def name(cls) -> str:
        return "html_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordsReader:
        return RecordsReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordsWriter:
        missing = set(_ARROW.names) - set(schema.names)
        if missing:
            raise ValueError(f"page records need the columns {sorted(missing)}")
        return RecordsWriter(self.options["path"], overwrite, int(self.options.get("block_bytes", BLOCK_BYTES)))


def register_records(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HtmlRecords)
