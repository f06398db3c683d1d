"""Byte ranges and lines of files that only ever grow, read by position.

A file is cut into ranges of bounded size, whatever its length, and a task seeks to its own
range: reading costs the bytes of the ranges, and a file of terabytes is many tasks.  Paths
are URIs of any store that Arrow opens (local, S3, HDFS, GCS) or absolute local paths.

Three ways in: ``byte_ranges`` (chunks of whole files), ``log_lines`` (complete lines with
their offsets, batch or stream) and ``read_spans`` (a table of spans).  The stream's offset
is a map of the files' bytes up to their last newline: a restart goes on behind it, a line
without its newline waits for it, and a file that has become shorter is read anew from 0.
(A file that shrank and outgrew its old length between two looks can't be told from one
that grew.)  Bytes that are no UTF-8 become U+FFFD in lines and stay as they are in bodies.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from provenir.functions import identity

#: Bytes of one input partition, of one chunk row and of one read; the largest body of one cell.
PARTITION, CHUNK, BLOCK, CELL = 64 << 20, 4 << 20, 1 << 20, (1 << 31) - 1
#: Bytes of lines in one Arrow batch.
BATCH = 8 << 20


def resolved(path: str):
    """(file system, path within it) of a URI or an absolute local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose name fits, in order."""
    from pyarrow import fs

    store, inner = resolved(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://" if path.startswith("file:") else ""
    one = store.get_file_info(inner)
    if one.type == fs.FileType.File:
        found = [one]
    elif one.type == fs.FileType.Directory:
        found = [x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File]
    else:
        return []
    hidden = lambda x: x.base_name.startswith((".", "_"))  # noqa: E731  what Spark's writers leave beside the data
    return sorted((prefix + x.path, x.size) for x in found if not hidden(x) and fnmatch.fnmatchcase(x.base_name, pattern))


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; lines that begin there may go on up to ``stop``."""

    path: str
    start: int
    end: int
    stop: int


def ranges(path: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end), end) for at in range(start, end, size)]


def lines_of(f, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its newline) of the lines that begin in the range.

    A range that doesn't begin at a line's start leaves the rest of that line to the range
    before it, which reads on behind its own end.  The last line needs no newline.
    """
    begin = part.start - 1 if part.start else 0
    skip = part.start > 0  # up to the newline at or behind the byte before the range
    f.seek(begin)
    held, at, scanned, fetched = bytearray(), begin, 0, begin
    while at < part.end or skip:
        cut = held.find(b"\n", scanned)
        if cut < 0:
            scanned = len(held)
            block = f.read(min(BLOCK, part.stop - fetched))
            fetched += len(block)
            if block:
                held += block
                continue
            if held and not skip:
                yield at, bytes(held)
            return
        if not skip:
            yield at, bytes(held[:cut])
        skip = False
        del held[: cut + 1]
        at, scanned = at + cut + 1, 0


def last_newline(f, size: int) -> int:
    """The offset behind the last newline of the first ``size`` bytes, 0 without one."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        f.seek(start)
        cut = f.read(end - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.partition = int(options.get("partitionBytes", PARTITION))
        self.chunk = int(options.get("chunkBytes", CHUNK))

    def listed(self) -> list[tuple[str, int]]:
        return listed(self.path, self.pattern)


class ByteRanges(DataSource):
    """Chunks of files: options ``path``, ``pattern``, ``partitionBytes``, ``chunkBytes``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, from_off long, to_off long, body binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RangeReader(_Options(self.options))


class _RangeReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        return [r for path, size in self.options.listed() for r in ranges(path, 0, size, self.options.partition)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        store, inner = resolved(partition.path)
        with store.open_input_file(inner) as f:
            for at in range(partition.start, partition.end, self.options.chunk):
                f.seek(at)
                body = f.read(min(self.options.chunk, partition.end - at))
                if body:  # a file that has become shorter meanwhile has less
                    yield partition.path, at, at + len(body), body


LINE = "path string, split long, place long, at long, line string"


def _line_batches(part: Range) -> Iterator[pa.RecordBatch]:
    """Lines of a range in batches bounded by bytes."""
    if not part.path:
        return
    store, inner = resolved(part.path)
    rows: list[tuple[int, int, str]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        place, at, line = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(place, pa.int64()), pa.array(at, pa.int64()), pa.array(line, pa.string())], ["path", "split", "place", "at", "line"])

    with store.open_input_file(inner) as f:
        for place, (at, line) in enumerate(lines_of(f, part)):
            rows.append((place, at, line.decode("utf-8", "replace")))
            size += len(line) + 64
            if size >= BATCH:
                yield batch()
                rows.clear()
                size = 0
    if rows:
        yield batch()


class LogLines(DataSource):
    """Lines of files with their byte offsets: options ``path``, ``pattern``, ``partitionBytes``.

    ``split`` and ``place`` are the input partition's start and the line's number in it.  A
    batch has the last line even if it isn't ended yet; a stream waits for its end.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LineReader(_Options(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _TailReader(_Options(self.options))


class _LineReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[Range]:
        return [r for path, size in self.options.listed() for r in ranges(path, 0, size, self.options.partition)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _line_batches(partition)


class _TailReader(DataSourceStreamReader):
    """Offsets are {path: bytes up to the last newline}; its size follows the files that are there."""

    def __init__(self, options: _Options) -> None:
        self.options = options
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = {}
        for path, size in self.options.listed():
            held = self.seen.get(path)
            if held is None or held[0] != size:
                store, inner = resolved(path)
                with store.open_input_file(inner) as f:
                    held = size, last_newline(f, size)
            now[path] = held
        self.seen = now
        return {path: end for path, (_, end) in now.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in sorted(end.items()):
            since = start.get(path, 0)
            out += ranges(path, 0 if since > to else since, to, self.options.partition)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _line_batches(partition)


def _load(spark: SparkSession, source: type[DataSource], path: str, stream: bool = False, **options) -> DataFrame:
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name())
    return reader.options(path=path, **{k: str(v) for k, v in options.items()}).load()


def byte_ranges(spark: SparkSession, path: str, pattern: str = "*", partition: int = PARTITION, chunk: int = CHUNK) -> DataFrame:
    """(path, from_off, to_off, body) of all bytes below a path, in chunks; empty files have none."""
    return _load(spark, ByteRanges, path, pattern=pattern, partitionBytes=partition, chunkBytes=chunk)


def log_lines(spark: SparkSession, path: str, pattern: str = "*", partition: int = PARTITION, stream: bool = False) -> DataFrame:
    """(path, split, place, at, line) of every line; a stream has complete lines only, each once."""
    return _load(spark, LogLines, path, stream, pattern=pattern, partitionBytes=partition)


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``line_no`` to the lines of a batch, from 0 in each file.

    Lines are counted per input partition; the running count takes one row for each of a
    file's partitions, so no file meets in one task.
    """
    counts = lines.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("path", "split", F.coalesce(before, F.lit(0)).alias("before_"))
    return lines.join(starts, ["path", "split"]).withColumn("line_no", F.col("before_") + F.col("place")).drop("before_")


def read_spans(spark: SparkSession, path: str, spans: DataFrame, pattern: str = "*.jsonl", root: str | None = None) -> DataFrame:
    """Adds ``body``, the bytes [from_off, to_off) of each row's path; other columns stay.

    A path outside ``root`` (by default ``path``) or of another name than ``pattern`` is never
    opened: its body is null, like that of a file that can't be read and of a span with a null
    end.  A span that goes on behind the file's end gives what there is, one that starts
    behind it or ends before its start gives no bytes.  Spans are range-sorted by file and
    place, so that a task seeks forward through few files and a large file is many tasks.  A
    span of 2 GiB or more doesn't fit a cell and raises: read it by ``byte_ranges``.
    """
    # local paths are compared without their scheme; steps up are never followed
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    inside = identity.is_inside(bare(F.lit(root or path)), bare(F.col("path")))
    asked = spans.withColumn("open_", inside & ~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    schema = T.StructType([*spans.schema.fields, T.StructField("body", T.BinaryType())])
    names = spans.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        try:
            for batch in batches:
                bodies, first, size = [], 0, 0
                rows = zip(*(batch.column(c).to_pylist() for c in ("path", "from_off", "to_off", "open_")), strict=True)
                for k, (name, start, end, open_) in enumerate(rows):
                    if name != last:
                        if f is not None:
                            f.close()
                        last, f = name, _opened(name) if open_ and fnmatch.fnmatchcase(name.rsplit("/", 1)[-1], pattern) else None
                    body = None
                    if f is not None and start is not None and end is not None:
                        body = _cut(f, max(0, start), end)
                        size += len(body)
                    bodies.append(body)
                    if size >= BATCH:
                        yield _with_bodies(batch, names, first, k + 1, bodies)
                        bodies, first, size = [], k + 1, 0
                if bodies:
                    yield _with_bodies(batch, names, first, batch.num_rows, bodies)
        finally:
            if f is not None:
                f.close()

    return asked.repartitionByRange("path", "from_off").sortWithinPartitions("path", "from_off").mapInArrow(run, schema)


def _opened(path: str):
    try:
        store, inner = resolved(path)
        return store.open_input_file(inner)
    except (OSError, ValueError, pa.ArrowInvalid):
        return None


def _cut(f, start: int, end: int) -> bytes:
    size = f.size()
    end = min(end, size)
    if end - start >= CELL:
        raise ValueError(f"a span of {end - start} bytes doesn't fit one value; read it by byte_ranges")
    if end <= start:
        return b""
    f.seek(start)
    return f.read(end - start)


def _with_bodies(batch: pa.RecordBatch, names: list[str], first: int, end: int, bodies: list[bytes | None]) -> pa.RecordBatch:
    part = batch.slice(first, end - first)
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(bodies, pa.binary())], [*names, "body"])
