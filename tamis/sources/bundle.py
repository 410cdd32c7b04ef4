"""A bundle as a data source: its documents as rows of lines, read in byte ranges, and written in sorted parts.

    spark.dataSource.register(BundleSource)
    spark.read.format("bundle").load(folder)              file, at (byte offset in its document), line (bytes), ended
    rows.write.format("bundle").option("file", name).mode("append").save(folder)

A document is a file, or a folder of parts whose contents follow each other in order of name; either reads the same.  Readers
open their own range wherever they run, so the folder must be one that all executors reach (a local path, or a URI that
pyarrow's file systems know).  Lines end with a line feed; `ended` is false for a last line without one.  Empty files have
no rows.  A part is written under a name of its task's attempt and gets its place when all parts are there.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, at long, line binary, ended boolean"
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


@dataclass
class Range(InputPartition):
    """The lines that start in [start, end) of a part; base: bytes of the document before the part."""

    file: str
    path: str
    base: int
    start: int
    end: int


def _lines(stream: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """Offset, content and whether it is ended, of each line that starts in [start, end)."""
    at = max(0, start - 1)  # the byte before tells whether a line starts here
    stream.seek(at)
    held, skip = b"", start > 0
    while at < end:
        chunk = stream.read(CHUNK)
        pieces = (held + chunk).split(b"\n")
        held = pieces.pop()
        for piece in pieces:
            if skip:
                skip = False
            elif at < end:
                yield at, piece, True
            at += len(piece) + 1
        if not chunk:
            if held and not skip and at < end:
                yield at, held, False
            return


class BundleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        system, root = _at(self.path)
        out = []
        for found in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
            if found.base_name[0] in "._":
                continue
            parts = [found] if found.is_file else sorted((x for x in system.get_file_info(fs.FileSelector(found.path)) if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.base_name)
            base = 0
            for part in parts:
                out += [Range(found.base_name, part.path, base, x, min(x + self.split, part.size)) for x in range(0, part.size, self.split)]
                base += part.size
        return out or [Range("", "", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        system, _ = _at(self.path)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.bool_())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        with system.open_input_file(partition.path) as stream:
            rows, size = [], 0
            for at, line, ended in _lines(stream, partition.start, partition.end):
                rows.append((partition.file, partition.base + at, line, ended))
                size += len(line)
                if size > CHUNK or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str


class BundleWriter(DataSourceWriter):
    """Writes rows (line) of sorted partitions as the parts of one document."""

    def __init__(self, options: dict[str, str]):
        self.path, self.file, self.run = options["path"], options["file"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = _at(self.path)
        part = TaskContext.get().partitionId()
        folder = posixpath.join(root, self.file)
        system.create_dir(folder)
        path = posixpath.join(folder, f".{self.run}-{part}-{uuid.uuid4().hex}")
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write(f"{row.line}\n".encode())
        return Written(part, path)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _at(self.path)
        for m in messages:
            if m is not None:
                system.move(m.path, posixpath.join(posixpath.dirname(m.path), f"part-{m.part:06d}"))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _at(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BundleSource)
    return spark.read.format("bundle").load(str(path))


def write(path: str, file: str, header: list[str], lines: DataFrame | None = None) -> None:
    """A document of header lines and, in order of application_id, the lines of a table, in as many parts as the sort has."""
    spark = SparkSession.active() if lines is None else lines.sparkSession
    spark.dataSource.register(BundleSource)
    rows = spark.createDataFrame([(k, None, h) for k, h in enumerate(header)], "n int, application_id string, line string")
    if lines is not None:
        rows = rows.unionByName(lines.select(F.lit(len(header)).alias("n"), "application_id", "line"))
    rows.orderBy("n", "application_id").select("line").write.format("bundle").option("file", file).mode("append").save(str(path))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, text, size = None, None, 0
    done: list[tuple[str, int, str]] = []
    for batch in batches:
        for name, line, ended in zip(*[batch.column(c).to_pylist() for c in ("file", "line", "ended")], strict=True):
            if name != file:
                if text:
                    done.append((file, size, text.hexdigest()))
                file, text, size = name, hashlib.sha256(), 0
            raw = line + b"\n" if ended else line
            text.update(raw)
            size += len(raw)
    if text:
        done.append((file, size, text.hexdigest()))
    columns = list(zip(*done, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "bytes", "hash"])


def digests(lines: DataFrame) -> DataFrame:
    """file, bytes, hash of each document: a file's lines are sorted and folded in one task, batch by batch; files run beside one another."""
    return lines.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_digested, "file string, bytes long, hash string")


def manifest(lines: DataFrame) -> DataFrame:
    """file, bytes, hash that the manifest of a bundle states."""
    said = lines.where("file = 'MANIFEST.txt'").select(F.col("line").cast("string").alias("text")).where("startswith(text, 'file=')")
    f = F.split(F.substring("text", 6, 1 << 30), "[|]")
    return said.select(f[0].alias("file"), f[1].cast("long").alias("bytes"), f[2].alias("hash"))


def compared(lines: DataFrame) -> DataFrame:
    """file, bytes, hash, stated_hash, matches of every document that is there or stated."""
    found = digests(lines.where("file <> 'MANIFEST.txt'"))
    stated = manifest(lines).select("file", F.col("bytes").alias("stated_bytes"), F.col("hash").alias("stated_hash"))
    both = found.join(stated, "file", "full")
    return both.select("file", "bytes", "hash", "stated_hash", F.coalesce((F.col("bytes") == F.col("stated_bytes")) & (F.col("hash") == F.col("stated_hash")), F.lit(False)).alias("matches"))


def publish(path: str, header: list[str], documents: dict[str, tuple[list[str], DataFrame | None]]) -> None:
    """Writes the documents (header lines, table of lines) and then the manifest with their digests, which are read from what was written."""
    spark = SparkSession.active()
    for name, (head, lines) in documents.items():
        write(path, name, head, lines)
    found = {r.file: r for r in digests(read(spark, path).where(F.col("file").isin(*documents))).collect()}
    write(path, "MANIFEST.txt", header + [f"file={n}|{found[n].bytes}|{found[n].hash}" for n in documents])
