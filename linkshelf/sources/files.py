"""Python data sources for files that Spark's own listing can't take: notes whose names start with an underscore, and growing capture lists.

Both list on the driver, as Spark's file index does (names and sizes, no content), and read in tasks of bounded bytes.
Paths are local ones or URIs that ``pyarrow.fs`` knows; an ``s3a`` URI is read as ``s3``.
"""

from __future__ import annotations

import io
import json
import posixpath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from linkshelf.session import importable

#: Bytes and files a task reads at most (one larger file is a task of its own), and bytes of a batch it hands over.
PART_BYTES, PART_FILES, BATCH_BYTES = 64 << 20, 2_000, 8 << 20
#: A small file costs as much as this many bytes to open.
OPEN_BYTES = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a local path or URI; ``ValueError`` (``ArrowInvalid``) for a scheme it doesn't know."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def known(path: str) -> bool:
    try:
        located(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def visible(relative: str) -> bool:
    """No part of the path below the root starts with a dot."""
    return not any(part.startswith(".") for part in relative.split("/"))


def _below(files: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """Visible files at or below ``root``, by path; none when it is missing."""
    top = files.get_file_info(root)
    if top.type == fs.FileType.File:
        return [top]
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((i for i in found if i.type == fs.FileType.File and visible(posixpath.relpath(i.path, root))), key=lambda i: i.path)


class Notes(InputPartition):
    """Files of one task: ``(path, mtime in microseconds)``."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


class NoteReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Notes]:
        files, root = located(self.root)
        parts, size = [], PART_BYTES
        for info in _below(files, root):
            if not info.path.endswith(".md"):
                continue
            cost = OPEN_BYTES + (info.size or 0)
            if size + cost > PART_BYTES or len(parts[-1]) >= PART_FILES:
                parts.append([])
                size = 0
            parts[-1].append((info.path, (info.mtime_ns or 0) // 1000))
            size += cost
        return [Notes(part) for part in parts] or [Notes([])]

    def read(self, partition: Notes):
        files, _ = located(self.root)
        rows, size = [], 0
        for path, mtime in partition.files:
            with files.open_input_file(path) as source:
                data = source.read()
            try:
                rows.append((path, mtime, data.decode("utf-8")))
            except UnicodeDecodeError:
                continue
            size += len(data)
            if size >= BATCH_BYTES:
                yield _note_batch(rows)
                rows, size = [], 0
        if rows:
            yield _note_batch(rows)


def _note_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    path, mtime, content = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(path, pa.string()), pa.array(mtime, pa.timestamp("us", "UTC")), pa.array(content, pa.string())],
        names=["path", "mtime", "content"])


class NoteTree(DataSource):
    """``.md`` files at any depth below ``path``, names with a leading underscore too; dot names and undecodable notes are skipped."""

    @classmethod
    def name(cls) -> str:
        return "linkshelf_notes"

    def schema(self) -> str:
        return "path string, mtime timestamp, content string"

    def reader(self, schema) -> NoteReader:
        return NoteReader(self.options["path"])


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """``path, mtime, content`` of every note below ``root``."""
    importable(spark).dataSource.register(NoteTree)
    return spark.read.format("linkshelf_notes").load(root)


def write_notes(notes: DataFrame, root: str) -> int:
    """Write ``notes(path, content)``, one file each, at ``path`` below ``root``; returns how many.

    A file gets its name when it is whole, so a task that runs twice or is lost leaves no torn note. Paths are one per row.
    """
    importable(notes.sparkSession)

    def write(batches):
        files, top = located(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, name = posixpath.split(posixpath.join(top, path.lstrip("/")))
                files.create_dir(folder, recursive=True)
                # Attempts of one row write the same bytes, each under a hidden name of its own.
                whole, part = posixpath.join(folder, name), posixpath.join(folder, f".{name}.{_attempt()}")
                with files.open_output_stream(part) as sink:
                    sink.write((content or "").encode("utf-8"))
                files.move(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = notes.select("path", "content").mapInArrow(write, "n bigint").groupBy().sum("n").first()[0]
    return written or 0


def _attempt() -> int:
    from pyspark import TaskContext

    return TaskContext.get().taskAttemptId()


class Lines(InputPartition):
    """Lines of ``path`` that start at a byte of ``[start, end)``; ``whole``: ``start`` is known to begin a line."""

    def __init__(self, path: str, start: int, end: int, whole: bool):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.whole = path, start, end, whole


def _complete(files: fs.FileSystem, info: fs.FileInfo, step: int = 1 << 16) -> int:
    """Bytes of a file up to its last line break: a line still being written waits for its end."""
    end = info.size or 0
    with files.open_input_file(info.path) as source:
        while end > 0:
            start = max(0, end - step)
            source.seek(start)
            at = source.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


class CaptureReader(DataSourceStreamReader):
    """Offsets are ``{"done": {path: bytes}}`` as JSON text: how far each file was read, always behind a line break."""

    def __init__(self, root: str, part_bytes: int = PART_BYTES):
        self.root, self.part_bytes = root, part_bytes

    def initialOffset(self) -> dict:
        return {"done": "{}"}

    def latestOffset(self) -> dict:
        files, root = located(self.root)
        found = [i for i in _below(files, root) if not posixpath.basename(i.path).startswith("_")]
        return {"done": json.dumps({i.path: _complete(files, i) for i in found}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        before, parts = json.loads(start["done"]), []
        for path, stop in json.loads(end["done"]).items():
            first = before.get(path, 0)
            if stop < first:
                raise ValueError(f"{path} was cut from {first} to {stop} bytes; capture lists are only appended to")
            parts += [Lines(path, at, min(at + self.part_bytes, stop), at == first) for at in range(first, stop, self.part_bytes)]
        return parts

    def read(self, partition: Lines):
        files, _ = located(self.root)
        with files.open_input_file(partition.path) as raw, io.BufferedReader(raw, 1 << 20) as source:
            at = partition.start
            if not partition.whole:
                source.seek(at - 1)
                at += len(source.readline()) - 1
            source.seek(at)
            rows, size = [], 0
            while at < partition.end:
                line = source.readline()
                if not line.endswith(b"\n"):
                    raise ValueError(f"{partition.path} ended within a line at byte {at}")
                at += len(line)
                size += len(line)
                rows.append(line[:-1].decode("utf-8", "replace"))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["line"])


class CaptureLists(DataSource):
    """Lines of a capture file, or of a folder of them, as a stream; lines appended to a file already read are new rows."""

    @classmethod
    def name(cls) -> str:
        return "linkshelf_captures"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def stream_lines(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``line`` of an appended capture file, or of a folder of such files."""
    importable(spark).dataSource.register(CaptureLists)
    return spark.readStream.format("linkshelf_captures").option("partBytes", part_bytes).load(path)
