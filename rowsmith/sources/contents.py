"""Contents of very many small files as rows, read and written in few tasks.

Spark's reader keeps an entry per file on the driver and gives a task 32 small files; its writer makes
a folder, checksums and moves for each file of its own. Here the driver keeps the names, a task
reads or writes thousands of files, and a write is committed by folder. Folders are walked by
pyarrow (see `listing`), also those named key=value below the one asked for, and files whose names
end as those of Hadoop's codecs are decompressed, both as Spark does.
"""

from __future__ import annotations

import bz2
import gzip
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from .listing import opened, shown
from .tables import _folder

#: Files and bytes that one partition reads, and rows and bytes of one Arrow batch, about.
FILES_PER_TASK = 2000
BYTES_PER_TASK = 1 << 25
BATCH_ROWS = 4096
BATCH_BYTES = 1 << 23

READ = "path string, content binary"
#: Names are paths below the folder.
WRITTEN = "name string, content binary"


# -- names and bytes as Hadoop takes them -------------------------------------------


def glob_regex(glob: str) -> re.Pattern[str]:
    """Hadoop's file pattern: * ? [a-c] [^a] [!a] {one,two} and \\ before a sign that counts as itself."""
    out, curly, inside, signs = "", 0, False, iter(enumerate(glob))
    for n, c in signs:
        if c == "\\":
            out += re.escape(next(signs)[1])
        elif inside:
            out += "^" if c == "!" and glob[n - 1] == "[" else "\\[" if c == "[" else c
            inside = c != "]"
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "{" or c == "}" and curly:
            curly += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        elif c == "," and curly:
            out += "|"
        elif c == "[":
            out, inside = out + c, True
        else:
            out += re.escape(c)
    return re.compile(out, re.DOTALL)


def lz4_block(data: bytes) -> bytes:
    def length(n: int, at: int) -> tuple[int, int]:
        more = n == 15
        while more:
            n, more, at = n + data[at], data[at] == 255, at + 1
        return n, at

    out, at = bytearray(), 0
    while at < len(data):
        token = data[at]
        n, at = length(token >> 4, at + 1)
        out += data[at:at + n]
        at += n
        if at < len(data):
            start = len(out) - int.from_bytes(data[at:at + 2], "little")
            n, at = length(token & 15, at + 2)
            for k in range(start, start + n + 4):
                out.append(out[k])
    return bytes(out)


def snappy_block(data: bytes) -> bytes:
    size = shift = 0
    for byte in data:
        size, shift = size | (byte & 127) << shift, shift + 7
        if byte < 128:
            break
    return pa.Codec("snappy").decompress(data, size, asbytes=True)


def blocks(data: bytes, block) -> bytes:
    """Hadoop's blocks: their length, then chunks, each after its compressed length."""
    out, at, end = bytearray(), 0, 0
    while at < len(data):
        if len(out) == end:
            end, at = end + int.from_bytes(data[at:at + 4], "big"), at + 4
            continue
        n = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + n > len(data):
            raise EOFError("a compressed file is cut off")
        out, at = out + block(data[at + 4:at + 4 + n]), at + 4 + n
    return bytes(out)


CODECS = {
    ".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress,
    ".zst": lambda data: pa.input_stream(pa.py_buffer(data), compression="zstd").read(),
    ".snappy": lambda data: blocks(data, snappy_block), ".lz4": lambda data: blocks(data, lz4_block),
}


def plain(name: str, data: bytes) -> bytes:
    codec = CODECS.get(re.search(r"(\.[^.]*)?$", name)[0])
    return codec(data) if codec and data else data


# -- reading ------------------------------------------------------------------------


@dataclass
class Group(InputPartition):
    """Names by folder, a folder by what follows the path asked for: a long one is sent once."""

    names: dict[str, list[str]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern")

    def found(self) -> Iterator[tuple[str, int]]:
        """Full path and size of the files."""
        system, root, _ = opened(self.path)
        pattern = self.pattern and glob_regex(self.pattern)
        top = system.get_file_info([root])
        if top[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        folders = [] if top[0].type == pafs.FileType.File else [root]
        while top or folders:
            for info in top or system.get_file_info(pafs.FileSelector(folders.pop())):
                name = info.base_name
                if not shown(name) or name.endswith("._COPYING_"):
                    continue
                if info.type == pafs.FileType.File and (not pattern or pattern.fullmatch(name)):
                    yield info.path, info.size
                elif info.type == pafs.FileType.Directory and "=" in name and not top:
                    folders.append(info.path)
            top = []

    def partitions(self) -> list[Group]:
        root, groups, count, size = opened(self.path)[1], [Group({})], 0, 0
        for path, length in self.found():
            if count == FILES_PER_TASK or size and size + length > BYTES_PER_TASK:
                groups.append(Group({}))
                count = size = 0
            inside = path[len(root):]
            cut = inside.rfind("/") + 1
            groups[-1].names.setdefault(inside[:cut], []).append(inside[cut:])
            count, size = count + 1, size + length
        return groups

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        system, root, before = opened(self.path)
        paths, contents, size = [], [], 0
        for path in (root + folder + name for folder, names in group.names.items() for name in names):
            with system.open_input_file(path) as file:
                content = plain(path, file.read())
            if len(paths) == BATCH_ROWS or size and size + len(content) > BATCH_BYTES:
                yield self.batch(paths, contents)
                paths, contents, size = [], [], 0
            paths.append(before + path)
            contents.append(content)
            size += len(content)
        if paths:
            yield self.batch(paths, contents)

    def batch(self, paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


# -- writing ------------------------------------------------------------------------


@dataclass
class Done(WriterCommitMessage):
    folder: str


class Writer(DataSourceArrowWriter):
    """Each attempt of a task writes a folder of its own; in the end those of other attempts are removed."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        system, root, _ = opened(self.path)
        folder, names = f"part={self.run}-{TaskContext.get().taskAttemptId()}", set()
        system.create_dir(f"{root}/{folder}")
        rows = (row for b in batches for row in zip(b.column("name").to_pylist(), b.column("content").to_pylist()))
        for name, lines in groupby(rows, lambda row: row[0]):
            if name in names:
                raise ValueError(f"the rows of {name} do not follow one another")
            names.add(name)
            with system.open_output_stream(f"{root}/{folder}/{name}", compression=None) as file:
                file.write(b"".join((line or b"") + b"\n" for _, line in lines))
        return Done(folder)

    def commit(self, messages: list[Done | None]) -> None:
        system, root, _ = opened(self.path)
        system.create_dir(root)
        self.remove({m.folder for m in messages if m})

    def abort(self, messages: list[Done | None]) -> None:
        self.remove(set())

    def remove(self, kept: set[str]) -> None:
        """The folders of this write, without those kept."""
        system, root, _ = opened(self.path)
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"part={self.run}-") and info.base_name not in kept:
                system.delete_dir(info.path)


class Contents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowsmith_contents"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it, with its scheme."""
    fs, root = _folder(spark, path)
    return fs.makeQualified(root).toString()


def read_contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of the files of a folder, or of one file, also of those of no bytes."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}")
    spark.dataSource.register(Contents)
    reader = spark.read.format(Contents.name()).option("path", qualified(spark, path))
    return (reader.option("pattern", pattern) if pattern else reader).load()


def write_contents(df: DataFrame, path: str) -> None:
    """Rows (name, content) as files below a folder: a file of each name, one row a line.

    The rows of one name must follow one another in one partition. A name is unique in its partition only.
    """
    spark = df.sparkSession
    spark.dataSource.register(Contents)
    rows = df.select(df["name"], df["content"].cast("binary").alias("content"))
    rows.write.format(Contents.name()).mode("append").option("path", qualified(spark, path)).save()
