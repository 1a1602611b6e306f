"""Files as rows, also those of no bytes, which Spark's own file index leaves out.

Two data sources in one: `files` lists names, sizes and times, `images` reads width and height
from the first bytes of each file. A folder of many files is several partitions. Folders are walked
by pyarrow, so they may lie on a local or mounted disk, HDFS, S3 or GCS. Names that begin with a
dot or an underscore are left out, as Spark does.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that one partition reads, and rows of one Arrow batch.
FILES_PER_TASK = 2000
BATCH_ROWS = 4096

FILES = "path string, directory string, length bigint, modificationTime timestamp"
IMAGES = "path string, width int, height int, error string"
#: Markers of the JPEG frames that tell the size: all SOF markers. Fixed values.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
#: JPEG markers without a length: TEM, RST0 to RST7, SOI. Fixed values.
BARE = {0x01, *range(0xD0, 0xD9)}


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path on it, and what stands before that path in a URI.

    Paths are taken as they are: %20 in a path is three characters of a name.
    """
    scheme, sep, rest = path.partition(":")
    if not sep or "/" in scheme or len(scheme) == 1:
        return pafs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.strip("/"), "file:"
    host, _, inside = rest.removeprefix("//").partition("/")
    system, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    base = base.strip("/")
    if scheme in ("s3", "s3a", "gs"):
        return system, f"{host}/{inside}".strip("/"), f"{scheme}://"
    return system, f"/{base}/{inside}".replace("//", "/").rstrip("/"), f"{scheme}://{host}"


def shown(name: str) -> bool:
    return not name.startswith((".", "_")) or (name.startswith("_") and "=" in name)


@dataclass
class Share(InputPartition):
    """The files of one folder whose names fall into one of several parts."""

    folder: str
    part: int
    parts: int
    single: bool = False


def png_size(head: bytes) -> tuple[int, int] | None:
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    return None


def jpeg_size(file: BinaryIO) -> tuple[int, int] | None:
    """Follows the segments, however long, up to the frame."""
    file.seek(0)
    if file.read(2) != b"\xff\xd8":
        return None
    while True:
        sign = file.read(1)
        if sign != b"\xff":
            return None
        while sign == b"\xff":
            sign = file.read(1)
        if not sign or sign[0] in (0xD9, 0xDA):
            return None
        if sign[0] in BARE:
            continue
        length = file.read(2)
        if len(length) < 2:
            return None
        if sign[0] in FRAMES:
            head = file.read(5)
            return struct.unpack(">HH", head[1:5])[::-1] if len(head) == 5 else None
        file.seek(int.from_bytes(length, "big") - 2, 1)


def image_size(file: BinaryIO) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG, GIF or BMP image from its header, null for other files."""
    head = file.read(32)
    found = png_size(head)
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        found = struct.unpack("<HH", head[6:10])
    elif head[:2] == b"BM" and len(head) >= 26:
        # The older header has 16-bit sizes; a negative height means rows from the top.
        old = struct.unpack("<I", head[14:18])[0] == 12
        width, height = struct.unpack("<HH", head[18:22]) if old else struct.unpack("<ii", head[18:26])
        found = width, abs(height)
    elif head[:2] == b"\xff\xd8":
        found = jpeg_size(file)
    return found if found and found[0] > 0 and found[1] > 0 else None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern")
        self.recursive, self.images = options.get("recursive") == "true", options.get("images") == "true"

    def partitions(self) -> list[Share]:
        """The folders; what is kept of them is one share per FILES_PER_TASK files."""
        system, root, _ = opened(self.path)
        kind = system.get_file_info([root])[0]
        if kind.type == pafs.FileType.File:
            return [Share(root, 0, 1, single=True)]
        if kind.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        shares, folders = [], [root]
        while folders:
            folder, files = folders.pop(), 0
            for info in system.get_file_info(pafs.FileSelector(folder)):
                if info.type == pafs.FileType.File:
                    files += 1
                elif self.recursive and info.type == pafs.FileType.Directory and shown(info.base_name):
                    folders.append(info.path)
            parts = -(-files // FILES_PER_TASK)
            shares += [Share(folder, part, parts) for part in range(parts)]
        return shares or [Share(root, 0, 1)]

    def wanted(self, system: pafs.FileSystem, share: Share) -> Iterator[pafs.FileInfo]:
        if share.single:
            yield from system.get_file_info([share.folder])
            return
        for info in system.get_file_info(pafs.FileSelector(share.folder)):
            name = info.base_name
            if info.type != pafs.FileType.File or not shown(name):
                continue
            if self.pattern and not fnmatch.fnmatchcase(name, self.pattern):
                continue
            if zlib.crc32(name.encode()) % share.parts == share.part:
                yield info

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.path)
        rows: list[tuple] = []
        for info in self.wanted(system, share):
            path = before + info.path
            rows.append(self.image(system, info, path) if self.images else (path, path.rpartition("/")[0], info.size, info.mtime))
            if len(rows) == BATCH_ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def image(self, system: pafs.FileSystem, info: pafs.FileInfo, path: str) -> tuple:
        if not info.size:
            return path, None, None, "empty file"
        with system.open_input_file(info.path) as file:
            found = image_size(file)
        return (path, *found, None) if found else (path, None, None, "not an image")

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        if self.images:
            kinds = {"path": pa.string(), "width": pa.int32(), "height": pa.int32(), "error": pa.string()}
        else:
            kinds = {"path": pa.string(), "directory": pa.string(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC")}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowsmith_files"

    def schema(self) -> str:
        return IMAGES if self.options.get("images") == "true" else FILES

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def files(
    spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False,
    images: bool = False,
) -> DataFrame:
    """Files in a folder (or one file) as rows of FILES, or of IMAGES, also empty ones."""
    spark.dataSource.register(Files)
    reader = spark.read.format(Files.name()).option("path", path)
    reader = reader.option("recursive", recursive).option("images", images)
    return (reader.option("pattern", pattern) if pattern else reader).load()
