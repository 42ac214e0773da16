"""A folder of files as a Spark data source: a row for each file, read and parsed where its partition runs.

    spark.dataSource.register(FolderSource)
    spark.read.format("plumbline_folder").load("/data/corpus")

The driver lists the folder in walk order (a folder's files by name, then its folders), names that start with a dot or
an underscore included, and deals the files into partitions of about ``partitionBytes`` bytes and at most
``partitionFiles`` files. A task reads one file at a time, so it holds no more than a file and what its text gives. A
file or folder that can't be read isn't an error: the file's row says why, the folder's files are left out. A missing or
empty folder has no rows. The path may be a local or mounted one, or an address that Arrow's file systems know.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.paths import IGNORED
from plumbline.sources.files import UNREADABLE, kind_by, parse_one

SCHEMA = "position long, path string, size long, kind string, segments array<struct<locator:string,text:string>>, skipped string, withdrawn boolean"
PARTITION_BYTES, PARTITION_FILES = 64 * 1024 * 1024, 5000


@dataclass(frozen=True)
class Found:
    """A listed file; size -1 where it isn't told."""

    path: str
    size: int


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/") or "/"


def walk(root: str) -> Iterator[Found]:
    """Files below a folder in walk order, their paths relative to it; folders that can't be listed are left out."""
    system, top = _opened(root)
    waiting = [""]
    while waiting:
        below = waiting.pop()
        try:
            listed = system.get_file_info(fs.FileSelector(f"{top}/{below}".rstrip("/"), allow_not_found=True))
        except OSError:
            continue
        named = sorted((i.base_name, i) for i in listed)
        yield from (Found(below + name, -1 if i.size is None else i.size) for name, i in named if i.type != fs.FileType.Directory)
        waiting += [f"{below}{name}/" for name, i in reversed(named) if i.type == fs.FileType.Directory and name not in IGNORED]


def fingerprint(root: str) -> str:
    """Of a whole folder: SHA-1 over ``path:size`` lines in walk order. Only the listing is read, which the driver holds
    anyway."""
    digest = hashlib.sha1()
    for file in walk(root):
        digest.update(f"{file.path}:{file.size}\n".encode("utf-8", "surrogateescape"))
    return digest.hexdigest()


@dataclass
class Files(InputPartition):
    """Files of one task, with the place of the first."""

    position: int
    files: list[Found]


class FolderReader(DataSourceReader):
    def __init__(self, root: str, most_bytes: int, most_files: int):
        self.root, self.most_bytes, self.most_files = root, most_bytes, most_files

    def partitions(self) -> list[Files]:
        out, held, size, position = [], [], 0, 0
        for file in walk(self.root):
            if held and (size + max(0, file.size) > self.most_bytes or len(held) == self.most_files):
                out.append(Files(position, held))
                position, held, size = position + len(held), [], 0
            held.append(file)
            size += max(0, file.size)
        # One partition at least: without any file it is an empty one.
        return [*out, Files(position, held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, top = _opened(self.root)
        for k, file in enumerate(partition.files):
            try:
                with system.open_input_stream(f"{top}/{file.path}", compression=None) as stream:
                    raw = stream.read()
            except PermissionError:
                yield partition.position + k, file.path, file.size, kind_by(file.path, b""), [], UNREADABLE, False
                continue
            except OSError as e:
                yield partition.position + k, file.path, file.size, kind_by(file.path, b""), [], f"{type(e).__name__}: {e}"[:120], False
                continue
            kind = kind_by(file.path, raw[:8])
            segments, skipped, withdrawn = parse_one(file.path, kind, raw)
            yield partition.position + k, file.path, file.size, kind, segments, skipped, withdrawn


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), int(self.options.get("partitionFiles", PARTITION_FILES)))


def scan(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """position, path, size, kind, segments, skipped and withdrawn of a folder's files."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).options(**options).load(root)
