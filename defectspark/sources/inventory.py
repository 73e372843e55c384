"""File inventory as a Python data source: every file of a tree, empty ones included.

Spark's own file sources leave zero-byte files out, so an audit cannot rely on them. Local folders
are read entry by entry; other addresses through the Arrow file systems (object stores, HDFS).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes bigint, modified_ms bigint"


@dataclass
class Entry:
    """A file or folder: ``path`` is relative to the root; size and time are read when asked for."""

    path: str
    name: str
    is_folder: bool
    info: object

    def row(self) -> tuple:
        if isinstance(self.info, os.DirEntry):
            stat = self.info.stat()
            return self.path, stat.st_size, int(stat.st_mtime * 1000)
        when = self.info.mtime_ns
        return self.path, self.info.size, None if when is None else when // 1_000_000


def entries(root: str, folder: str, file_system: tuple | None = None) -> Iterator[Entry]:
    """What lies directly in ``folder``, a path relative to ``root``; ``file_system`` and its path stand in for the root's."""
    local = root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:")
    inside = lambda name: f"{folder}/{name}" if folder else name
    if "://" not in local:
        with os.scandir(os.path.join(local, folder)) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield Entry(inside(e.name), e.name, True, e)
                elif e.is_file():
                    yield Entry(inside(e.name), e.name, False, e)
        return
    from pyarrow import fs  # starts threads, so only where it is needed

    system, base = fs.FileSystem.from_uri(root) if file_system is None else file_system
    place = base.rstrip("/") + ("/" + folder if folder else "")
    for info in system.get_file_info(fs.FileSelector(place, recursive=False)):
        yield Entry(inside(info.base_name), info.base_name, info.type == fs.FileType.Directory, info)


class FolderPartition(InputPartition):
    """One of ``slices`` shares of a folder's own entries, by the hash of their names."""

    def __init__(self, folder: str, recursive: bool, share: int, slices: int):
        self.folder, self.recursive, self.share, self.slices = folder, recursive, share, slices


class InventoryReader(DataSourceReader):
    """Splits the tree into folders down to ``depth`` and every folder into ``slices``; deeper levels are walked in tasks.

    Only folder names down to that depth are listed on the driver. A slice lists its folder's names,
    which is quick, and reads size and time of its own share of them, so one huge flat folder is
    shared by several tasks.
    """

    def __init__(self, root: str, depth: int, slices: int, skip: list[str]):
        self.root, self.depth, self.slices, self.skip = root, depth, slices, skip

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        level = [""]
        for _ in range(self.depth):
            parts += [FolderPartition(folder, False, i, self.slices) for folder in level for i in range(self.slices)]
            level = sorted(e.path for folder in level for e in entries(self.root, folder) if e.is_folder and e.name not in self.skip)
        return parts + [FolderPartition(folder, True, i, self.slices) for folder in level for i in range(self.slices)]

    def read(self, partition: FolderPartition) -> Iterator[tuple]:
        stack = [partition.folder]
        while stack:
            folder = stack.pop()
            for entry in entries(self.root, folder):
                # Below the partition's own folder everything belongs to the share that came there.
                own = folder != partition.folder or zlib.crc32(os.fsencode(entry.name)) % partition.slices == partition.share
                if not own:
                    continue
                if not entry.is_folder:
                    yield entry.row()
                elif partition.recursive and entry.name not in self.skip:
                    stack.append(entry.path)


class InventorySource(DataSource):
    """``spark.read.format("file_inventory").load(root)``; options ``depth``, ``slices`` and ``skip``."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        skip = [name for name in self.options.get("skip", "").split(",") if name]
        return InventoryReader(self.options["path"], int(self.options.get("depth", "1")), int(self.options.get("slices", "1")), skip)


def read_inventory(spark: SparkSession, root: str, depth: int = 1, skip: list[str] | None = None, slices: int = 4) -> DataFrame:
    """Path below the root, size and time of every file below it, empty files included."""
    spark.dataSource.register(InventorySource)
    reader = spark.read.format("file_inventory").option("depth", str(depth)).option("slices", str(slices))
    return reader.option("skip", ",".join(skip or [])).load(root)


def qualified(spark: SparkSession, root: str) -> str:
    """The full address of a folder, as Spark writes it into file paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
