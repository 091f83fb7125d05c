"""A source tree as a Spark data source: folders are pruned before anything in them is opened.

``spark.dataSource.register(SourceTree)`` makes ``spark.read.format("source_tree").load(root)``
and ``spark.readStream.format("source_tree").load(root)`` known. Partitions are folders: the
driver lists the upper levels of the tree only, and tasks walk and read the rest. The root must
be a place that all executors see (a shared folder, or an address that Arrow's file systems know).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.files import PRUNED

SCHEMA = "file_path string, text string, byte_size long, file_hash string, modified_at timestamp"
#: Folders that the driver looks for before tasks go on, and levels that it goes down at most.
FOLDERS, LEVELS = 512, 6


@dataclass
class Folder(InputPartition):
    """A folder below the root, with all below it or only its own files; changes after ``since`` up to ``until`` (ns)."""

    path: str
    deep: bool
    since: int = -1
    until: int = -1


def _opened(root: str):
    """A file system and the path of the root there."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class Tree:
    """Listing and reading of one tree, on the driver and in tasks."""

    def __init__(self, options: dict[str, str]):
        self.root = (options.get("path") or "").rstrip("/")
        if not self.root:
            raise ValueError("load a folder")
        names = options.get("pruned")
        self.pruned = frozenset(PRUNED if names is None else [n for n in names.split(",") if n])
        self.dropped = tuple(n for n in options.get("dropped", "").split(",") if n)
        self.settled = float(options.get("settled", "2"))
        self.endings = tuple(e for e in options.get("endings", "").split(",") if e)

    def entries(self, files, base: str, folder: str) -> tuple[list[str], list]:
        """Folders below one that aren't pruned, and its files, as paths below the root."""
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        below, own = [], []
        for info in sorted(found, key=lambda x: x.path):
            name = info.path.rsplit("/", 1)[-1]
            path = f"{folder}/{name}" if folder else name
            if any(path.startswith(d) for d in self.dropped):
                continue
            if info.type == fs.FileType.Directory:
                if name not in self.pruned:
                    below.append(path)
            elif info.type == fs.FileType.File and (not self.endings or path.endswith(self.endings)):
                own.append((path, info))
        return below, own

    def partitions(self, since: int = -1, until: int = -1) -> list[Folder]:
        files, base = _opened(self.root)
        level, out = [""], []
        for _ in range(LEVELS):
            below = []
            for folder in level:
                folders, own = self.entries(files, base, folder)
                below += folders
                if own:
                    out.append(Folder(folder, False, since, until))
            level = below
            if len(level) + len(out) >= FOLDERS:
                break
        return out + [Folder(f, True, since, until) for f in level] or [Folder("", False, since, until)]

    def read(self, part: Folder) -> Iterator[tuple]:
        files, base = _opened(self.root)
        waiting = [part.path]
        while waiting:
            below, own = self.entries(files, base, waiting.pop())
            waiting += below if part.deep else []
            for path, info in own:
                changed = info.mtime_ns if info.mtime_ns is not None else 0
                if changed > part.since and (part.until < 0 or changed <= part.until):
                    with files.open_input_stream(info.path) as stream:
                        content = stream.read()
                    yield path, content.decode("utf-8", "replace"), len(content), hashlib.sha256(content).hexdigest(), info.mtime


class SourceTree(DataSource):
    """Options: path; pruned (folder names, by commas), dropped (path prefixes), endings (of file names), settled (seconds, of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Tree(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(Tree(dict(self.options)))


class _Reader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Folder]:
        return self.tree.partitions()

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from self.tree.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files that were changed after its start and up to its end.

    The end lies ``settled`` seconds back, so that a file is not missed which is written while
    others are listed. A file that changes again before its batch is read comes with a later one.
    """

    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.tree.settled * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.tree.partitions(start["until"], max(end["until"], 0))

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from self.tree.read(partition)


def source_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """All files of a tree that aren't pruned, with their texts."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def changed_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A stream of files as they change. A file that was only touched comes again: ``files.unseen`` leaves it out."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").options(**options).load(root)
