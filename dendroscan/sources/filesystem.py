"""Filesystem trees as a Spark data source, and logs of their changes as a stream."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import DIR, HIDDEN, SYMLINK, id_of

SCHEMA = "path string, dir_path string, name string, name_bytes binary, depth int, size long, mtime long, is_dir boolean, is_symlink boolean, flags int, error boolean"


class Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _row(entry: os.DirEntry, folder: str) -> tuple:
    name, failed = os.fsencode(entry.name), False
    link, is_dir = entry.is_symlink(), entry.is_dir(follow_symlinks=False)
    try:
        s = entry.stat(follow_symlinks=False)
        size, mtime = s.st_size, int(s.st_mtime)
    except OSError:
        size, mtime, failed = 0, 0, True
    shown, above = name.decode("utf-8", "replace"), os.fsencode(folder).decode("utf-8", "replace").rstrip("/") + "/"
    flags = DIR * is_dir | SYMLINK * link | HIDDEN * name.startswith(b".")
    return above + shown, above, shown, name, sum(1 for x in above.split("/") if x), size, mtime, is_dir, link, flags, failed


def walk(root: str, deep: bool, names: frozenset[str], paths: frozenset[str]) -> Iterator[tuple]:
    """Rows of everything below a root, but for excluded directories and what is in them. No links are followed. A
    folder that can't be read gives nothing but a row with ``error``."""
    todo = [root]
    while todo:
        folder = todo.pop()
        try:
            entries = list(os.scandir(folder))
        except OSError:
            if folder == root or deep:
                above = folder.rstrip("/") + "/"
                yield above, above, "", b"", 0, 0, 0, True, False, DIR, True
            continue
        for e in entries:
            is_dir = e.is_dir(follow_symlinks=False)
            if is_dir and (e.name in names or e.path in paths):
                continue
            yield _row(e, folder)
            if is_dir and deep:
                todo.append(e.path)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.realpath(r) for r in options["roots"].split("\n") if r]
        self.names = frozenset(x for x in options.get("exclude_names", "").split("\n") if x)
        self.paths = frozenset(x for x in options.get("exclude_paths", "").split("\n") if x)

    def partitions(self) -> list[Subtree]:
        """A partition for each root's own entries and one for each directory two levels down at most."""
        out = []
        for root in self.roots:
            level = [root]
            for _ in range(2):
                below = []
                for folder in level:
                    out.append(Subtree(folder, False))
                    try:
                        below += [e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and e.name not in self.names and e.path not in self.paths]
                    except OSError:
                        continue
                level = below
            out += [Subtree(folder, True) for folder in level]
        return out

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return walk(partition.path, partition.deep, self.names, self.paths)


class TreeSource(DataSource):
    """spark.read.format("tree").option("roots", ...): entries below folders that all machines see alike."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], exclude_names: list[str] = (), exclude_paths: list[str] = ()) -> DataFrame:
    """Entries below the roots, each path once though roots overlap; ``id`` is a hash of the path. Names that aren't
    UTF-8 keep their bytes in name_bytes, and stay apart though they look alike."""
    spark.dataSource.register(TreeSource)
    df = spark.read.format("tree").options(roots="\n".join(roots), exclude_names="\n".join(exclude_names), exclude_paths="\n".join(exclude_paths)).load()
    return df.where("name <> ''").dropDuplicates(["path", "name_bytes"]).withColumn("id", id_of(F.col("path"), F.col("name"), F.col("name_bytes")))


def scan_errors(spark: SparkSession, roots: list[str]) -> DataFrame:
    """What could not be read below the roots."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("roots", "\n".join(roots)).load().where("error").select("path")


CHANGES = "ts timestamp, kind string, paths array<string>, tracker long, overflow boolean"


def change_log(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of change records that some watcher writes to a folder as JSON lines."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)
