"""Versioned snapshots of entries in Parquet, behind any filesystem that Spark knows.

A write goes to a new folder; then a small pointer file names it. Pointers are numbered and put in place by a rename
to a new name; readers follow the last one, so they never see a half-written version or none, and the version that is being
read is never overwritten.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, dir_path string, name string, depth int, size long, mtime long, is_dir boolean, flags int, ext string, sig long, sig2 long, name_bytes binary"
VERSION = 2


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[tuple[int, object]]:
        """(number, path) of the pointers, in order."""
        fs, p = self._fs(self.folder)
        names = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(((int(m[1]), x) for x in names if (m := re.fullmatch(r"meta-([0-9]+)\.json", x.getName()))), key=lambda x: x[0])

    def meta(self) -> dict:
        """Key-value pairs; empty if there is no snapshot or one of another schema version, which is built anew."""
        found = self._pointers()
        if not found:
            return {}
        fs, _ = self._fs(self.folder)
        stream = fs.open(found[-1][1])
        try:
            got = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return got if got.get("schema_version") == VERSION else {}

    def set_meta(self, keep: int = 3, **pairs) -> None:
        got = {"schema_version": VERSION} | self.meta() | pairs
        old = self._pointers()
        number = old[-1][0] + 1 if old else 1
        fs, new = self._fs(f"{self.folder}/meta-{number:09}.json.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(got), "utf-8"))
        out.close()
        if not fs.rename(new, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/meta-{number:09}.json")):
            raise OSError(f"{self.folder}: another writer has put pointer {number} there")
        for _, path in old[: 1 - keep or None]:
            fs.delete(path, False)

    @property
    def version(self) -> int:
        return int(self.meta().get("version", 0))

    def read(self) -> DataFrame:
        """The current entries; none if there is no snapshot."""
        if not self.version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v={self.version}")

    def write(self, entries: DataFrame, files: int | None = None, keep: int = 2, **meta) -> int:
        """Writes entries as the next version, sorted by directory so that paths compress and prune, and drops all
        but the last ``keep`` versions. What the names and kinds say of the flags is set anew, links stay links; names that
        aren't UTF-8 keep their bytes."""
        from ..functions import text as T

        new = self.version + 1
        link = F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(T.SYMLINK)) != 0 if "flags" in entries.columns else F.lit(False)
        raw = F.when(F.col("name_bytes") != F.encode("name", "UTF-8"), F.col("name_bytes")) if "name_bytes" in entries.columns else F.lit(None)
        entries = entries.withColumns({"flags": T.flags_of(F.col("name"), F.col("is_dir"), link), "name_bytes": raw})
        extra = {"ext": T.extension(F.col("name")), "sig": T.signature(F.col("name")), "sig2": T.signature2(F.col("name"))}
        df = entries.withColumns({k: v for k, v in extra.items() if k not in entries.columns})
        df = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")])
        df = df.repartitionByRange(files, "dir_path", "name") if files else df.repartitionByRange("dir_path", "name")
        df.sortWithinPartitions("dir_path", "name").write.mode("overwrite").parquet(f"{self.folder}/v={new}")
        self.set_meta(version=new, written=int(time.time()), **meta)
        fs, _ = self._fs(self.folder)
        for old in range(max(new - keep - 2, 1), new - keep + 1):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v={old}"), True)
        return new

    def size_on_disk(self) -> int:
        fs, p = self._fs(self.folder)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def clear(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)
