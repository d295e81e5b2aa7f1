"""One object over a session: index, search, watch, preview."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import changes as C
from .operators import preview as P
from .operators import search as S
from .operators import stats
from .operators.snapshot import Snapshot
from .sources import filesystem
from .sources.config import Config
from .streaming.watch import Watcher


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config.load()
        self.snapshot = Snapshot(spark, self.config.snapshot_dir)
        self.typeahead = S.Typeahead()

    @property
    def generation(self) -> int:
        return self.snapshot.version

    @property
    def roots(self) -> list[str]:
        return self.snapshot.meta().get("roots") or [os.path.realpath(r) for r in self.config.roots]

    def entries(self) -> DataFrame:
        return self.snapshot.read()

    def is_empty(self) -> bool:
        return self.entries().limit(1).count() == 0

    def _scan(self, roots: list[str]) -> DataFrame:
        return filesystem.scan(self.spark, roots, self.config.scan_excludes, self.config.exclude_paths)

    def reindex(self, roots: list[str] | None = None) -> int:
        roots = [os.path.realpath(r) for r in roots or self.roots]
        return self.snapshot.write(self._scan(roots), roots=roots, last_scan=int(time.time()))

    def add_root(self, path: str) -> int:
        """Scans one more directory; nothing happens if it is a root already. Each path stays once."""
        path = os.path.realpath(path)
        if not os.path.isdir(path):
            raise NotADirectoryError(path)
        if self.generation and path in self.roots:
            return self.generation
        old, new = self.entries(), self._scan([path])
        names = ["id", "dir_path", "name", "depth", "size", "mtime", "is_dir", *C.KEPT]
        both = old.select(*names).join(new.select("dir_path", "name"), ["dir_path", "name"], "left_anti").select(*names).unionByName(new.select(*names))
        return self.snapshot.write(both, roots=[*(self.roots if self.generation else []), path])

    def search(self, query: str, limit: int = 20) -> S.SearchResults:
        """Goes on from the matches of the text before, where that is sound."""
        return self.typeahead.search(self.entries(), query, limit, self.generation)

    def search_uncached(self, query: str, limit: int = 20) -> S.SearchResults:
        return S.search(self.entries(), query, limit)

    def apply_events(self, changes: DataFrame) -> dict:
        """Merges changes (seq, op, path, size, mtime, is_dir); what was added, updated and removed."""
        state = C.state_of(self.entries())
        got = C.outcome(state, changes).first().asDict()
        self.snapshot.write(C.as_entries(C.apply(state, changes)))
        return got

    def preview(self, path: str, limits: P.Limits = P.Limits()) -> dict:
        return P.preview(path, limits)

    def stats(self) -> dict:
        meta = self.snapshot.meta()
        return stats.index_stats(self.entries()).first().asDict() | {"bytes_on_disk": self.snapshot.size_on_disk(), "roots": self.roots, "last_scan": meta.get("last_scan"), "generation": self.generation}

    def watcher(self) -> Watcher:
        c = self.config
        return Watcher(self.spark, self.snapshot, self.roots, c.watch_excludes, c.exclude_paths, c.scan_excludes, c.watch_budget, c.watch_rescan_s)

    def clear(self) -> None:
        self.snapshot.clear()
