"""Keeps a snapshot current from a stream of change records.

Each micro-batch is one processing-time window: its events are coalesced by path, the touched paths are looked at
again, and what has changed is merged into the next version of the snapshot. A batch that reports lost events scans
everything anew. Directories beyond the watch budget send no events: their subtrees are scanned from time to time and
compared. Looking again makes late, repeated and disordered events harmless, so there is no watermark, and a
batch that runs a second time changes nothing.
"""

from __future__ import annotations

import os
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import tree
from ..operators.snapshot import Snapshot
from ..sources import filesystem

STATE = "path string, size long, mtime long, is_dir boolean"


@dataclass
class Status:
    batches: int = 0
    events: int = 0
    reindexed: int = 0
    rescans: int = 0
    pairs: int = 0
    halves: int = 0
    unwatched: list[str] = field(default_factory=list)


def look_again(touches: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(path, size, mtime, is_dir, gone) of touched paths, and of all below those that may be new. Other errors than
    a missing file give nothing."""
    names = frozenset(excluded)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, touch in zip(frame["path"], frame["touch"], strict=True):
                try:
                    s = os.lstat(path)
                except FileNotFoundError:
                    rows.append((path, None, None, None, True))
                    continue
                except OSError:
                    continue
                is_dir = os.path.isdir(path) and not os.path.islink(path)
                rows.append((path, s.st_size, int(s.st_mtime), is_dir, False))
                if is_dir and touch == C.RESCAN:
                    rows += [(r[0], r[5], r[6], r[7], False) for r in filesystem.walk(path, True, names, frozenset()) if r[2]]
            out = pd.DataFrame(rows, columns=["path", "size", "mtime", "is_dir", "gone"])
            yield out.astype({"size": "Int64", "mtime": "Int64", "is_dir": "boolean"})

    return touches.select("path", "touch").mapInPandas(run, f"{STATE}, gone boolean").dropDuplicates(["path"])


def resolve(state: DataFrame, touches: DataFrame, roots: list[str], excluded: list[str] = ()) -> DataFrame:
    """Changes (op, path, size, mtime, is_dir) that bring a state up to date for touched paths under the roots. Rows
    that are the same as before give none; what was below a rescanned directory and is gone is removed."""
    mine = touches.where(T.under_roots(F.col("path"), roots) & T.watchable(F.col("path"), list(excluded)))
    now = look_again(mine, excluded)
    there = now.where("not gone").select(*C.STATE)
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    # a gone path takes all below it along, a rescanned directory is compared with all below it
    over = mine.select(F.col("path").alias("p"), (F.col("touch") == C.RESCAN).alias("deep")).join(now.where("gone").select(F.col("path").alias("p"), F.lit(True).alias("gone")), "p", "left")
    over = over.where(F.col("deep") | F.col("gone"))
    below = state.withColumn("p", F.explode(chain)).join(over, "p").select(*C.STATE)
    own = state.join(mine.select("path"), "path", "left_semi").select(*C.STATE)
    # what was looked at below a directory that wasn't rescanned is compared with its own old row only
    seen = state.join(there.select("path"), "path", "left_semi").select(*C.STATE)
    before = below.unionByName(own).unionByName(seen).dropDuplicates(["path"])
    return C.difference(before, there)


class Watcher:
    """A streaming query that merges changes into a snapshot.

    ``excluded`` names aren't followed but are in the index; ``scan_excludes`` aren't in the index either, nor are
    ``exclude_paths``. Of the directories that are followed, in pre-order, only ``budget`` can be; status.unwatched has the
    roots of the others, which are looked through every ``rescan_s`` seconds.
    """

    def __init__(self, spark: SparkSession, snapshot: Snapshot, roots: list[str], excluded: list[str] = (), exclude_paths: list[str] = (), scan_excludes: list[str] = (), budget: int = 400_000, rescan_s: float = 600.0):
        self.spark, self.snapshot, self.roots = spark, snapshot, [os.path.realpath(r) for r in roots]
        self.excluded, self.exclude_paths, self.scan_excludes = list(excluded), list(exclude_paths), list(scan_excludes)
        self.budget, self.rescan_s = budget, rescan_s
        self.status, self.query = Status(), None
        self._lock, self._ended, self._last_rescan = threading.RLock(), threading.Event(), time.monotonic()

    def reindex(self) -> None:
        self.snapshot.write(filesystem.scan(self.spark, self.roots, self.scan_excludes, self.exclude_paths), roots=self.roots)

    def register(self) -> None:
        """Finds what is beyond the budget: at the start, and after a scan of everything."""
        entries = self.snapshot.read().where("is_dir")
        path = F.concat(T.path_of(F.col("dir_path"), F.col("name")), F.lit("/"))
        dirs = entries.where(T.watchable(path, self.excluded)).select(path.alias("path"), F.col("dir_path").alias("parent"))
        roots = self.spark.createDataFrame([(f"{r.rstrip('/')}/", None) for r in self.roots], "path string, parent string")
        found = tree.unwatched(roots.unionByName(dirs).dropDuplicates(["path"]), self.budget, roots=tuple(self.roots))
        self.status.unwatched = [p.rstrip("/") or "/" for p in found]

    def rescan(self, now: bool = False) -> None:
        """Compares the subtrees that aren't watched, if it is time to."""
        with self._lock:
            if not self.status.unwatched or not now and time.monotonic() - self._last_rescan < self.rescan_s:
                return
            self._last_rescan = time.monotonic()
            self.status.rescans += 1
            self._merge(self.spark.createDataFrame([(p, C.RESCAN) for p in self.status.unwatched], "path string, touch int"))

    def _merge(self, touches: DataFrame) -> None:
        state = C.state_of(self.snapshot.read())
        changes = resolve(state, touches, self.roots, self.excluded).withColumn("seq", F.lit(0).cast("bigint")).persist()
        try:
            if changes.limit(1).count():
                self.snapshot.write(C.as_entries(C.apply(state, changes)))
        finally:
            changes.unpersist()

    def batch(self, events: DataFrame, number: int) -> None:
        events = events.persist()
        try:
            with self._lock:
                self._batch(events)
        finally:
            events.unpersist()
        self.rescan()

    def _batch(self, events: DataFrame) -> None:
        self.status.batches += 1
        got = events.agg(F.count(F.lit(1)).alias("n"), F.bool_or("overflow").alias("lost")).first()
        self.status.events += got.n
        renames = C.rename_pairs(events).first()
        if renames:
            self.status.pairs += renames.pairs
            self.status.halves += renames.halves
        if got.lost:
            self.status.reindexed += 1
            self.reindex()
            self.register()
        else:
            self._merge(C.coalesce(events))

    def start(self, events: DataFrame, checkpoint: str, debounce: str | None = "200 milliseconds"):
        """Starts the query; without ``debounce`` it takes what there is and ends."""
        self.register()
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(processingTime=debounce) if debounce else writer.trigger(availableNow=True)).start()
        if debounce:
            self._ended.clear()
            threading.Thread(target=self._rescan_on_time, daemon=True).start()
        return self.query

    def _rescan_on_time(self) -> None:
        """Without events there are no batches, but what isn't watched changes all the same."""
        while not self._ended.wait(min(self.rescan_s, 1.0)):
            self.rescan()

    def stop(self) -> None:
        """Ends the query after the batch that is being merged."""
        self._ended.set()
        with self._lock:
            if self.query is not None:
                self.query.stop()
                self.query = None
