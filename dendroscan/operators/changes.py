"""Change streams over entries: coalescing, resolution, differences, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHECK, RESCAN = 1, 2
RESCANNED = ("create", "rename_to", "rename_any", "any")
CHECKED = ("remove", "rename_from", "modify")
STATE = ("path", "size", "mtime", "is_dir")
#: What an entry keeps through updates, where a state has it.
KEPT = ("flags", "name_bytes")


def state_of(entries: DataFrame) -> DataFrame:
    """The state (path, size, mtime, is_dir, and what is kept) of entries."""
    return entries.select(T.path_of(F.col("dir_path"), F.col("name")).alias("path"), *STATE[1:], *[c for c in KEPT if c in entries.columns])


def touch(kind: Column, nth: Column) -> Column:
    """How an event touches its nth path: look again, or look again with all below. Other kinds don't."""
    return F.when(kind.isin(*RESCANNED), RESCAN).when(kind.isin(*CHECKED), CHECK).when((kind == "rename_both") & (nth == 0), CHECK).when((kind == "rename_both") & (nth == 1), RESCAN)


def coalesce(events: DataFrame, window: str | None = None) -> DataFrame:
    """Strongest touch of each path (in each ``window`` of ts, for replayed logs): ``path``, ``touch``. Events that
    report an overflow touch nothing; see overflows()."""
    keys = [F.window("ts", window)["start"].alias("window_start")] if window else []
    spread = events.where(~F.col("overflow")).select(*keys, "kind", F.posexplode("paths").alias("nth", "path"))
    names = [c for c in spread.columns if c in ("window_start", "path")]
    return spread.withColumn("touch", touch(F.col("kind"), F.col("nth"))).where("touch is not null").groupBy(*names).agg(F.max("touch").alias("touch"))


def overflows(events: DataFrame, window: str) -> DataFrame:
    """``window_start`` and whether any of its events was lost, so that all must be scanned anew."""
    return events.groupBy(F.window("ts", window)["start"].alias("window_start")).agg(F.bool_or("overflow").alias("overflow"))


def rename_pairs(events: DataFrame, *keys: Column) -> DataFrame:
    """One row (per keys): ``pairs`` of renames seen from both ends, and ``halves``."""
    both = F.col("kind") == "rename_both"
    sides = events.where(F.col("tracker").isNotNull() & F.startswith("kind", F.lit("rename")) & ~F.col("overflow")).groupBy(*keys, "tracker").agg(F.bool_or(both | (F.col("kind") == "rename_from")).alias("a"), F.bool_or(both | (F.col("kind") == "rename_to")).alias("b"))
    names = [c for c in sides.columns if c not in ("tracker", "a", "b")]
    return sides.groupBy(*names).agg(F.count_if(F.col("a") & F.col("b")).alias("pairs"), F.count_if(~(F.col("a") & F.col("b"))).alias("halves"))


def last_per_path(changes: DataFrame) -> DataFrame:
    """Of the changes of a path the one with the highest seq. Summed on the map side."""
    rest = [c for c in changes.columns if c not in ("path", "seq")]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("last"), F.max("seq").alias("seq"))
    return last.select("path", "seq", "last.*")


def replay(changes: DataFrame) -> DataFrame:
    """The state (path, size, mtime, is_dir) that a log of upserts and removals of single paths leaves."""
    return last_per_path(changes).where("op = 'upsert'").select(*STATE)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns one state into the other: ``op`` (upsert, remove or remove_dir), ``path``, ``size``, ``mtime``,
    ``is_dir``. Rows that are the same in both give nothing."""
    a, b = before.select(*STATE).alias("a"), after.select(*STATE).alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.is_dir").eqNullSafe(F.col("b.is_dir"))
    gone = F.col("b.path").isNull()
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").where(gone | F.col("a.path").isNull() | ~same)
    return joined.select(
        F.when(gone & F.col("a.is_dir"), "remove_dir").when(gone, "remove").otherwise("upsert").alias("op"),
        F.coalesce("a.path", "b.path").alias("path"),
        *[F.when(~gone, F.col(f"b.{c}")).alias(c) for c in ("size", "mtime")],
        F.when(gone, F.col("a.is_dir")).otherwise(F.col("b.is_dir")).alias("is_dir"),
    )


def lookup(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Changes with the id of the entry at their path, null if there is none."""
    at = entries.select(F.col("id").alias("entry_id"), T.path_of(F.col("dir_path"), F.col("name")).alias("at"))
    return changes.join(at, changes.path == at["at"], "left").drop("at")


def touched(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The entries in directories that a change touches."""
    dirs = changes.select(T.parent_of(F.col("path")).alias("dir_path")).distinct()
    return entries.join(dirs, "dir_path", "left_semi")


def _removed_below(state: DataFrame, dirs: DataFrame) -> DataFrame:
    """The rows of a state that aren't a removed directory (path, seq) or below one. A row is met through its own
    chain of parents, so the join is by equality."""
    parts = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spread = state.select(F.col("path").alias("below"), "seq", F.explode(chain).alias("path"))
    hit = spread.join(dirs.select("path", F.col("seq").alias("removed")), "path").where("seq < removed").select(F.col("below").alias("path")).distinct()
    return state.join(hit, "path", "left_anti")


def apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state (path, size, mtime, is_dir) after changes (seq, op, path, size, mtime, is_dir). Of a path's changes
    the last wins; removing a directory removes what is below it, but for what comes after. Where the state has flags or
    raw names, an updated path keeps its own, and a new one has null."""
    last = last_per_path(changes)
    extra = [c for c in KEPT if c in state.columns]
    kept = state.select(*STATE, *extra).join(last.select("path"), "path", "left_anti").withColumn("seq", F.lit(-1).cast("bigint"))
    new = last.where("op = 'upsert'").select(*STATE, "seq")
    if extra:
        new = new.join(state.select("path", *extra), "path", "left")
    dirs = changes.where("op = 'remove_dir'").groupBy("path").agg(F.max("seq").alias("seq"))
    return _removed_below(kept.unionByName(new), dirs).select(*STATE, *extra)


def outcome(state: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: ``added``, ``updated``, ``removed`` (subtrees included) of apply()."""
    after = apply(state, changes)
    a, b = state.select(F.col("path").alias("p"), F.struct("size", "mtime", "is_dir").alias("old")), after.select("path", F.struct("size", "mtime", "is_dir").alias("new"))
    touched = last_per_path(changes).where("op = 'upsert'").select(F.col("path").alias("t"))
    joined = a.join(b, a.p == b.path, "full_outer").join(touched, F.col("path") == F.col("t"), "left")
    return joined.agg(F.count_if(F.col("p").isNull()).alias("added"), F.count_if(F.col("p").isNotNull() & F.col("path").isNotNull() & F.col("t").isNotNull()).alias("updated"), F.count_if(F.col("path").isNull()).alias("removed"))


def as_entries(state: DataFrame) -> DataFrame:
    """Entries of a state; ids by hash of the path."""
    path = F.col("path")
    extra = [c for c in KEPT if c in state.columns]
    raw = F.col("name_bytes") if "name_bytes" in extra else F.lit(None).cast("binary")
    return state.select(T.id_of(path, T.file_name(path), raw).alias("id"), T.parent_of(path).alias("dir_path"), T.file_name(path).alias("name"), T.depth_of(T.parent_of(path)).alias("depth"), "size", "mtime", "is_dir", *extra)


def numbered(events: DataFrame) -> DataFrame:
    """A log without seq gets one by its ts."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("ts")))
