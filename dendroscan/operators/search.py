"""Ranked search over entries (id, dir_path, name, depth, size, mtime, is_dir)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.compile import predicate, prefilter, total_score
from ..plans.query import Query, parse

HIT = ("id", "path", "name", "size", "mtime", "is_dir", "score")


@dataclass
class SearchResults:
    """``hits`` in order. ``total`` and ``truncated`` are known once the hits have been computed: the same pass counts the
    matches. ``scanned``, the entries that were searched, is counted when it is asked for; of a Parquet table that
    reads no more than the files' footers."""

    hits: DataFrame
    query: Query
    limit: int
    seen: Observation | None = None
    error: str | None = None
    searched: DataFrame | None = None

    @property
    def total(self) -> int:
        return int(self.seen.get["total"]) if self.seen else 0

    @cached_property
    def scanned(self) -> int:
        return self.searched.count() if self.searched is not None else 0

    @property
    def truncated(self) -> bool:
        return self.total > self.limit


def matched(entries: DataFrame, query: Query | str) -> DataFrame:
    """All matches, with their score. Nothing for an empty query or one with an error."""
    q = parse(query) if isinstance(query, str) else query
    if q.empty or q.error:
        return entries.withColumn("score", F.lit(0)).limit(0)
    test = predicate(q, entries.columns)
    if {"sig", "sig2"} <= set(entries.columns) and q.terms:
        test = prefilter(q) & test
    return entries.where(test).withColumn("score", total_score(q))


def ranked(matches: DataFrame, limit: int) -> DataFrame:
    """The best matches in a total order; paths are put together for these alone."""
    order = (F.desc("score"), F.asc("plen"), F.desc("mtime_key"), F.asc("id"))
    keyed = matches.withColumns({"plen": T.place_length(F.col("depth"), F.col("name")), "mtime_key": T.clamped_mtime(F.col("mtime"))})
    top = keyed.select("id", "dir_path", "name", "size", "mtime", "is_dir", "score", "plen", "mtime_key").orderBy(*order).limit(max(limit, 1))
    return top.select("id", T.path_of(F.col("dir_path"), F.col("name")).alias("path"), *HIT[2:])


def search(entries: DataFrame, query: Query | str, limit: int = 20, count: bool = True) -> SearchResults:
    """The ``limit`` best entries (0 acts as 1) by score, shallow and short paths, late mtime, then id."""
    q = parse(query) if isinstance(query, str) else query
    found = matched(entries, q)
    if q.empty or q.error:
        return SearchResults(ranked(found, limit), q, limit, error=q.error)
    seen = None
    if count:  # above the filter, which so reaches the reader
        seen = Observation()
        found = found.observe(seen, F.count(F.lit(1)).alias("total"))
    return SearchResults(ranked(found, limit), q, limit, seen, searched=entries)


class Typeahead:
    """Searches that go on from what the text before matched, if that is sure to hold all matches.

    Up to ``keep`` matches stay cached. A new version of the entries begins anew.
    """

    def __init__(self, keep: int = 150_000):
        self.keep, self.query, self.version, self.subset = keep, None, None, None

    def search(self, entries: DataFrame, text: str, limit: int = 20, version: object = None) -> SearchResults:
        q = parse(text)
        refined = self.subset is not None and version == self.version and self.query is not None and q.refines(self.query)
        base = self.subset if refined else entries
        found = matched(base, q).drop("score").persist()
        if not q.error and not q.empty and found.limit(self.keep + 1).count() <= self.keep:
            old, self.subset = self.subset, found
            self.query, self.version = q, version
            out = search(found, q, limit)
            out.searched = base
            if old is not None and old is not found:
                out.scanned  # noqa: B018 - while the matches before are still there
                old.unpersist()
            return out
        found.unpersist()
        self.subset = self.query = None
        return search(base, q, limit)
