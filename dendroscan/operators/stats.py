"""Catalog statistics and order statistics of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_stats(entries: DataFrame) -> DataFrame:
    """One row: ``dirs``, ``files``, ``total``, and ``errors`` where the entries say what couldn't be read."""
    errors = [F.count_if(F.col("error")).alias("errors")] if "error" in entries.columns else []
    return entries.agg(F.count_if(F.col("is_dir")).alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), F.count(F.lit(1)).alias("total"), *errors)


def index_stats(entries: DataFrame) -> DataFrame:
    """One row: ``entries``, ``directories`` (that hold any), ``name_bytes``, ``total_size``."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("dir_path").alias("directories"), F.sum(F.octet_length("name")).cast("long").alias("name_bytes"), F.sum("size").cast("long").alias("total_size"))


def garbage_ratio(log: DataFrame, live: str) -> DataFrame:
    """One row: share of the rows that ``live`` doesn't hold for."""
    return log.agg((F.count_if(F.expr(f"not ({live})")) / F.count(F.lit(1))).alias("garbage"))


def timings(times: DataFrame, value: str, *keys: str, parts: int = 64) -> DataFrame:
    """Minimum, p50, p95 and maximum by place in the sorted times (no interpolation), exactly. Nulls don't count; keys
    without any time have no row.

    Equal times are counted on the map side. The counts are summed in two levels, over ``parts`` ranges of values and
    inside each, so no task sorts all times of a key.
    """
    times = times.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull())
    bounds = times.agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 1000).alias("b")).first().b or []
    counts = times.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("value"))) if bounds else F.lit(0))
    ranges = counts.groupBy(*keys, "part").agg(F.sum("n").alias("all"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"), F.sum("all").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("n").over(inside)).join(ranges, [*keys, "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    at = lambda f, name: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * F.lit(f)), F.col("value"))).alias(name)
    return placed.groupBy(*keys).agg(at(0.0, "min"), at(0.5, "p50"), at(0.95, "p95"), at(1.0, "max"))


def crossing_ratio(entries: DataFrame, inside, across) -> DataFrame:
    """Share of the directories into which a path term's end may lead, though it isn't inside them."""
    return entries.select("dir_path").distinct().agg(F.avg((across & ~inside).cast("double")).alias("crossing"))
