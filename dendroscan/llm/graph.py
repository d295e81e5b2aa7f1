"""Connected components by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freeing, met, released, shared_dir


def components(edges: DataFrame, few: int = 120_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is its smallest node.

    Each round links a node's neighbours to the smallest of them instead. Minima are summed on the map side and
    joined back: by a broadcast up to ``few`` edges, else by a shuffle in which the edges of the nodes with the most
    neighbours are dealt out evenly, so no task gathers a hub's. Rounds, logarithmic in the longest path, are
    written as tables to the shared folder: a checkpoint would inherit the estimated size, which every join squares. Loops and
    repeated edges don't matter; null ends are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        with freeing(spark):
            df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def joined(rows: DataFrame, side: DataFrame, small: bool, name: str) -> tuple[DataFrame, DataFrame]:
        """rows with the minimum of u, and the minima."""
        if small:
            return rows.join(F.broadcast(side), "u"), side
        side = written(side, name)
        return met(rows, side, "u", "n", F.col("v")), side

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0")
    seen, n, total = None, 0, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = e.agg(F.count(F.lit(1)), total).first()
    while now != seen:
        seen, n, small = now, n + 1, now[0] <= few
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # the neighbours above a node, and the node itself, go to the smallest
        above, low = joined(both.where("v > u"), low, small, f"{n}-low")
        large = written(above.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{n}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        rest, least = joined(large, least, small, f"{n}-least")
        rest = rest.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), str(n))
        now = e.agg(F.count(F.lit(1)), total).first()
        released(spark)
    # every edge leads to the smallest node of its component now
    out = durable(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
