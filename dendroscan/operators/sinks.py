"""Hits as lines of JSON and of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def json_hits(hits: DataFrame) -> DataFrame:
    """One JSON object a line: path, size, modified, directory."""
    return hits.select(F.to_json(F.struct("path", "size", F.col("mtime").alias("modified"), F.col("is_dir").alias("directory"))).alias("line"))


def text_hits(hits: DataFrame) -> DataFrame:
    """Score, size and path; directories end in a slash."""
    path = F.concat("path", F.when(F.col("is_dir"), "/").otherwise(""))
    return hits.select(F.concat(F.lpad(F.col("score").cast("string"), 4, " "), F.lit("  "), F.lpad(T.human_size(F.col("size")), 9, " "), F.lit("  "), path).alias("line"))
