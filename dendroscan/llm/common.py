"""What the operators share: durable lineage cuts, ASCII case folding, Arrow output in bounded batches."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one JVM
    gets a folder of its own; a cluster must name one, for a folder of the driver's machine isn't shared there."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        got = "file://" + tempfile.mkdtemp(prefix="dendroscan-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder: lost executors cost no recomputation, and
    expressions that depend on the run (row numbers by partition) stay as they are."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with freeing(spark):
        out = df.select("*").checkpoint()
    released(spark)
    return out


@contextmanager
def freeing(spark: SparkSession):
    """What is computed inside gives its shuffle files back as soon as it is there; a stage that needs some of them again
    is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_released = 0.0


def released(spark: SparkSession, every: float = 5.0) -> None:
    """Lets go of the broadcasts and checkpoints of what has been computed: Spark removes them from executors and disks
    once the driver has collected the plans that made them, which it otherwise does when its own memory runs short. Not more
    often than ``every`` so many seconds."""
    global _released
    if time.monotonic() - _released < every:
        return
    gc.collect()
    spark._jvm.System.gc()
    _released = time.monotonic()


def small_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, whose session sends Python ``most`` bytes in an Arrow batch from now on, or less if it did before. Spark's
    own limit is 64 MB, which each task holds several times over, in the JVM and in its Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(key, "64m").strip().lower())
    if now is None or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= most:
        conf.set(key, str(most))
    return df


def small_side(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """The rows, marked for a broadcast if a count shows that there are ``rows`` of them at most (some 15 MB of ids and
    digests); more are left to a shuffle. What is counted should be cheap to compute twice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(rows: DataFrame, side: DataFrame, key: str, weight: str, spread: Column, asks: Column | None = None, most: int = 250_000, heavy: int = 1024) -> DataFrame:
    """``rows`` with the other columns of ``side`` (one row per key; cheap to compute twice), null where it has no such key.

    A side of ``most`` rows at most is broadcast after a count. Of a larger one the ``heavy`` keys with the greatest
    weight are broadcast, and their rows are dealt out by ``spread`` (of the key's type) in the shuffle that the others need,
    as are those that don't ask, which the side has nothing for: what meets in a task by key is a key of less than
    1 / ``heavy`` of the weight.
    """
    if side.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(side), key, "left")
    names = [c for c in side.columns if c != key]
    top = side.orderBy(F.desc(weight), key).limit(heavy).select(F.col(key).alias("top_key"), F.struct(*names).alias("top_side"))
    found = rows.join(F.broadcast(top), rows[key] == F.col("top_key"), "left")
    cold_key = F.when(F.col("top_key").isNull() & (F.lit(True) if asks is None else asks), F.col(key)).otherwise(spread)
    found = found.withColumn("cold_key", cold_key)
    cold = side.select(F.col(key).alias("side_key"), F.struct(*names).alias("cold_side"))
    both = found.join(cold, F.col("cold_key") == F.col("side_key"), "left")
    return both.select(*rows.columns, *[F.when(F.col("top_key").isNull(), F.col(f"cold_side.{c}")).otherwise(F.col(f"top_side.{c}")).alias(c) for c in names])


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that for pure ASCII and is much faster than translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def tokenizer_source(path: str) -> str:
    """The tokenizer file's text, read on the driver; a few MB that Spark ships with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(os.environ.get("DENDROSCAN_TOKENIZER", "word_bpe_49k.json"))


_memories: dict = {}
_at_work = ""


def remembers(owner: str, forget) -> None:
    """Names what gives back the memory that an operator keeps in a Python worker from task to task."""
    _memories[owner] = forget


def at_work(owner: str) -> None:
    """Called when a task begins: a worker that served another operator gives that one's memory back."""
    global _at_work
    if _at_work == owner:
        return
    _at_work = owner
    import ctypes

    import pyarrow as pa

    for name, forget in _memories.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_of(batch, step: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch, a few at a time: texts are never all there twice."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def in_batches(rows: Iterable[tuple], schema, weight, limit: int = 4 << 20) -> Iterator:
    """Arrow batches of rows, each closed when its weight passes the limit: memory is bounded by one row more."""
    import pyarrow as pa

    kept, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        kept.append(row)
        held += weight(row) + 64
        if held >= limit:
            yield batch()
            kept, held = [], 0
    if kept:
        yield batch()
