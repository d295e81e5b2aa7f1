"""Packing along a space-filling curve.

Each document's tokens are hashed into a signed count vector, the unit vector is projected to a few dimensions, and
the point's Hilbert index orders the documents: neighbours on the curve have similar vectors. The curve is dealt to
partitions by quantiles of (index, hash of the document), so that any number of equal documents spreads evenly.
Sequences are cut from the gapless stream of all tokens along the curve, so only the last one needs padding.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, durable, in_batches, rows_of, small_batches, tokenizer_source
from .tokens import library

DIMS, BITS, BUCKETS, TIE_BITS = 3, 10, 256, 16


def hilbert_index(points, bits: int = BITS):
    """Hilbert index of integer points (n, dims), each coordinate below 2**bits. Skilling's transposition."""
    import numpy as np

    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cells_of(ids):
    """Twice the bucket of each id, and one more where its sign is positive."""
    import numpy as np

    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS * 2 + (mixed >> np.uint64(63)).astype(np.int64)


@lru_cache(maxsize=1)
def _cells():
    import numpy as np

    return _cells_of(np.arange(1 << 16))


def project(docs, seed: int = 7):
    """Points on the grid for lists of token ids: hashed signed counts, unit length, fixed Gaussian projection. Such
    coordinates are normal; the logistic curve, near to their distribution function, spreads them over the grid evenly."""
    import numpy as np

    matrix = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ids = np.concatenate(docs) if len(docs) else np.zeros(0, np.uint32)
    cell = _cells()[ids] if not len(ids) or ids.max() < 1 << 16 else _cells_of(ids)
    counts = np.bincount(cell + np.repeat(np.arange(len(docs)) * (2 * BUCKETS), sizes), minlength=len(docs) * 2 * BUCKETS).reshape(len(docs), BUCKETS, 2)
    vectors = (counts[:, :, 1] - counts[:, :, 0]).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) @ matrix
    return np.minimum((1 << BITS) / (1 + np.exp(-1.702 * flat)), (1 << BITS) - 1).astype(np.int64)


def _encoded(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, level: int = 3) -> DataFrame:
    """(id, blob: compressed ids, n: their number, key: place on the curve)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    source = tokenizer_source(tokenizer)
    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("blob", pa.binary()), ("n", pa.int64()), ("key", pa.int64())])

    def run(batches):
        import numpy as np
        import xxhash
        import zstandard

        at_work("tokens")
        ids, squeeze, end = library(source), zstandard.ZstdCompressor(level=level), np.array([end_id], "<u4")

        def rows():
            unnamed = 0
            for batch in batches:
                names, found = batch.column(0).to_pylist(), ids.texts(batch.column(1))
                for at in range(0, len(names), 512):
                    some = names[at : at + 512]
                    docs = [np.concatenate((x, end)) for x in islice(found, len(some))]
                    curve = hilbert_index(project(docs))
                    for name, doc, index in zip(some, docs, curve.tolist(), strict=True):
                        unnamed += name is None  # documents without an id mustn't all have one place
                        tie = xxhash.xxh3_64_intdigest(repr(name) if name is not None else f"null {unnamed}") >> (64 - TIE_BITS)
                        blob = squeeze.compress(doc.astype("<u2").tobytes() if doc.max() < 1 << 16 else doc.tobytes())
                        yield name, blob, len(doc), index << TIE_BITS | tie

        yield from in_batches(rows(), schema, lambda r: len(r[1]))

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, blob binary, n long, key long")


def pack(df: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, level: int = 3) -> DataFrame:
    """One row per piece: ``id``, ``start`` (tokens of its document before it), ``length``, ``ids`` (binary,
    little-endian uint32), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in its sequence).

    A null text is an empty one: such a document is its end id alone. Null and repeated ids are documents like any
    other; rows alike in id and text are interchangeable. A document of any length is cut as it comes. An empty
    table gives no pieces; other columns are ignored. Every sequence but the last holds ``length`` tokens. Ids are kept and
    shuffled at Zstandard's ``level``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = durable(_encoded(small_batches(df), tokenizer, end_id, id_col, text_col, level))
    shares = [i / partitions for i in range(1, partitions)]
    # as many numbers as partitions
    bounds = (docs.agg(F.percentile_approx("key", shares, 10_000).alias("b")).first().b or []) if shares else []

    @F.pandas_udf("int")
    def part(key):
        import numpy as np
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), key.to_numpy(), side="right").astype("int32"))

    totals = {r.part: r.n for r in docs.groupBy(part("key").alias("part")).agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for p in sorted(totals):
        base[p] = at
        at += totals[p]
    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        import numpy as np
        import zstandard

        restore = zstandard.ZstdDecompressor()

        def rows():
            now, at = None, 0
            for batch in batches:
                for p, name, blob, n in rows_of(batch):
                    if p != now:
                        now, at = p, base[p]
                    raw = restore.decompress(blob)
                    ids = (np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4")).tobytes()
                    start = 0
                    while start < n:
                        room = min(length - at % length, n - start)
                        yield name, start, room, ids[4 * start : 4 * (start + room)], n, at // length, at % length
                        start += room
                        at += room

        yield from in_batches(rows(), schema, lambda r: len(r[3]))

    along = docs.withColumn("part", part("key")).repartitionById(partitions, "part").sortWithinPartitions("part", "key", "id", "blob")
    return along.select("part", "id", "blob", "n").mapInArrow(run, f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
