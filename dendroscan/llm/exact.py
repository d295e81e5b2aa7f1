"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Each text is folded and hashed once; the rows with their digests are written to the shared folder.
2. A Misra-Gries summary (Spark's freqItems) proposes every digest that more than ``support`` of the rows have,
   at most ``1 / support`` of them. Exact counts verify them and name each one's winner. The winners are written too:
   merging summaries depends on the order of tasks, so a second evaluation might name others.
3. These winners, at most ``1 / support`` rows, are broadcast and settle all copies of frequent digests on the map
   side. The rest are grouped by an ordinary shuffle: summed on the map side first, then joined with their sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold_ascii, met

BEST = "max(struct(id, nth))"


def _digest(text_col: str):
    return F.unhex(F.sha2(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 1024, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the ``carry`` columns; None: all), ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, ``frequent`` (settled by the broadcast winners).

    Texts are equal if identical after lower-casing A-Z. Of equal texts the row with the largest id stays.
    Null and empty texts are equal. Null ids are smaller than all others. Of rows that share text and largest id
    exactly one stays. An empty table gives an empty result; other columns, whatever their names, live in ``row``.
    """
    carry = df.columns if carry is None else carry
    rows = durable(df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(id_col).alias("id"),
        _digest(text_col).alias("digest"),
        F.monotonically_increasing_id().alias("nth"),
    ))
    summary = rows.stat.freqItems(["digest"], support)
    frequent = summary.select(F.explode(F.col(summary.columns[0])).alias("digest"))
    sums = [F.expr(BEST).alias("best"), F.count(F.lit(1)).alias("group_size")]
    winners = durable(rows.select("id", "nth", "digest").join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*sums))
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # a row for each text; of those alone, all there is to know
    groups = rest.groupBy("digest").agg(*sums)
    rest = rest.join(groups, "digest")

    def out(found: DataFrame, is_frequent: bool) -> DataFrame:
        return found.select(
            "row",
            F.col("best.id").alias("keep_id"),
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("nth") == F.col("best.nth")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.lit(is_frequent).alias("frequent"),
        )

    return out(settled, True).unionByName(out(rest, False))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 1024) -> DataFrame:
    """The rows that exact_dedup keeps, with the columns of ``df``; nulls, ties and empty tables as there.

    Decisions are made on ids and digests alone; then each text's digest is looked up among those of groups with
    copies: frequent ones in a broadcast of ``1 / support`` rows at most, which removes them on the map side; the others in
    a broadcast too if a count shows that they are few, else by a shuffle. Beside that, texts move only to leave one of
    rows alike in id and text.
    """
    found = exact_dedup(df, id_col, text_col, support, carry=[id_col])
    groups = durable(found.where("kept and group_size > 1").select(F.unhex("text_sha256").alias("digest"), "keep_id", "group_size", "frequent"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
    hot = groups.where("frequent").select("digest", F.struct("keep_id").alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left").where("hot is null or id <=> hot.keep_id")
    cold = groups.where("not frequent").select("digest", F.struct("keep_id").alias("cold"), "group_size")
    rows = met(rows, cold, "digest", "group_size", F.unhex(F.sha2(F.concat_ws("/", F.hex("digest"), F.col("id").cast("string")), 256))).where("cold is null or id <=> cold.keep_id")
    alone = rows.where("hot is null and cold is null").select("row")
    best = rows.where("hot is not null or cold is not null").dropDuplicates(["digest"]).select("row")
    return alone.unionByName(best).select("row.*")
