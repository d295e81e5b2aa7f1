"""From raw documents to packed training sequences.

Each stage works on all that the one before it kept. Stages: quality rules (documents that they reject go), exact
dedup, n-gram Jaccard join (of each group of near copies the document with the smallest id stays), secret scans
(spans are masked in the text), packing (one row per piece of a sequence).

All but the last return the columns of their input, whatever others it has beside those of documents. A null in any
column, empty and very long texts, repeated rows and empty tables have the results that the stages' docstrings name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dendroscan.llm import credentials, exact, jaccard, packing, quality
from dendroscan.llm.common import default_tokenizer, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and don't diverge from their language. Null and empty texts have no words
    and go; a null language leaves the base rules alone; repeated rows are judged alike; no rows give none."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null as empty) the row with the largest id, one of those alike in both. A null id
    is the smallest; no rows give none."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id. Texts without words link with
    nothing; rows with a null id stay, as do all that share an id with the one that stays; no rows give none."""
    return jaccard.keep_first(docs, k=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every span that the scan finds masked and n_chars set anew. Null texts stay null, texts without
    spans as they are; no rows give none."""
    return credentials.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. A null or empty text is its end token alone; repeated rows are documents of
    their own; a text of any length is cut as it comes; no rows give no pieces."""
    return packing.pack(docs, default_tokenizer(), level=6).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("secret scans", mask_secrets), ("packing", pack)]

#: Tokenising and the divergence of histograms aren't SQL; the tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's result written as Parquet to the shared folder and read again. What a
    stage has read is removed when the next one has written its own; the last result stays for the caller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
