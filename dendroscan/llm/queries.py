"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, exact, jaccard, packing, passages, pii, quality, tokens, warc
from .common import UPPER, default_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = credentials.scan(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("id").alias("doc_id"), *[count(k) for k in credentials.BASE],
        F.sha2(credentials.joined(F.filter("found", lambda s: s["kind"].isin(*credentials.BASE))), 256).alias("base_sha256"),
        credentials.joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["partner_kind"].isNotNull())).cast("long").alias("n_linked"),
    )


def op3_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("id").alias("doc_id"), *[count(k.name) for k in pii.KINDS],
        F.sha2(credentials.joined(F.filter("found", lambda s: s["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        credentials.joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"),
    )


def _op3_sql() -> str:
    """Matches and the pieces between them, offsets by summing lengths, then the confirmations."""
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring(reverse({digits}), i, 1) AS INTEGER) "
        f"ELSE 2 * CAST(substring(reverse({digits}), i, 1) AS INTEGER) - CASE WHEN CAST(substring(reverse({digits}), i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    )
    flat = "replace(v, ' ', '')"
    turned = f"concat(substring({flat}, 5), substring({flat}, 1, 4))"
    value = f"CASE WHEN ascii(substring({turned}, i, 1)) >= 65 THEN ascii(substring({turned}, i, 1)) - 55 ELSE ascii(substring({turned}, i, 1)) - 48 END"
    mod97 = f"list_reduce(list_concat([0], list_transform(range(1, length({turned}) + 1), lambda i: {value})), lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1"
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "mail|contact|write|kontakt|correo|courriel", 5),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"regexp_full_match(v, '{byte}(?:\\.{byte}){{3}}')", "(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server|adresse|direcc", 5),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "card|visa|credit|karte|carte|tarjeta", 8),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15", "phone|call|mobile|fax|tel", 5),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", mod97, "iban|account|bank|konto|compte|cuenta", 8),
    )
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS nth, '{kind}' AS kind, v, s, CASE WHEN regexp_matches(translate(around, '{UPPER}', '{UPPER.lower()}'), '{context}') THEN '{(score + 2) / 10}' ELSE '{score / 10}' END AS score "
        f"FROM (SELECT doc_id, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda k: concat(right(g[k], 40), ' ', left(g[k + 1], 40)))) AS around, unnest(list_transform(range(1, len(m) + 1), "
        f"lambda k: coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))) AS s "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents) a) b WHERE {test}"
        for n, (kind, pattern, test, context, score) in enumerate(kinds)
    )
    listed = "string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + length(v) AS BIGINT)), ',' ORDER BY nth, s)"
    scores = "string_agg(score, ',' ORDER BY nth, s)"
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in kinds)
    return (
        f"WITH found AS ({parts}), per AS (SELECT doc_id, {', '.join(f'count(*) FILTER (kind = {chr(39)}{k}{chr(39)}) AS n_{k}' for k, *_ in kinds)}, "
        f"{listed} AS spans, {scores} AS scores, {listed} FILTER (nth < 4) AS base FROM found GROUP BY doc_id) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN per USING (doc_id)"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
      FROM documents) d
WINDOW w AS (PARTITION BY folded)
"""


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similarity_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.withColumnRenamed("id", "doc_id")


def op7_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keep
      FROM pages) p
"""


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.encode_decode(_table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(_table(spark, sf_dir, "documents"), default_tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_pii_checksums": _op3_sql(), "op4_exact_dedup": OP4_SQL, "op8_seekable_warc": OP8_SQL}
