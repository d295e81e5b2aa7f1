"""Entry-shaped views of the test tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PAGE_PATH = "regexp_replace(replace(replace(url, 'https:/', ''), 'http:/', ''), '/+$', '')"
_EVENT_PATH = "concat('/u/', CAST(user_id AS STRING), '/item_', CAST(event_id % 50 AS STRING), '.log')"

VIEWS = {
    "v_part": (
        "part",
        """SELECT p_partkey AS id, concat('/parts/', lower(p_type), '/', replace(p_brand, '#', '_'), '/') AS dir_path,
       CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat(replace(p_name, ' ', '-'), '.pdf')
            WHEN 2 THEN concat(upper(split_part(p_name, ' ', 2)), '.JPG') ELSE concat('my ', p_name, '.tar.gz') END AS name,
       CAST(3 AS INT) AS depth, CAST(p_size AS BIGINT) * 262144 AS size, 1700000000 + p_partkey AS mtime, p_partkey % 4 = 0 AS is_dir
FROM part""",
    ),
    "v_pages": (
        "pages",
        f"""SELECT page_id AS id, regexp_replace(p, '[^/]+$', '') AS dir_path, regexp_extract(p, '([^/]+)$', 1) AS name,
       CAST(length(regexp_replace(p, '[^/]+$', '')) - length(replace(regexp_replace(p, '[^/]+$', ''), '/', '')) - 1 AS INT) AS depth,
       CAST(length(html) AS BIGINT) AS size, page_id AS mtime, false AS is_dir
FROM (SELECT page_id, html, {_PAGE_PATH} AS p FROM pages) t""",
    ),
    "v_docs": (
        "documents",
        """SELECT doc_id AS id, concat('/', source, '/') AS dir_path,
       concat(replace(replace(substring(text, 1, 24), '/', '_'), chr(10), ' '), '.', lang) AS name,
       CAST(1 AS INT) AS depth, n_chars AS size, doc_id AS mtime, false AS is_dir
FROM documents""",
    ),
    "v_orders": (
        "orders",
        """SELECT o_orderkey AS id, concat('/', lower(o_orderstatus), '/', lower(substring(o_orderpriority, 3, 20)), '/') AS dir_path,
       concat('order_', CAST(o_custkey AS STRING), '_', CAST(o_orderkey % 100 AS STRING),
              CASE o_orderkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.PDF' ELSE '' END) AS name,
       CAST(2 AS INT) AS depth, CAST(floor(o_totalprice * 100) AS BIGINT) AS size, o_orderkey AS mtime, o_orderkey % 10 = 5 AS is_dir
FROM orders""",
    ),
    "v_fs_events": (
        "events",
        f"""SELECT event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'rename_to'
                       WHEN 'error' THEN 'rename_from' ELSE 'access' END AS kind,
       {_EVENT_PATH} AS path, CASE WHEN event_type IN ('purchase', 'error') THEN user_id END AS tracker,
       event_id % 997 = 0 AS overflow, CAST(floor(value * 100) AS BIGINT) AS size
FROM events""",
    ),
    "v_changes": (
        "events",
        f"""SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' ELSE 'upsert' END AS op, {_EVENT_PATH} AS path,
       CAST(floor(value * 100) AS BIGINT) AS size, event_id AS mtime, false AS is_dir
FROM events""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over a table of a folder, as a DataFrame; nothing is registered under the table's own name."""
    table, sql = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
