"""Queries over the views, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import search as S
from ..operators import stats, tree
from . import views
from .query import Query, Term, parse
from .views import VIEWS, view

#: name -> (view, query text, limit)
SEARCHES = {
    "term_rank_topk": ("v_part", "ring", 20),
    "term_stem_tier": ("v_part", "gizmo", 40),
    "term_large_view": ("v_orders", "order_1", 500),
    "multi_term_and": ("v_part", "small widget", 50),
    "quoted_phrase": ("v_part", '"my small"', 50),
    "single_letter": ("v_part", "b", 50),
    "single_letter_docs": ("v_docs", "e", 50),
    "ext_filter": ("v_part", "ext:pdf bolt", 50),
    "ext_list": ("v_part", "ext:.PDF,jpg size:>4mb", 50),
    "ext_last_only": ("v_part", "ext:tar.gz", 20),
    "size_greater": ("v_orders", "size:>4mb order", 100),
    "size_default_at_least": ("v_orders", "size:20m", 100),
    "size_equal": ("v_part", "size:=1mb", 100),
    "kind_dir": ("v_part", "dir: gear", 50),
    "kind_file": ("v_part", "file: ring", 50),
    "kind_dir_with_term": ("v_part", "dir:bolt size:<=5mb", 50),
    "regex_name": ("v_part", "re:^my.small", 50),
    "regex_digits": ("v_orders", r"re:^order_\d+_\d*7\.pdf", 100),
    "regex_path": ("v_pages", r"re:/en/\d+", 50),
    "path_term_inside": ("v_pages", "example.com/en", 50),
    "path_term_across": ("v_part", "brand_17/small", 50),
    "path_and_name_terms": ("v_part", "economy/ ring", 50),
    "unicode_term": ("v_docs", "É", 50),
    "unicode_and_ascii": ("v_docs", "ó de", 50),
    "upper_case_prefix_is_text": ("v_part", "EXT:pdf", 20),
    "empty_query": ("v_part", "  ", 20),
    "error_query": ("v_part", "size:abc ring", 20),
    "limit_zero_is_one": ("v_part", "ring", 0),
}
TOTALS = ("ring", "small widget", "ext:pdf", "size:>4mb", "dir: gear", "re:^my", "zzzqqq")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(c: str, t: Term) -> str:
    return f"translate({c}, '{T.UPPER}', '{T.LOWER}')" if t.ascii else f"replace(lower({c}), 'ς', 'σ')"


def _path_sql(t: Term) -> tuple[str, str]:
    head, _, rest = t.text.rpartition("/")
    across = f"(ends_with({_fold('dir_path', t)}, {_quote(head + '/')}) AND starts_with({_fold('name', t)}, {_quote(rest)}))" if rest else "false"
    return f"contains({_fold('dir_path', t)}, {_quote(t.text)})", across


def where_sql(q: Query) -> str:
    tests = ["is_dir" if q.kind == "dir" else "NOT is_dir"] * bool(q.kind)
    if q.size:
        tests.append(f"size {q.size[0]} {q.size[1]}")
    if q.exts:
        tests.append(f"contains(name, '.') AND translate(regexp_extract(name, '[^.]*$'), '{T.UPPER}', '{T.LOWER}') IN ({', '.join(map(_quote, q.exts))})")
    for t in q.terms:
        tests.append("({} OR {})".format(*_path_sql(t)) if t.on_path else f"contains({_fold('name', t)}, {_quote(t.text)})")
    if q.regex:
        tests.append(f"regexp_matches({'concat(dir_path, name)' if q.regex_on_path else 'name'}, {_quote(q.regex.removeprefix('(?iuUd)'))}, 'i')")
    return " AND ".join(f"({t})" for t in tests) or "true"


def score_sql(q: Query) -> str:
    if q.single:
        first = f"left({_fold('name', q.terms[0])}, 1) = {_quote(q.terms[0].text)}"
        return f"CASE WHEN {first} AND strlen(name) = 1 THEN 100 WHEN {first} THEN 80 ELSE 40 END"
    if not q.terms:
        return "40" if q.regex else "0"
    parts = []
    for t in q.terms:
        if t.on_path:
            parts.append("CASE WHEN {} THEN 20 WHEN {} THEN 60 ELSE 0 END".format(*_path_sql(t)))
            continue
        n, x = _fold("name", t), _quote(t.text)
        parts.append(
            f"CASE WHEN {n} = {x} THEN 100 WHEN instr({n}, {x}) = 1 AND contains({n}, '.') AND length({n}) - instr(reverse({n}), '.') = {len(t.text)} THEN 95 "
            f"WHEN instr({n}, {x}) = 1 THEN 80 WHEN instr('_-. /@+,', substring({n}, instr({n}, {x}) - 1, 1)) > 0 THEN 60 ELSE 40 END"
        )
    return f"({' + '.join(f'({p})' for p in parts)}) // {len(parts)}"


def search_sql(name: str, text: str, limit: int) -> str:
    q, source = parse(text), f"({VIEWS[name][1]}) v"
    if q.empty or q.error:
        return f"SELECT id, concat(dir_path, name) AS path, name, size, mtime, is_dir, CAST(0 AS INTEGER) AS score FROM {source} WHERE false"
    return (
        f"SELECT id, concat(dir_path, name) AS path, name, size, mtime, is_dir, CAST({score_sql(q)} AS INTEGER) AS score FROM {source} WHERE {where_sql(q)} "
        f"ORDER BY score DESC, least(depth * 16 + strlen(name), 65535), least(greatest(mtime, 0), 4294967295) DESC, id LIMIT {max(limit, 1)}"
    )


def _search(spark: SparkSession, sf_dir: str, name: str, text: str, limit: int) -> DataFrame:
    return S.search(view(spark, sf_dir, name), text, limit, count=False).hits


def total_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, out = view(spark, sf_dir, "v_part"), None
    for text in TOTALS:
        one = S.matched(entries, text).agg(F.lit(text).alias("query"), F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > 20)
        out = one if out is None else out.unionByName(one)
    return out


TOTAL_SQL = " UNION ALL ".join(f"SELECT {_quote(t)} AS query, count(*) AS total, count(*) > 20 AS truncated FROM ({VIEWS['v_part'][1]}) v WHERE {where_sql(parse(t))}" for t in TOTALS)


def refined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(S.matched(view(spark, sf_dir, "v_part"), "gea").drop("score"), "gear", 50, count=False).hits


def signature_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "v_part").withColumns({"sig": T.signature(F.col("name")), "sig2": T.signature2(F.col("name"))})
    return S.ranked(S.matched(entries, "widget"), 50)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_part").select("id", T.signature(F.col("name")).alias("sig"), T.signature2(F.col("name")).alias("sig2"))


def _signatures_sql() -> str:
    raw = "list_transform(range(1, length(name) + 1), lambda i: ascii(substring(name, i, 1)) | 32)"
    place = "CASE WHEN b BETWEEN 97 AND 122 THEN b - 97 WHEN b BETWEEN 48 AND 57 THEN 26 + (b - 48) % 3 WHEN b = 46 THEN 29 WHEN b IN (45, 47, 32) THEN 30 ELSE 31 END"

    def pairs(factor: int) -> str:
        return f"list_transform(range(1, len(r)), lambda i: ((((r[i] * 256 + r[i + 1]) * CAST({factor} AS HUGEINT)) % 4294967296) // 134217728)::INTEGER)"

    # a bit set is a sum of distinct powers of two
    total = lambda x: f"coalesce(list_sum(list_transform(list_distinct({x}), lambda k: (CAST(2 AS HUGEINT) ** k)::HUGEINT)), 0)"
    sig = f"{total(f'list_transform(r, lambda b: {place})')} + 4294967296 * {total(pairs(0x9E3779B1))}"
    return (
        f"SELECT id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS sig, CAST(s2 AS BIGINT) AS sig2 "
        f"FROM (SELECT id, CAST({sig} AS HUGEINT) AS s, {total(pairs(0x85EBCA6B))} AS s2 FROM (SELECT id, {raw} AS r FROM ({VIEWS['v_part'][1]}) v) a) b"
    )


def dirs_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ancestors(view(spark, sf_dir, "v_pages"))


_DIRS = (
    "(SELECT DISTINCT CASE WHEN n = 0 THEN '/' ELSE concat('/', array_to_string(p[1:n], '/'), '/') END AS path, n AS depth FROM "
    f"(SELECT p, unnest(range(0, len(p) + 1)) AS n FROM (SELECT DISTINCT list_filter(string_split(dir_path, '/'), lambda x: x <> '') AS p FROM ({VIEWS['v_pages'][1]}) v) a) b)"
)
DIRS_SQL = f"SELECT path, CASE WHEN path <> '/' THEN regexp_extract(path, '^(.*/)[^/]+/$', 1) END AS parent, regexp_extract(path, '([^/]+)/$', 1) AS name, CAST(depth AS INTEGER) AS depth FROM {_DIRS} d"


def dir_paths_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = tree.ancestors(view(spark, sf_dir, "v_pages"))
    nodes = dirs.select(F.xxhash64("path").alias("id"), F.xxhash64("parent").alias("p"), "parent", "name").select("id", F.when(F.col("parent").isNotNull(), F.col("p")).alias("parent"), "name")
    paths = tree.paths_from_nodes(spark, nodes).select(F.regexp_replace("path", "^//", "/").alias("path"), "depth")
    return paths


def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree(view(spark, sf_dir, "v_part"), "/parts/small").select("id", "dir_path", "name")


def pruned_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.listing(tree.ancestors(view(spark, sf_dir, "v_pages")), ["en", "fr"]).select("path", "depth")


def under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "v_orders")
    return e.where(T.under_roots(T.path_of(F.col("dir_path"), F.col("name")), ["/f/urgent", "/o"])).select("id", "dir_path")


def _cut(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log parted in two at half of its last number."""
    at = changes.agg((F.max("seq") / 2).cast("bigint").alias("at")).first()["at"] or 0
    return changes.where(F.col("seq") <= at), changes.where(F.col("seq") > at)


_AT = "(SELECT max(event_id) // 2 FROM events)"


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM ({}) c WHERE {}) r WHERE rn = 1)"
_CH = VIEWS["v_changes"][1]


def find_batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    entries = before.groupBy("path").agg(F.min("seq").alias("id")).select("id", T.parent_of(F.col("path")).alias("dir_path"), T.file_name(F.col("path")).alias("name"))
    return C.lookup(after, entries).select("seq", "path", F.coalesce("entry_id", F.lit(-1)).cast("bigint").alias("entry_id"))


def touched_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    entries = before.select(F.col("seq").alias("id"), T.parent_of(F.col("path")).alias("dir_path"))
    return C.touched(entries, after)


def _fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_fs_events").withColumn("paths", F.array("path"))


def coalesce_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coalesce(_fs(spark, sf_dir), "1 day")


def overflow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overflows(_fs(spark, sf_dir), "1 day")


def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rename_pairs(_fs(spark, sf_dir), F.window("ts", "1 day")["start"].alias("window_start"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "v_changes")
    gone = F.lit(-1).cast("bigint")
    return C.difference(C.replay(_cut(log)[0]), C.replay(log)).withColumns({c: F.coalesce(c, gone) for c in ("size", "mtime")})


def apply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    return C.apply(C.replay(before), after)


def _with_dir_removals(log: DataFrame) -> DataFrame:
    """Every hundredth change removes its file's directory instead."""
    gone = F.col("seq") % 100 == 0
    return log.withColumns({"op": F.when(gone, "remove_dir").otherwise(F.col("op")), "path": F.when(gone, F.regexp_replace("path", "/[^/]+$", "")).otherwise(F.col("path")), "is_dir": gone})


def remove_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    return C.apply(C.replay(before), _with_dir_removals(after))


def event_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    return C.outcome(C.replay(before), _with_dir_removals(after))


_STATE = f"(SELECT path, size, mtime, is_dir FROM {_LAST.format(_CH, f'seq <= {_AT}')} s WHERE op = 'upsert')"
_LATE = f"(SELECT seq, CASE WHEN seq % 100 = 0 THEN 'remove_dir' ELSE op END AS op, CASE WHEN seq % 100 = 0 THEN regexp_replace(path, '/[^/]+$', '') ELSE path END AS path, size, mtime, seq % 100 = 0 AS is_dir FROM ({_CH}) c WHERE seq > {_AT})"
_LATE_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM {_LATE} l) r WHERE rn = 1)"
_AFTER = (
    f"(SELECT n.path, n.size, n.mtime, n.is_dir FROM (SELECT path, size, mtime, is_dir, -1 AS seq FROM {_STATE} s WHERE path NOT IN (SELECT path FROM {_LATE} l) "
    f"UNION ALL SELECT path, size, mtime, is_dir, seq FROM {_LATE_LAST} l WHERE op = 'upsert') n WHERE NOT EXISTS "
    f"(SELECT 1 FROM {_LATE} d WHERE d.op = 'remove_dir' AND d.seq > n.seq AND starts_with(n.path, concat(d.path, '/'))))"
)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_stats(view(spark, sf_dir, "v_docs"))


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scan_stats(view(spark, sf_dir, "v_orders"))


def garbage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.garbage_ratio(view(spark, sf_dir, "v_changes"), "op = 'upsert'")


def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timings(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")


def crossing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dir_path")
    return stats.crossing_ratio(view(spark, sf_dir, "v_part"), F.contains(d, F.lit("small/")), F.endswith(d, F.lit("7/")))


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = view(spark, sf_dir, "v_docs"), F.col("name")
    path = T.path_of(F.col("dir_path"), n)
    return e.select("id", T.fold_ascii(n).alias("folded"), T.extension(n).alias("ext"), T.stem_length(n).cast("bigint").alias("stem"), T.place_length(F.col("depth"), n).cast("bigint").alias("plen"), T.parent_of(path).alias("parent"), T.file_name(path).alias("file"), T.flags_of(n, F.col("is_dir"), F.lit(False)).alias("flags"))


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_orders").select("id", T.human_size(F.col("size")).alias("cli"), T.human_size(F.col("size"), ("B", "KB", "MB", "GB", "TB")).alias("gui"))


def human_size_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth size lies halfway between two decimals."""
    return view(spark, sf_dir, "v_part").select("id", T.human_size(F.col("id") * 256).alias("cli"))


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a counting search says beside its hits: matches, and entries searched."""
    entries, rows = view(spark, sf_dir, "v_orders"), []
    for text in COUNTED:
        got = S.search(entries, text, 5)
        got.hits.collect()
        rows.append((text, got.total, got.scanned, got.truncated))
    return spark.createDataFrame(rows, "query string, total long, scanned long, truncated boolean")


COUNTED = ("order_1", "ext:pdf", "size:>20mb order", "zzzqqq")


def _with_links(log: DataFrame) -> DataFrame:
    """The state that a log leaves, every seventh entry a link."""
    return C.replay(log).withColumn("flags", F.when(F.col("mtime") % 7 == 0, T.SYMLINK).otherwise(0))


def apply_events_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _cut(view(spark, sf_dir, "v_changes"))
    return C.apply(_with_links(before), after).withColumn("flags", F.coalesce("flags", F.lit(0)))


def _human_sql(units: tuple[str, ...]) -> str:
    out = f"CASE WHEN size < 1024 THEN concat(size, ' {units[0]}')"
    for power, unit in enumerate(units[1:], 1):
        out += f" WHEN size < {1024 ** (power + 1)} OR {power} = 4 THEN printf('%.1f {unit}', size / {1024.0**power})"
    return out + " END"


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "v_docs")
    mode = (F.col("id") % 512).cast("int")
    return e.select("id", T.mode_string(mode).alias("mode"), T.media_clock(F.col("size") * 100000).alias("clock"), T.ellipsis(F.col("name"), 12).alias("short"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_part").select("id", T.cache_key(T.path_of(F.col("dir_path"), F.col("name")), F.col("mtime"), F.col("size")).alias("key"))


_CACHE_KEY_SQL = (
    "SELECT id, lower(printf('%016x', list_reduce(list_concat([CAST(14695981039346656037 AS UHUGEINT)], list_transform(b, lambda x: CAST(x AS UHUGEINT))), "
    "lambda h, x: (xor(h, x) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))::UBIGINT)) AS key FROM (SELECT id, list_concat("
    "list_transform(range(1, length(p) + 1), lambda i: ascii(substring(p, i, 1))), list_transform(range(0, 8), lambda i: ((mtime >> (8 * i::INTEGER)) & 255)::INTEGER), "
    f"list_transform(range(0, 8), lambda i: ((size >> (8 * i::INTEGER)) & 255)::INTEGER)) AS b FROM (SELECT id, concat(dir_path, name) AS p, mtime, size FROM ({VIEWS['v_part'][1]}) v) a) c"
)


def text_preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.preview import Limits

    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.line_count(t).alias("lines"), T.truncate_utf8(t, Limits().text_bytes).alias("head"))


def magic_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = F.element_at(F.array(*[F.lit(m) for m, _ in T.MAGIC], F.lit(b"\0"), F.lit(b"")), (F.col("page_id") % 12 + 1).cast("int"))
    head = F.concat(begins, F.encode(F.left(F.col("html"), F.lit(12)), "UTF-8"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.kind_from_magic(head).alias("kind"))


def svg_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<svg width="'), i, F.lit('px" height="7">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<svg viewBox='0 0 "), i, F.lit(" 9'>"))).otherwise(F.lit("<svg stroke-width='3'>"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.svg_size(tag).alias("s")).select("page_id", "s.width", "s.height")


def mime_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.preview import FOLDER_ICON, OTHER_ICON, mime_types

    e = view(spark, sf_dir, "v_part").withColumn("ext", T.extension(F.col("name")))
    icon = F.when(F.col("is_dir"), FOLDER_ICON).otherwise(F.coalesce("icon", F.lit(OTHER_ICON))).alias("icon")
    return e.join(F.broadcast(mime_types(spark)), "ext", "left").select("id", "mime", icon)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sinks import json_hits

    return json_hits(_search(spark, sf_dir, "v_part", "ring", 20))


_PLAIN = (total_truncated, refined_search, signature_prefilter, signatures, dirs_from_paths, dir_paths_recursive, subtree, pruned_listing, under_roots, find_batch_lookup, touched_dirs, coalesce_window, overflow_windows, rename_pairs, snapshot_diff, apply_events, remove_subtree, event_outcome, index_stats, scan_stats, garbage_ratio, bench_percentiles, crossing_ratio, name_parts, human_size, human_size_ties, search_totals, apply_events_flags, formats, cache_key, text_preview_lines, magic_kind, svg_size, mime_map, json_lines)


def queries() -> dict:
    out = {k: partial(_search, name=v, text=t, limit=n) for k, (v, t, n) in SEARCHES.items()}
    return out | {f.__name__: f for f in _PLAIN}


def oracle_sql() -> dict[str, str]:
    part, docs, orders, fs = (f"({VIEWS[v][1]}) v" for v in ("v_part", "v_docs", "v_orders", "v_fs_events"))
    day = "time_bucket(INTERVAL 1 DAY, ts)"
    touch = "CASE WHEN kind IN ('create', 'rename_to') THEN 2 WHEN kind IN ('remove', 'rename_from', 'modify') THEN 1 END"
    kinds = "[" + ", ".join(f"'{k}'" for _, k in T.MAGIC) + ", 'binary', 'text']"
    out = {k: search_sql(*x) for k, x in SEARCHES.items()}
    return out | {
        "total_truncated": TOTAL_SQL,
        "refined_search": search_sql("v_part", "gear", 50),
        "signature_prefilter": search_sql("v_part", "widget", 50),
        "signatures": _signatures_sql(),
        "dirs_from_paths": DIRS_SQL,
        "dir_paths_recursive": f"SELECT path, CAST(depth AS INTEGER) AS depth FROM {_DIRS} d",
        "subtree": f"SELECT id, dir_path, name FROM {part} WHERE starts_with(dir_path, '/parts/small/')",
        "pruned_listing": f"SELECT path, CAST(depth AS INTEGER) AS depth FROM {_DIRS} d WHERE NOT list_has_any(string_split(path, '/'), ['en', 'fr'])",
        "under_roots": f"SELECT id, dir_path FROM {orders} WHERE starts_with(dir_path, '/f/urgent/') OR starts_with(dir_path, '/o/')",
        "find_batch_lookup": f"SELECT c.seq, c.path, coalesce(e.id, -1) AS entry_id FROM ({_CH}) c LEFT JOIN (SELECT path, min(seq) AS id FROM ({_CH}) b WHERE seq <= {_AT} GROUP BY path) e USING (path) WHERE c.seq > {_AT}",
        "touched_dirs": f"SELECT seq AS id, regexp_extract(path, '^(.*/)', 1) AS dir_path FROM ({_CH}) c WHERE seq <= {_AT} AND regexp_extract(path, '^(.*/)', 1) IN (SELECT regexp_extract(path, '^(.*/)', 1) FROM ({_CH}) d WHERE seq > {_AT})",
        "coalesce_window": f"SELECT {day} AS window_start, path, max({touch}) AS touch FROM {fs} WHERE NOT overflow AND {touch} IS NOT NULL GROUP BY 1, 2",
        "overflow_windows": f"SELECT {day} AS window_start, bool_or(overflow) AS overflow FROM {fs} GROUP BY 1",
        "rename_pairs": f"SELECT w AS window_start, count(*) FILTER (a AND b) AS pairs, count(*) FILTER (NOT (a AND b)) AS halves FROM (SELECT {day} AS w, tracker, bool_or(kind = 'rename_from') AS a, bool_or(kind = 'rename_to') AS b FROM {fs} WHERE tracker IS NOT NULL AND NOT overflow GROUP BY 1, 2) s GROUP BY 1",
        "snapshot_diff": f"SELECT CASE WHEN b.path IS NULL THEN 'remove' ELSE 'upsert' END AS op, coalesce(a.path, b.path) AS path, coalesce(b.size, -1) AS size, coalesce(b.mtime, -1) AS mtime, coalesce(b.is_dir, a.is_dir) AS is_dir FROM {_STATE} a FULL JOIN (SELECT path, size, mtime, is_dir FROM {_LAST.format(_CH, 'true')} s WHERE op = 'upsert') b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR a.size IS DISTINCT FROM b.size OR a.mtime IS DISTINCT FROM b.mtime",
        "apply_events": f"SELECT path, size, mtime, is_dir FROM {_LAST.format(_CH, 'true')} s WHERE op = 'upsert'",
        "remove_subtree": f"SELECT * FROM {_AFTER} a",
        "event_outcome": f"SELECT count(*) FILTER (a.path IS NULL) AS added, count(*) FILTER (a.path IS NOT NULL AND b.path IS NOT NULL AND b.path IN (SELECT path FROM {_LATE_LAST} l WHERE op = 'upsert')) AS updated, count(*) FILTER (b.path IS NULL) AS removed FROM {_STATE} a FULL JOIN {_AFTER} b ON a.path = b.path",
        "index_stats": f"SELECT count(*) AS entries, count(DISTINCT dir_path) AS directories, CAST(sum(strlen(name)) AS BIGINT) AS name_bytes, CAST(sum(size) AS BIGINT) AS total_size FROM {docs}",
        "scan_stats": f"SELECT count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files, count(*) AS total FROM {orders}",
        "garbage_ratio": f"SELECT count(*) FILTER (op <> 'upsert') / count(*) AS garbage FROM ({_CH}) c",
        "bench_percentiles": "SELECT event_type, a[1] AS min, a[1 + CAST(floor((len(a) - 1) * 0.5) AS BIGINT)] AS p50, a[1 + CAST(floor((len(a) - 1) * 0.95) AS BIGINT)] AS p95, a[len(a)] AS max FROM (SELECT event_type, list_sort(list(value)) AS a FROM events GROUP BY 1) e",
        "crossing_ratio": f"SELECT avg(CASE WHEN ends_with(dir_path, '7/') AND NOT contains(dir_path, 'small/') THEN 1.0::DOUBLE ELSE 0 END) AS crossing FROM (SELECT DISTINCT dir_path FROM {part}) d",
        "name_parts": f"SELECT id, translate(name, '{T.UPPER}', '{T.LOWER}') AS folded, CASE WHEN contains(name, '.') THEN translate(regexp_extract(name, '[^.]*$'), '{T.UPPER}', '{T.LOWER}') END AS ext, CASE WHEN contains(name, '.') THEN length(name) - instr(reverse(name), '.') END AS stem, CAST(least(depth * 16 + strlen(name), 65535) AS BIGINT) AS plen, dir_path AS parent, name AS file, CAST(CASE WHEN starts_with(name, '.') THEN 8 ELSE 0 END AS INTEGER) AS flags FROM {docs}",
        "human_size": f"SELECT id, {_human_sql(('B', 'K', 'M', 'G', 'T'))} AS cli, {_human_sql(('B', 'KB', 'MB', 'GB', 'TB'))} AS gui FROM {orders}",
        "human_size_ties": f"SELECT id, {_human_sql(('B', 'K', 'M', 'G', 'T'))} AS cli FROM (SELECT id, id * 256 AS size FROM {part}) p",
        "search_totals": " UNION ALL ".join(f"SELECT {_quote(t)} AS query, count(*) FILTER ({where_sql(parse(t))}) AS total, count(*) AS scanned, count(*) FILTER ({where_sql(parse(t))}) > 5 AS truncated FROM {orders}" for t in COUNTED),
        "apply_events_flags": f"SELECT s.path, s.size, s.mtime, s.is_dir, CAST(CASE WHEN b.mtime % 7 = 0 THEN {T.SYMLINK} ELSE 0 END AS INTEGER) AS flags FROM {_LAST.format(_CH, 'true')} s LEFT JOIN {_STATE} b USING (path) WHERE s.op = 'upsert'",
        "formats": f"SELECT id, concat({', '.join(f'CASE WHEN (id % 512) & {1 << 8 - i} <> 0 THEN {_quote(chr(120) if i % 3 == 2 else chr(119) if i % 3 else chr(114))} ELSE {_quote(chr(45))} END' for i in range(9))}) AS mode, printf('%d:%02d', (size * 100000 // 1000000) // 60, (size * 100000 // 1000000) % 60) AS clock, CASE WHEN length(name) > 12 THEN concat(left(name, 11), '…') ELSE name END AS short FROM {docs}",
        "cache_key": _CACHE_KEY_SQL,
        "text_preview_lines": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS INTEGER) AS lines, CASE WHEN strlen(text) <= 65536 THEN text ELSE decode(unhex(left(hex(encode(text)), 2 * (65536 - list_min(list_filter([0, 1, 2, 3], lambda k: substring(hex(encode(text)), 2 * (65536 - k) + 1, 1) NOT IN ('8', '9', 'A', 'B'))))))) END AS head FROM documents",
        "magic_kind": f"SELECT page_id, {kinds}[page_id % 12 + 1] AS kind FROM pages",
        "svg_size": "SELECT page_id, CAST(CASE WHEN page_id % 3 < 2 THEN page_id ELSE 0 END AS INTEGER) AS width, CAST(CASE page_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 9 ELSE 0 END AS INTEGER) AS height FROM pages",
        "mime_map": f"SELECT id, CASE WHEN is_dir THEN NULL WHEN ends_with(name, '.pdf') THEN 'application/pdf' WHEN ends_with(name, '.JPG') THEN 'image/jpeg' ELSE 'application/gzip' END AS mime, CASE WHEN is_dir THEN 'folder-symbolic' WHEN ends_with(name, '.pdf') THEN 'application-pdf-symbolic' WHEN ends_with(name, '.JPG') THEN 'image-x-generic-symbolic' ELSE 'package-x-generic-symbolic' END AS icon FROM {part}",
        "json_lines": f"SELECT CAST(json_object('path', path, 'size', size, 'modified', mtime, 'directory', is_dir) AS VARCHAR) AS line FROM ({search_sql('v_part', 'ring', 20)}) h",
    }


__all__ = ["oracle_sql", "queries", "views"]
