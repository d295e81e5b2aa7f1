"""Commands: index, add, watch, search, stats, preview, bench, clear."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.sinks import json_hits, text_hits

#: The standard queries of a bench.
BENCH = ("a", "png", "config", "index.rs", "cargo.toml", "report", "ext:pdf", "ext:jpg,png size:>1mb", "src/main", '"my file"', r"re:^IMG_\d+", "dir: node_modules", "zzzqqq")


def order_statistics(times: list[float]) -> dict:
    t = sorted(times)
    return {"min": t[0], "p50": t[int((len(t) - 1) * 0.5)], "p95": t[int((len(t) - 1) * 0.95)], "max": t[-1]}


def bench(engine: Engine, queries: list[str], runs: int, limit: int, typing: bool = False) -> list[dict]:
    entries, out = engine.entries().persist(), []
    entries.count()
    from .operators.search import Typeahead, search

    for q in queries:
        if typing:
            ahead = Typeahead()
            for n in range(1, len(q) + 1):
                start = time.perf_counter()
                hits = len(ahead.search(entries, q[:n], limit).hits.collect())
                out.append({"query": q[:n], "ms": (time.perf_counter() - start) * 1000, "hits": hits})
            continue
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            hits = len(search(entries, q, limit).hits.collect())
            times.append((time.perf_counter() - start) * 1000)
        out.append({"query": q, "hits": hits, **order_statistics(times)})
    entries.unpersist()
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, engine: Engine | None = None) -> int:
    parser = argparse.ArgumentParser("dendroscan")
    parser.add_argument("-j", "--json", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        p = sub.add_parser(name)
        p.add_argument("--root", action="append")
        if name == "watch":
            p.add_argument("--log", required=True, help="folder of change records")
            p.add_argument("--checkpoint", required=True)
    sub.add_parser("add").add_argument("path")
    p = sub.add_parser("search")
    p.add_argument("query", nargs="+")
    p.add_argument("-n", "--limit", type=int, default=20)
    p.add_argument("--preview", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("preview").add_argument("path")
    p = sub.add_parser("bench")
    p.add_argument("query", nargs="*")
    p.add_argument("-r", "--runs", type=int, default=20)
    p.add_argument("-n", "--limit", type=int, default=500)
    p.add_argument("--typing", action="store_true")
    sub.add_parser("clear")
    a = parser.parse_args(argv)
    engine = engine or Engine(spark or SparkSession.builder.appName("dendroscan").getOrCreate())
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False))
    if a.command == "index":
        show({"generation": engine.reindex(a.root)})
    elif a.command == "add":
        show({"generation": engine.add_root(a.path)})
    elif a.command == "watch":
        from .sources.filesystem import change_log

        if engine.is_empty():
            engine.reindex(a.root)
        engine.watcher().start(change_log(engine.spark, a.log), a.checkpoint).awaitTermination()
    elif a.command == "search":
        got = engine.search_uncached(" ".join(a.query), a.limit)
        if got.error:
            print(got.error, file=sys.stderr)
            return 2
        hits = got.hits.persist()
        for row in (json_hits if a.json else text_hits)(hits).collect():
            print(row.line)
        if not got.query.empty:
            print(f"{got.total} matches{' (cut)' if got.truncated else ''} of {got.scanned}", file=sys.stderr)
        if a.preview and (first := hits.first()):
            show(engine.preview(first.path))
    elif a.command == "stats":
        show(engine.stats())
    elif a.command == "preview":
        show(engine.preview(a.path))
    elif a.command == "bench":
        for line in bench(engine, a.query or list(BENCH), a.runs, a.limit, a.typing):
            show(line)
    else:
        engine.clear()
    return 0


if __name__ == "__main__":
    sys.exit(main())
