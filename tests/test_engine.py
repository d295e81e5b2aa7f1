import json
import os
import struct
import time

import pytest
from pyspark.sql import functions as F

from dendroscan import Config, Engine, Snapshot
from dendroscan.cli import main, order_statistics
from dendroscan.functions import text as T
from dendroscan.operators import preview as P
from dendroscan.sources import filesystem
from dendroscan.streaming.watch import Watcher


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "north/pier").mkdir(parents=True)
    (root / "north/bilge").mkdir()
    (root / "north/pier/rope.txt").write_text("hi")
    (root / "north/bilge/sump.dat").write_bytes(b"\0" * 10)
    (root / ".lamp").write_text("x")
    (root / "link").symlink_to(root / "north")
    (root / os.fsdecode(b"w\xffx")).write_text("odd")
    return root


def test_scan(spark, tree):
    rows = {r.path.removeprefix(f"{tree}/"): r for r in filesystem.scan(spark, [str(tree), str(tree / "north")], ["bilge"]).collect()}
    assert set(rows) == {"north", "north/pier", "north/pier/rope.txt", ".lamp", "link", "w�x"}
    assert rows["north/pier/rope.txt"].size == 2 and rows["north"].is_dir and not rows["link"].is_dir
    assert rows["link"].flags == T.SYMLINK and rows[".lamp"].flags == T.HIDDEN and bytes(rows["w�x"].name_bytes) == b"w\xffx"


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, Config(roots=[str(tree)], snapshot_dir=str(tmp_path / "snap")))
    assert engine.is_empty() and engine.search_uncached("rope").hits.count() == 0
    assert engine.reindex() == 1 and engine.generation == 1
    assert [r.name for r in engine.search("rope").hits.collect()] == ["rope.txt"]
    again = Engine(spark, Config(roots=[str(tree)], snapshot_dir=str(tmp_path / "snap")))
    assert again.search("sump").hits.count() == 1 and again.stats()["entries"] == 8 and again.stats()["bytes_on_disk"] > 0
    changes = spark.createDataFrame([(1, "upsert", f"{tree}/new.md", 9, 9, False), (2, "remove_dir", f"{tree}/north", None, None, None)], "seq long, op string, path string, size long, mtime long, is_dir boolean")
    assert engine.apply_events(changes) == {"added": 1, "updated": 0, "removed": 5}
    assert engine.search("new").hits.count() == 1 and engine.search("rope").hits.count() == 0
    other = tmp_path / "other"
    other.mkdir()
    (other / "more.txt").write_text("1")
    engine.add_root(str(other))
    assert engine.add_root(str(other)) == engine.generation and engine.search("more").hits.count() == 1
    with pytest.raises(NotADirectoryError):
        engine.add_root(str(other / "more.txt"))
    engine.clear()
    assert engine.is_empty()


def test_snapshot_versions(spark, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "s"))
    e = spark.createDataFrame([(1, "/a/", "x.TXT", 1, 5, 6, False)], "id long, dir_path string, name string, depth int, size long, mtime long, is_dir boolean")
    for _ in range(4):
        snap.write(e)
    assert snap.version == 4 and sorted(p for p in os.listdir(tmp_path / "s") if p.startswith("v=")) == ["v=3", "v=4"]
    assert snap.read().first().ext == "txt"
    snap.write(snap.read())  # reads one version while it writes the next
    assert snap.read().count() == 1
    snap.set_meta(schema_version=99)
    assert snap.version == 0 and snap.read().count() == 0


def test_watch(spark, tree, tmp_path):
    snap = Snapshot(spark, str(tmp_path / "snap"))
    (tree / "cache").mkdir()
    watcher = Watcher(spark, snap, [str(tree)], ["bilge"], scan_excludes=["cache"])
    watcher.reindex()
    logs = tmp_path / "log"
    logs.mkdir()

    def events(*rows):
        lines = [json.dumps({"ts": "2024-01-01T00:00:00", "kind": k, "paths": [str(p)], "overflow": o}) for k, p, o in rows]
        (logs / f"{time.time_ns()}.json").write_text("\n".join(lines))
        watcher.start(filesystem.change_log(spark, str(logs)), str(tmp_path / "checkpoint"), None).awaitTermination()
        return {r.name for r in snap.read().collect()}

    (tree / "north/pier/rope.txt").unlink()
    (tree / "moved").mkdir()
    (tree / "moved/inside.txt").write_text("1")
    (tree / "north/bilge/more.bin").write_text("1")
    got = events(("remove", tree / "north/pier/rope.txt", False), ("create", tree / "moved", False), ("create", tree / "north/bilge/more.bin", False), ("modify", "/elsewhere/x", False))
    known = {"north", "pier", ".lamp", "link", "w�x", "bilge", "sump.dat"}  # what isn't followed is in the index all the same
    assert got == known | {"moved", "inside.txt"}
    assert {r.name for r in snap.read().where(f"flags = {T.SYMLINK}").collect()} == {"link"}
    before = snap.version
    assert events(("modify", tree / ".lamp", False)) == got and snap.version == before  # nothing has changed
    (tree / "unseen").write_text("1")
    assert events(("any", tree, True)) == known | {"moved", "inside.txt", "unseen", "more.bin"} and watcher.status.reindexed == 1
    (tree / "moved/inside.txt").unlink()
    (tree / "moved").rmdir()
    assert not {"moved", "inside.txt"} & events(("remove", tree / "moved", False))


def test_subtrees_beyond_the_budget(spark, tmp_path):
    root = tmp_path / "r"
    for d in ("a/x", "b/y", "c"):
        (root / d).mkdir(parents=True)
    snap = Snapshot(spark, str(tmp_path / "snap"))
    watcher = Watcher(spark, snap, [str(root)], budget=3, rescan_s=3600)
    watcher.reindex()
    watcher.register()
    assert watcher.status.unwatched == [f"{root}/b", f"{root}/c"]  # the root, a and a/x are watched
    (root / "b/y/new.txt").write_text("1")
    (root / "a/x/unseen.txt").write_text("1")
    (root / "c").rmdir()
    watcher.rescan()
    assert watcher.status.rescans == 0  # it isn't time yet
    watcher.rescan(now=True)
    assert watcher.status.rescans == 1 and {r.name for r in snap.read().collect()} == {"a", "x", "b", "y", "new.txt"}
    assert tree_of(200, 5) == frontier_of(200, 5)
    watcher.budget = 100
    watcher.register()
    assert watcher.status.unwatched == []

    def batches():
        watcher.rescan_s, watcher.status.unwatched = 0.1, [f"{root}/a"]
        logs = tmp_path / "log"
        logs.mkdir()
        watcher.budget = 3
        watcher.start(filesystem.change_log(spark, str(logs)), str(tmp_path / "checkpoint"))
        try:
            (root / "b/late.txt").write_text("1")
            for _ in range(100):
                time.sleep(0.3)
                if snap.read().where("name = 'late.txt'").count():
                    return True
        finally:
            watcher.stop()

    assert batches()  # without any event


def tree_of(n, budget):
    from dendroscan.operators.tree import frontier

    paths = sorted(f"/{i % 7}/" if i < 7 else f"/{i % 7}/{i}/" for i in range(n))
    return frontier([(p, p.count("/")) for p in paths], budget)[1]


def frontier_of(n, budget):
    from pyspark.sql import SparkSession

    from dendroscan.operators.tree import unwatched

    rows = [(f"/{i % 7}/" if i < 7 else f"/{i % 7}/{i}/", None if i < 7 else f"/{i % 7}/") for i in range(n)]
    return unwatched(SparkSession.getActiveSession().createDataFrame(rows, "path string, parent string"), budget)


def test_names_that_look_alike(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for raw in (b"\xff", b"\xfe", b"plain"):
        (root / os.fsdecode(raw)).write_text("1")
    (root / "to").symlink_to(root / "plain")
    engine = Engine(spark, Config(roots=[str(root)], snapshot_dir=str(tmp_path / "snap")))
    engine.reindex()
    engine.apply_events(spark.createDataFrame([(1, "upsert", f"{root}/added", 9, 9, False), (2, "upsert", f"{root}/to", 5, 5, False)], "seq long, op string, path string, size long, mtime long, is_dir boolean"))
    (tmp_path / "other").mkdir()
    engine.add_root(str(tmp_path / "other"))
    got = engine.entries().collect()
    assert len(got) == 5 == len({r.id for r in got}) and {bytes(r.name_bytes) for r in got if r.name_bytes} == {b"\xff", b"\xfe"}
    assert [(r.name, r.flags, r.size) for r in got if r.flags] == [("to", T.SYMLINK, 5)]


def test_readers_always_see_a_version(spark, tmp_path):
    import threading

    snap, seen, ended = Snapshot(spark, str(tmp_path / "s")), [], threading.Event()
    snap.write(spark.createDataFrame([(1, "/a/", "x", 1, 5, 6, False)], "id long, dir_path string, name string, depth int, size long, mtime long, is_dir boolean"))
    reader = threading.Thread(target=lambda: [seen.append(Snapshot(spark, str(tmp_path / "s")).version) for _ in iter(ended.is_set, True)])
    reader.start()
    for i in range(30):
        snap.set_meta(version=1, turn=i)
    ended.set()
    reader.join()
    assert seen and set(seen) == {1}


def test_previews(spark, tmp_path):
    def at(name, data):
        (tmp_path / name).write_bytes(data)
        return P.preview(str(tmp_path / name))

    assert at("a.txt", "é\nb\n".encode())["lines"] == 2
    long = at("long.log", b"x" * 9_100_003)
    assert long["truncated"] and len(long["content"]) == 64 << 10
    assert at("bin", b"a\0b")["meta"]["kind"] == "binary" and at("empty", b"")["meta"]["kind"] == "file"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 321, 123)
    assert (at("p.png", png)["width"], at("p.png", png)["height"]) == (321, 123)
    assert at("s.svg", b"<?xml?><svg stroke-width='3' width='12px' height='7'>")["width"] == 12
    assert at("v.svg", b"<svg viewBox='0 0 30 40'/>")["height"] == 40
    assert at("m", b"ID3\3")["kind"] == "audio" and at("x.pdf", b"%PDF-1.4 broken")["kind"] in ("meta", "pdf")
    assert P.preview("/no/such")["kind"] == "error" and P.preview(str(tmp_path))["meta"]["is_dir"]
    assert P.looks_like_text("é".encode()[:1]) and not P.looks_like_text(b"\xff\xfe")
    assert P.truncate("aé".encode(), 2) == "a"
    assert P.cache_key("/a", 1, 2) == P.cache_key("/a", 1, 2) != P.cache_key("/a", 1, 3)
    got = P.previews(spark.createDataFrame([(str(tmp_path / "a.txt"),)], "path string")).first()
    assert got.kind == "text" and got.lines == 2
    assert P.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)


def test_columns_agree_with_plain_code(spark):
    heads = [m + b"rest" for m, _ in T.MAGIC] + [b"", b"text", b"a\0", "é".encode()[:1], b"\xff\xff\xff\xff\xff"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "h binary").select("h", T.kind_from_magic(F.col("h")).alias("k")).collect()
    assert [r.k for r in df] == [P.kind_from_magic(bytes(r.h)) for r in df]
    row = spark.createDataFrame([(1536, 5, 0o754, "abcdefgh", "a/", "éa", 61_000_000)], "s long, m long, mode int, t string, p string, u string, us long").select(
        T.human_size(F.col("s")), T.mode_string(F.col("mode")), T.ellipsis(F.col("t"), 4), T.trim_slash(F.col("p")), T.truncate_utf8(F.col("u"), 1), T.media_clock(F.col("us")), T.line_count(F.lit("a\nb")),
    ).first()
    assert tuple(row) == ("1.5 K", "rwxr-xr--", "abc…", "a", "", "1:01", 2)
    keys = [("/a/é", -5, 1 << 40), ("", 0, 0), ("/x" * 50, 1 << 33, 7)]
    got = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, p string, m long, s long").select("i", T.cache_key(F.col("p"), F.col("m"), F.col("s")).alias("k"))
    assert [r.k for r in got.orderBy("i").collect()] == [P.cache_key(*k) for k in keys] and "Python" not in got._jdf.queryExecution().toString()


def test_timings_by_sorting(spark):
    import random

    from dendroscan.operators.stats import timings

    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([1.0, 2.0, rng.random() * 9])) for _ in range(500)] + [("c", 4.0), ("d", None)]
    want = {}
    for k in "abc":
        v = sorted(x for key, x in rows if key == k)
        want[k] = tuple(v[int((len(v) - 1) * f)] for f in (0, 0.5, 0.95, 1))
    got = timings(spark.createDataFrame(rows, "k string, t double"), "t", "k", parts=8)
    assert {r.k: (r.min, r.p50, r.p95, r.max) for r in got.collect()} == want


def test_icons():
    found = [P.icon_of(P.mime_of(f"x.{e}"), e) for e in ("png", "flac", "mkv", "pdf", "rar", "rs", "")]
    assert [f.removesuffix("-symbolic") for f in found] == ["image-x-generic", "audio-x-generic", "video-x-generic", "application-pdf", "package-x-generic", "text-x-generic", "text-x-generic"]
    assert P.icon_of(None, "png", True) == "folder-symbolic"


def test_config(tmp_path):
    path = str(tmp_path / "c.toml")
    (tmp_path / "c.toml").write_text("max_results = 37\nunknown = 1\n")
    got = Config.load(str(tmp_path / "missing.toml"), path)
    assert got.max_results == 37 and got.watch_budget == 400_000
    got.roots = ['/a "b"', "/é"]
    got.save(path)
    assert Config.load(path) == got


def test_cli(spark, tree, tmp_path, capsys):
    engine = Engine(spark, Config(roots=[str(tree)], snapshot_dir=str(tmp_path / "snap")))
    assert main(["index"], engine=engine) == 0
    capsys.readouterr()
    assert main(["-j", "search", "rope", "txt", "--preview"], engine=engine) == 0
    lines = capsys.readouterr().out.splitlines()
    assert json.loads(lines[0])["size"] == 2 and json.loads(lines[1])["content"] == "hi"
    assert main(["search", "size:abc"], engine=engine) == 2
    assert main(["bench", "rope", "-r", "2"], engine=engine) == 0 and main(["bench", "he", "--typing"], engine=engine) == 0
    assert main(["stats"], engine=engine) == 0 and main(["preview", str(tree / ".lamp")], engine=engine) == 0 and main(["clear"], engine=engine) == 0
    assert order_statistics([float(i) for i in range(20)])["p95"] == 18.0
