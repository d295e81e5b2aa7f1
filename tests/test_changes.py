from datetime import datetime

from pyspark.sql import functions as F

from dendroscan.operators import changes as C
from dendroscan.operators import stats, tree

STATE = "path string, size long, mtime long, is_dir boolean"
CHANGES = f"seq long, op string, {STATE}"
EVENTS = "ts timestamp, kind string, paths array<string>, tracker long, overflow boolean"
NOW = datetime(2024, 1, 1)


def state(spark, *rows):
    return spark.createDataFrame(list(rows), STATE)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_coalesce(spark):
    rows = [(NOW, "modify", ["/a"], None, False)] * 500 + [(NOW, "create", ["/a"], None, False), (NOW, "remove", ["/b"], None, False), (NOW, "access", ["/c"], None, False), (NOW, "rename_both", ["/d", "/e"], 1, False), (NOW, "create", ["/lost"], None, True)]
    events = spark.createDataFrame(rows, EVENTS)
    assert {(r.path, r.touch) for r in C.coalesce(events).collect()} == {("/a", 2), ("/b", 1), ("/d", 1), ("/e", 2)}
    assert C.overflows(events, "1 hour").first().overflow


def test_rename_pairs(spark):
    events = spark.createDataFrame([(NOW, "rename_from", ["/a"], 1, False), (NOW, "rename_to", ["/b"], 1, False), (NOW, "rename_from", ["/c"], 2, False), (NOW, "rename_both", ["/x", "/y"], 3, False)], EVENTS)
    assert tuple(C.rename_pairs(events).first()) == (2, 1)


def test_difference(spark):
    before = state(spark, ("/same", 1, 1, False), ("/grown", 1, 1, False), ("/gone", 1, 1, False), ("/gone_dir", 1, 1, True), ("/null", None, None, False))
    after = state(spark, ("/same", 1, 1, False), ("/grown", 2, 1, False), ("/new", 1, 1, True), ("/null", None, None, False))
    got = {r.path: r.op for r in C.difference(before, after).collect()}
    assert got == {"/grown": "upsert", "/gone": "remove", "/gone_dir": "remove_dir", "/new": "upsert"}
    assert paths(C.apply(before, C.difference(before, after).withColumn("seq", F.lit(0).cast("long")))) == paths(after)


def test_last_change_wins(spark):
    changes = spark.createDataFrame([(1, "upsert", "/n", 1, 1, False), (2, "upsert", "/n", 2, 2, False), (3, "remove", "/r", None, None, None), (4, "upsert", "/r", 5, 5, True), (5, "upsert", "/u", 1, 1, False), (6, "remove", "/u", None, None, None)], CHANGES)
    got = {r.path: (r.size, r.is_dir) for r in C.apply(state(spark, ("/r", 1, 1, False)), changes).collect()}
    assert got == {"/n": (2, False), "/r": (5, True)}
    assert tuple(C.outcome(state(spark, ("/r", 1, 1, False)), changes).first()) == (1, 1, 0)


def test_subtree_removal(spark):
    before = state(spark, ("/a/b", 1, 1, True), ("/a/b/c", 1, 1, False), ("/a/b/d/e", 1, 1, False), ("/a/bc", 1, 1, False))
    changes = spark.createDataFrame([(1, "remove_dir", "/a/b", None, None, None), (2, "upsert", "/a/b/late", 1, 1, False)], CHANGES)
    assert paths(C.apply(before, changes)) == ["/a/b/late", "/a/bc"]


def test_empty(spark):
    none, changes = spark.createDataFrame([], STATE), spark.createDataFrame([], CHANGES)
    assert C.apply(none, changes).count() == 0 and C.difference(none, none).count() == 0
    assert tuple(C.outcome(none, changes).first()) == (0, 0, 0)


def test_tree(spark):
    e = C.as_entries(state(spark, ("/a/b/c/x", 1, 1, False), ("/a/d/y", 1, 1, False), ("/z", 1, 1, False)))
    dirs = tree.ancestors(e)
    assert sorted((r.path, r.depth) for r in dirs.collect()) == [("/", 0), ("/a/", 1), ("/a/b/", 2), ("/a/b/c/", 3), ("/a/d/", 2)]
    assert [r.path for r in tree.listing(dirs, ["b"]).collect()] == ["/", "/a/", "/a/d/"]
    assert tree.subtree(e, "/a/b").count() == 1
    assert tree.frontier([("/", 0), ("/a/", 1), ("/a/b/", 2), ("/c/", 1)], 2) == (["/", "/a/"], ["/a/b/", "/c/"])
    nodes = spark.createDataFrame([(0, None, ""), (1, 0, "a"), (2, 1, "b"), (9, 8, "lost")], "id long, parent long, name string")
    assert {(r.id, r.path) for r in tree.paths_from_nodes(spark, nodes).selectExpr("id", "replace(path, '//', '/') path").collect()} == {(0, "/"), (1, "/a/"), (2, "/a/b/")}


def test_deep_tree(spark):
    path = "/" + "/".join(f"d{i}" for i in range(90)) + "/f"
    assert tree.ancestors(C.as_entries(state(spark, (path, 1, 1, False)))).count() == 91


def test_stats(spark):
    e = C.as_entries(state(spark, ("/a/é", 3, 1, False), ("/b", 4, 1, True)))
    assert tuple(stats.index_stats(e).first()) == (2, 2, 3, 7) and tuple(stats.scan_stats(e).first()) == (1, 1, 2)
    times = spark.createDataFrame([(float(i),) for i in range(20)], "ms double")
    assert tuple(stats.timings(times, "ms").first()) == (0.0, 9.0, 18.0, 19.0)
