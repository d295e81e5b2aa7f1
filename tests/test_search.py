import random

import pytest
from pyspark.sql import functions as F

from dendroscan.functions import text as T
from dendroscan.operators.search import Typeahead, search
from dendroscan.plans.query import parse

#: A harbour office: (path, size, mtime, is_dir).
OFFICE = [
    ("/srv/port/ledger.ods", 3_500_000, 70, False), ("/srv/port/ledgerbooks", 4096, 160, True), ("/srv/port/2019/q2/ledger_audit.ods", 12, 90, False),
    ("/srv/port/old-ledger.csv", 12, 110, False), ("/srv/port/subledgers.csv", 12, 130, False), ("/srv/port/scans/DOCK 7781.TIF", 9_000_000, 150, False),
    ("/srv/port/scans/dock.7781.tif.part", 700, 155, False), ("/srv/tide", 0, 5, True),
]


def entries(spark, rows):
    data = [(i, p.rpartition("/")[0] + "/", p.rpartition("/")[2], len([x for x in p.split("/")[:-1] if x]), s, m, d) for i, (p, s, m, d) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, dir_path string, name string, depth int, size long, mtime long, is_dir boolean")


def plain(spark, *paths):
    return entries(spark, [(p, 1, 1, False) for p in paths])


@pytest.fixture(scope="module")
def office(spark):
    return entries(spark, OFFICE).cache()


def scored(found):
    return [(r.name, r.score) for r in found.hits.collect()]


def test_each_tier_and_shorter_places_first(office):
    assert scored(search(office, "Ledger")) == [("ledger.ods", 95), ("ledgerbooks", 80), ("ledger_audit.ods", 80), ("old-ledger.csv", 60), ("subledgers.csv", 40)]
    assert scored(search(office, "ledger.ods")) == [("ledger.ods", 100)]
    assert scored(search(office, "led csv")) == [("old-ledger.csv", 60), ("subledgers.csv", 50)]  # means of both terms


CASES = [
    ("dock", {5, 6}), ('"dock 7781"', {5}), ("7781 part", {6}), ("ledger tide", set()), ("ext:tif", {5}), ("ext:part,ods", {0, 2, 6}), ("ext:tif.part", set()),
    ("size:>3mb", {0, 5}), ("size:<=12 csv", {3, 4}), ("dir:", {1, 7}), ("dir: led", {1}), ("file: ext:csv", {3, 4}), ("q2/led", {2}), ("port/scans/", {5, 6}),
    (r"re:^\w+\.ods$", {0, 2}), ("re:/scans/.*part", {6}), (" ", set()), ("size:many", set()),
]


@pytest.mark.parametrize(("text", "ids"), CASES)
def test_who_matches(office, text, ids):
    got = search(office, text)
    assert {r.id for r in got.hits.collect()} == ids
    assert (got.total, got.scanned) == ((0, 0) if got.query.empty or got.error else (len(ids), len(OFFICE)))


def test_path_terms(office):
    assert scored(search(office, "port/2019")) == [("ledger_audit.ods", 20)]  # inside the directory
    assert scored(search(office, "port/sub")) == [("subledgers.csv", 60)]  # across the last slash


def test_limits(office):
    for limit, n in ((3, 3), (0, 1), (50, 5)):
        got = search(office, "ledger", limit)
        assert len(got.hits.collect()) == n and got.total == 5 and got.truncated == (limit < 5)


def test_filters_and_patterns_have_one_score(office):
    assert {s for _, s in scored(search(office, "ext:ods size:>1"))} == {0} and {s for _, s in scored(search(office, "re:dock"))} == {40}


def test_single_letter(spark):
    got = search(plain(spark, "/k/qt", "/k/opaque", "/k/q", "/k/zinc", "/k/Qa"), "q")
    assert scored(got) == [("q", 100), ("qt", 80), ("Qa", 80), ("opaque", 40)] and got.total == 4


def test_ties_by_depth_then_time_then_id(spark):
    rows = [("/m/n/o/tune.mid", 1, 99, False), ("/m/tune.mid", 1, 3, False), ("/n/tune.mid", 1, 8, False), ("/o/tune.mid", 1, 3, False)]
    assert [r.id for r in search(entries(spark, rows), "tune").hits.collect()] == [2, 1, 3, 0]


def test_unicode(spark):
    odd = plain(spark, "/u/Žluť.md", "/u/zlut.md", "/u/ΛΌΓΟΣ", "/u/\u212a")
    assert scored(search(odd, "žluť")) == [("Žluť.md", 95)] and scored(search(odd, "λόγος")) == [("ΛΌΓΟΣ", 100)]
    assert search(odd, "k").hits.count() == 0  # the Kelvin sign isn't a k


def test_typeahead_is_as_good_as_a_search(spark):
    e = entries(spark, [(f"/w/gull{i:02}.wav", i, i, False) for i in range(40)] + [("/w/gusts", 1, 1, True)])
    ahead = Typeahead()
    for text in ("g", "gu", "gull", "gull3", "gull3 ext:", "gull3 ext:wav", "zz"):
        got, want = ahead.search(e, text, 100), search(e, text, 100)
        assert got.hits.collect() == want.hits.collect(), text
        assert got.total == want.total
    first = Typeahead().search(e, "gull")
    assert len(first.hits.collect()) == 20 and (first.total, first.scanned) == (40, 41)


def plain_score(q, path, name):
    """The same by plain Python, or None."""
    fold = lambda s, t: "".join(c.lower() if c.isascii() else c for c in s) if t.ascii else s.lower().replace("ς", "σ")
    scores = []
    for t in q.terms:
        n = fold(name, t)
        at = n.find(t.text)
        if at < 0:
            return None
        stem = n.rpartition(".")[0] if "." in n else None
        scores.append(100 if n == t.text else 95 if at == 0 and stem is not None and len(stem) == len(t.text) else 80 if at == 0 else 60 if n[at - 1] in "_-. /@+," else 40)
    if q.single:
        n = fold(name, q.terms[0])
        return (100 if len(name.encode()) == 1 else 80) if n[0] == q.terms[0].text else 40
    return sum(scores) // len(scores)


def test_random_names_against_plain_python(spark):
    rng = random.Random(7)
    rows = {f"/d/{''.join(rng.choice('abAB._-019 éÉΣσ') for _ in range(rng.randrange(1, 9))).strip() or 'x'}" for _ in range(400)}
    rows = sorted(rows)
    e = entries(spark, [(p, 1, 1, False) for p in rows]).cache()
    for text in ("a", "ab", "b.", "é", "a b", "σ", "-0", "ab 1"):
        q = parse(text)
        want = {p: s for p in rows if (s := plain_score(q, p, p[3:])) is not None}
        assert {r.path: r.score for r in search(e, q, 1000).hits.collect()} == want, text


def test_signatures_reject_no_match(spark):
    rng = random.Random(12345)
    rows = [("".join(rng.choice("abcdefghIJ._-019/") for _ in range(rng.randrange(4, 27))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "name string").select("name", T.signature(F.col("name")).alias("a"), T.signature2(F.col("name")).alias("b")).collect()
    for r in got:
        assert (r.a, r.b) == T.needed_bits(r.name)
        at = rng.randrange(len(r.name) - 2)
        a, b = T.needed_bits(r.name[at : at + 3].swapcase())
        assert r.a & a == a and r.b & b == b


def test_plans(office, spark, tmp_path):
    plan = search(office, "ledger", 5, count=False).hits._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    from dendroscan import Snapshot

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    snap = Snapshot(spark, str(tmp_path / "s"))
    snap.write(office)
    for count in (True, False):  # a search that counts prunes as well
        got = search(snap.read(), "file: ext:csv size:>1 ledger", 5, count=count)
        plan = got.hits._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert all(x in pushed for x in ("EqualTo(ext,csv)", "GreaterThan(size,1)", "Not(EqualTo(is_dir,true))")), pushed[:900]
        assert len(got.hits.collect()) == 2
    assert got.scanned == len(OFFICE)
