import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

from dendroscan.llm import quality
from dendroscan.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_class(c):
    if c.isspace():
        return "space"
    kind = unicodedata.category(c)
    if kind in ("Ll", "Lu", "Lt", "Nd"):
        return {"Ll": "lower", "Nd": "digit"}.get(kind, "upper")
    if kind[0] == "L":
        return "other letter"
    return "symbol" if kind[0] == "S" or c in "#*$%&|<>" else "punctuation" if kind[0] == "P" else "other"


def plain_distance(p, q):
    p, q = ({k: v / sum(h.values()) for k, v in h.items()} for h in (p, q))
    half = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(sum(x * math.log2(x / half[k]) for h in (p, q) for k, x in h.items() if x) / 2)


def plain_verdicts(docs):
    """{doc_id: (base_failed, classes' distance, words' distance, kept)} for (doc_id, lang, text), character by character."""
    classes, words, refs, out, failed = {}, {}, defaultdict(lambda: (Counter(), Counter())), {}, {}
    for i, lang, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed[i] = len(w) < 10 or len(again) / len(w) > 0.2
        classes[i] = Counter(map(plain_class, text or ""))
        words[i] = Counter(x if x in quality.COMMON[lang] else None for x in w)
        if not failed[i]:
            refs[lang][0].update(classes[i])
            refs[lang][1].update(words[i])
    for i, lang, text in docs:
        n, m = len(text or ""), sum(words[i].values())
        dc = plain_distance(classes[i], refs[lang][0]) if n >= 200 else None
        dw = plain_distance(words[i], refs[lang][1]) if m >= 50 else None
        out[i] = failed[i], dc, dw, not failed[i] and (dc is None or dc <= 0.12 + 2.6 / math.sqrt(n)) and (dw is None or dw <= 0.14 + 1.5 / math.sqrt(m))
    return out


def test_op5_by_brute_force(spark, small):
    docs = [(r.doc_id, r.lang, r.text) for r in small.collect()]
    want, seen = plain_verdicts(docs), Counter()
    for r in queries()["op5_distribution_divergence"](spark, SF).collect():
        failed, dc, dw, kept = want[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in ((r.js_classes, dc), (r.js_words, dw)))
        seen[failed, kept] += 1
    assert len(seen) == 3 and sum(seen.values()) == len(docs)


def test_references_without_what_the_base_rules_fail(spark):
    rows = [(1, "one two three four five six seven eight nine ten", "en"), (2, "##### " * 4000, "en"), (3, "too short", "en")]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (refs["en"][0] == quality.class_histogram(rows[0][1])).all() and refs["en"][1].sum() == 10


def test_languages_without_a_word_list(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word("abdeilmnoprstuv") for _ in range(80))
    junk = " ".join(word("0123456789#%") for _ in range(80))
    rows = [(i, prose(), "it") for i in range(60)] + [(60, junk, "it"), (61, prose(), "xx"), (62, junk, None), (63, prose(), "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    refs = quality.references(df)
    assert set(refs) == {*quality.COMMON, "it"} and refs["it"][1] is None and refs["de"][1].sum() == 80
    assert (refs["it"][0] == sum(quality.class_histogram(t) for _, t, x in rows if x == "it")).all()
    got = {r.id: r for r in quality.quality_rules(df).collect()}
    assert all(got[i].js_classes is not None and got[i].js_words is None and got[i].kept for i in range(60))
    assert not got[60].base_failed and not got[60].kept
    assert got[61].js_classes is None and got[62].js_classes is None and got[62].kept and got[63].js_words is not None
