import pytest

from dendroscan.plans.query import parse, parse_size, spark_regex, tokens


def test_tokens():
    assert tokens('a "b c" d"e f"g  "open end') == [("a", False), ("b c", True), ("de fg", True), ("open end", True)]
    assert tokens(' \t""  ') == []


def test_terms_and_filters():
    q = parse('Foo BAR src/Main ext:.PDF,jpg,, dir: "ext:x"')
    assert [(t.text, t.on_path) for t in q.terms] == [("foo", False), ("bar", False), ("src/main", True), ("ext:x", False)]
    assert q.exts == ("pdf", "jpg") and q.kind == "dir"


def test_prefixes_are_case_sensitive():
    q = parse("EXT:pdf Size:3 http://x")
    assert [t.text for t in q.terms] == ["ext:pdf", "size:3", "http://x"] and not q.exts and q.size is None


def test_last_filter_wins():
    q = parse("size:>1 size:<2k dir: file:a")
    assert q.size == ("<", 2048) and q.kind == "file" and q.terms[0].text == "a"


@pytest.mark.parametrize(("text", "want"), [(">10mb", (">", 10 << 20)), ("<1k", ("<", 1024)), ("5", (">=", 5)), ("=1.5KiB", ("=", 1536)), ("<=3t", ("<=", 3 << 40)), (".5k", (">=", 512))])
def test_sizes(text, want):
    assert parse_size(text) == want


@pytest.mark.parametrize("text", ["abc", "", "1.2.3", "5xb"])
def test_bad_sizes(text):
    assert parse(f"size:{text}").error


def test_huge_size_is_clamped():
    assert parse_size("99999999999999t")[1] == (1 << 63) - 1


@pytest.mark.parametrize("pattern", ["[unclosed", "(?=x)", "(?<!x)", r"(a)\1", "a++", "(?>x)", "[a&&b]", "(", "x\\"])
def test_patterns_that_are_refused(pattern):
    assert parse(f"re:{pattern}").error


def test_patterns():
    assert spark_regex(r"^img_\d+\.jpg$") == r"(?iuUd)^img_\d+\.jpg\z"
    assert spark_regex(r"[$a]\$") == r"(?iuUd)[$a]\$"
    assert parse("re:a/b").regex_on_path and not parse("re:ab").regex_on_path


def test_error_is_kept():
    q = parse("size:abc size:3")
    assert q.error and q.size == (">=", 3)


def test_refines():
    assert parse("report fi").refines(parse("report"))
    assert parse("reports").refines(parse("report"))
    assert not parse("foo ext:").refines(parse("foo ex"))  # an unfinished filter is no term
    assert not parse("a/b").refines(parse("a"))
    assert not parse("rep").refines(parse("report"))
    assert not parse("").refines(parse(""))


def test_single():
    assert parse("x").single and parse(".").single and parse("x dir:").single
    assert not parse("5").single and not parse("xy").single and not parse("x ext:a").single
