"""Query to Spark columns: which entries match, and how well."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .query import Query, Term

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}
EXACT, STEM, PREFIX, WORD, INSIDE, IN_PATH = 100, 95, 80, 60, 40, 20


def _folded(c: Column, term: Term) -> Column:
    return T.fold_ascii(c) if term.ascii else T.fold_unicode(c)


def _path_parts(term: Term) -> tuple[Column, Column]:
    """(inside the directory, across the last slash into the name)."""
    d, n = _folded(F.col("dir_path"), term), _folded(F.col("name"), term)
    head, _, rest = term.text.rpartition("/")
    across = F.endswith(d, F.lit(f"{head}/")) & F.startswith(n, F.lit(rest)) if rest else F.lit(False)
    return F.contains(d, F.lit(term.text)), across


def matches(term: Term) -> Column:
    if term.on_path:
        inside, across = _path_parts(term)
        return inside | across
    return F.contains(_folded(F.col("name"), term), F.lit(term.text))


def score(term: Term) -> Column:
    """By the leftmost place of the term."""
    if term.on_path:
        inside, across = _path_parts(term)
        return F.when(inside, IN_PATH).when(across, WORD).otherwise(0)
    n = _folded(F.col("name"), term)
    at = F.locate(term.text, n)
    return (
        F.when(n == term.text, EXACT).when((at == 1) & (T.stem_length(n) == len(term.text)), STEM).when(at == 1, PREFIX)
        .when(F.substr(n, at - 1, F.lit(1)).isin(*T.BOUNDARY), WORD).otherwise(INSIDE)
    )


def predicate(q: Query, stored: tuple[str, ...] | list[str] = ()) -> Column:
    """Conjuncts on plain columns first; these reach the Parquet reader. ``stored``: columns that the entries have; the
    extension is taken from there rather than from the name."""
    tests = []
    if q.kind:
        tests.append(F.col("is_dir") if q.kind == "dir" else ~F.col("is_dir"))
    if q.size:
        tests.append(OPS[q.size[0]](F.col("size"), F.lit(q.size[1]).cast("bigint")))
    if q.exts:
        tests.append((F.col("ext") if "ext" in stored else T.extension(F.col("name"))).isin(*q.exts))
    tests += [matches(t) for t in q.terms]
    if q.regex:
        tests.append(F.rlike(T.path_of(F.col("dir_path"), F.col("name")) if q.regex_on_path else F.col("name"), F.lit(q.regex)))
    return reduce(operator.and_, tests, F.lit(True))


def total_score(q: Query) -> Column:
    """Mean of the terms' scores in whole numbers; 40 for a pattern alone, 0 for filters alone."""
    if q.single:
        first = F.left(T.fold_ascii(F.col("name")), F.lit(1)) == q.terms[0].text
        return F.when(first & (F.octet_length("name") == 1), EXACT).when(first, PREFIX).otherwise(INSIDE).cast("int")
    if not q.terms:
        return F.lit(INSIDE if q.regex else 0).cast("int")
    total = reduce(operator.add, [score(t) for t in q.terms])
    return F.floor(total / len(q.terms)).cast("int")


def prefilter(q: Query) -> Column:
    """Bits that the stored signatures ``sig`` and ``sig2`` of a match have. Changes no result."""
    need = need2 = 0
    for t in q.terms:
        if t.ascii and not t.on_path:
            a, b = T.needed_bits(t.text)
            need, need2 = need | a, need2 | b
    return (F.col("sig").bitwiseAND(F.lit(need).cast("bigint")) == need) & (F.col("sig2").bitwiseAND(F.lit(need2).cast("bigint")) == need2)
