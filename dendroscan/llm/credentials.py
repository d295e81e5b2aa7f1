"""Secrets in texts, with credentials whose parts stand apart linked to each other.

Base patterns report by themselves. Beside them there are weak candidates: named identifiers, long mixed tokens and
endpoints. An interval join brings the parts of a text together: each part's interval is its span widened by
``reach`` code points, cut off at the blank lines around it (the scope). A weak candidate is reported only if a part
of a complementary role overlaps its interval; a strong part counts as a partner too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_work, small_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "mixed", "endpoint")

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_IDENT = re.compile(r"""(?:client|account|user|key|access)_?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.A | re.I)
_MIXED = re.compile(r"[A-Za-z0-9/+]{40,}={0,2}")
_ENDPOINT = re.compile(r"""(?:(?:https?|s3|ftp|amqp|jdbc:[a-z]+|postgres|mysql|redis)://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9.-]+(?::[0-9]+)?)""", re.A | re.I)
_ROLE = {"assign": "secret", "hex": "secret", "mixed": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}

_HEX_ONLY = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_TOKEN_ONLY = bytes(1 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "/+") else 0 for b in range(256))
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")


def _runs(narrow: bytes, table: bytes, least: int):
    """Maximal runs of the table's bytes, of ``least`` bytes at least."""
    flat = narrow.translate(table)
    probe, at = b"\1" * least, 0
    while (start := flat.find(probe, at)) >= 0:
        end = flat.find(b"\0", start)
        at = len(flat) if end < 0 else end
        yield start, at


def base_spans(text: str, narrow: bytes | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in code points; narrow: the text with one byte per code point."""
    narrow = text.encode("latin-1", "replace") if narrow is None else narrow
    found = []
    low = narrow.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in narrow:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", a, b) for a, b in _runs(narrow, _HEX_ONLY, 24)]
    return found


def _weak(text: str, narrow: bytes) -> list[tuple[str, int, int]]:
    low = narrow.lower()
    found = []
    if b"id" in low or b"name" in low:
        found += [("ident", *m.span()) for m in _IDENT.finditer(text)]
    for a, b in _runs(narrow, _TOKEN_ONLY, 40):
        token = text[a:b]
        if any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token):
            found.append(("mixed", a, b))
    if b"://" in low or b"host" in low or b"endpoint" in low or b"server" in low:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return found


def spans(text: str | None, reach: int = 300) -> list[tuple[str, int, int, str | None, int | None]]:
    """(kind, start, end, partner's kind, partner's start), by start, then by kind as listed in KINDS.

    An empty or null text has none. Weak candidates that a base span covers are left out; of equal partners the
    nearest counts, then the earliest.
    """
    if not text:
        return []
    narrow = text.encode("latin-1", "replace")
    strong = base_spans(text, narrow)
    # a text without any weak or strong secret or identifier can have no link: most texts end here
    weak = _weak(text, narrow)
    if not strong and not (weak and len({_ROLE[k] for k, _, _ in weak}) > 1):
        return []
    starts = sorted((a, b) for _, a, b in strong)
    tops, top = [], 0
    for _, b in starts:
        tops.append(top := max(top, b))
    def covered(a, b):
        i = bisect_right(starts, (a, len(text)))
        return i > 0 and tops[i - 1] >= b
    weak = [x for x in weak if not covered(x[1], x[2])]
    parts = sorted({*strong, *weak}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)] if len(parts) > 1 else []
    sides = {}
    for role in ("ident", "secret", "endpoint"):
        mine = [p for p in parts if _ROLE[p[0]] == role]
        sides[role] = mine, [p[1] for p in mine], list(accumulate((p[2] for p in mine), max))
    out = []
    for kind, a, b in parts:
        k = bisect_left(breaks, a)
        lo = max(a - reach, breaks[k - 1] if k else 0)
        hi = min(b + reach, breaks[j] if (j := bisect_left(breaks, b)) < len(breaks) else len(text))
        best = None
        for role, (mine, firsts, ends) in sides.items():
            if role == _ROLE[kind]:
                continue
            near = bisect_left(firsts, a)
            # of the parts that start before this one, the first that reaches it, or else the first of those that come nearest
            nearest = [bisect_left(ends, min(a, ends[near - 1]))] if near else []
            for i in (*nearest, near):  # and the first that starts in it or behind
                if i < len(mine) and mine[i][1] < hi and mine[i][2] > lo:
                    p = mine[i]
                    gap = max(p[1] - b, a - p[2], 0)
                    best = min(best or (gap, p[1], KINDS.index(p[0])), (gap, p[1], KINDS.index(p[0])))
        if kind in BASE or best:
            out.append((kind, a, b, KINDS[best[2]] if best else None, best[1] if best else None))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n.endswith(("start", "end")) else T.StringType()) for n in ("kind", "start", "end", "value", "partner_kind", "partner_start")]))


def _by_slices(text, made, kind, step: int = 256):
    """What ``made`` gives for each text of an Arrow array, a few texts at a time in Python."""
    import pyarrow as pa

    at_work("credentials")
    done = [pa.array([made(t) for t in text.slice(at, step).to_pylist()], kind) for at in range(0, len(text), step)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(_SPANS)
def _scan(text):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("partner_kind", pa.string()), ("partner_start", pa.int64())]))
    return _by_slices(text, lambda t: [{"kind": k, "start": a, "end": b, "value": t[a:b], "partner_kind": pk, "partner_start": ps} for k, a, b, pk, ps in spans(t)], kind)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``found``, an array of (kind, start, end, value, partner_kind,
    partner_start) in the order of spans(). Offsets are code points, ends are exclusive.

    Null and empty texts have no spans; null or repeated ids are passed through; other columns are ignored; an
    empty table gives no rows.
    """
    return small_batches(df).select(F.col(id_col).alias("id"), _scan(F.col(text_col)).alias("found"))


def redacted(text: str | None, mask: str = "[REDACTED]") -> str | None:
    """The text with each span (overlapping ones as one) replaced."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for _, a, b, _, _ in found:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _redact(text):
    import pyarrow as pa

    return _by_slices(text, redacted, pa.string())


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span replaced in its text, and the number of characters set anew. A null text stays null."""
    out = small_batches(df).withColumn(text_col, _redact(F.col(text_col)))
    if chars_col in df.columns:
        kind = df.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
