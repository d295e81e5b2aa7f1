"""The query language: text to a Query, on the driver.

Tokens are parted by white space outside quotes and are AND-ed. ``ext:``, ``size:``, ``dir:``, ``file:`` and ``re:``
are filters; every other token, and any with a quote in it, is a term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

UNITS = {"": 0, "b": 0, **{u: p for p, s in enumerate("kmgt", 1) for u in (s, f"{s}b", f"{s}ib")}}
MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Term:
    text: str  # folded
    on_path: bool
    ascii: bool


@dataclass(frozen=True)
class Query:
    raw: str = ""
    terms: tuple[Term, ...] = ()
    exts: tuple[str, ...] = ()
    size: tuple[str, int] | None = None
    kind: str | None = None
    regex: str | None = None  # as Spark takes it
    regex_on_path: bool = False
    error: str | None = None
    ext_given: bool = field(default=False, compare=False)

    @property
    def empty(self) -> bool:
        return not (self.terms or self.exts or self.size or self.kind or self.regex)

    @property
    def plain(self) -> bool:
        """Name terms only."""
        return not (self.exts or self.ext_given or self.size or self.kind or self.regex or self.error or any(t.on_path for t in self.terms))

    @property
    def single(self) -> bool:
        """One letter or a dot, which has a scoring table of its own."""
        return len(self.terms) == 1 and bool(re.fullmatch("[a-z.]", self.terms[0].text)) and not self.exts and not self.regex

    def refines(self, before: Query) -> bool:
        """Whether every match of this query matches the one before: its text goes on, and each of its terms holds one."""
        return (
            self.plain and before.plain and not self.empty and not before.empty and self.raw.startswith(before.raw)
            and all(any(old.text in new.text for new in self.terms) for old in before.terms)
        )


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token, whether a quote is in it). A quote that isn't closed goes on to the end."""
    out, now, quoted, inside = [], [], False, False
    for c in text:
        if c == '"':
            inside, quoted = not inside, True
        elif c.isspace() and not inside:
            if now:
                out.append(("".join(now), quoted))
            now, quoted = [], False
        else:
            now.append(c)
    if now:
        out.append(("".join(now), quoted))
    return out


def term(text: str) -> Term:
    plain = text.isascii()
    return Term(text.lower() if plain else text.lower().replace("ς", "σ"), "/" in text, plain)


def parse_size(text: str) -> tuple[str, int]:
    m = re.fullmatch(r"(>=|<=|>|<|=)?\s*([0-9.]*)\s*(.*)", text, re.S)
    op, number, unit = m[1] or ">=", m[2], m[3].strip().lower()
    try:
        value = float(number)
    except ValueError:
        raise ValueError(f"invalid size: {text}") from None
    if unit not in UNITS:
        raise ValueError(f"unknown size unit: {unit}")
    return op, int(min(value * 1024 ** UNITS[unit], MOST))


def spark_regex(pattern: str) -> str:
    """A pattern without look-around and back-references, as Java takes it: Unicode classes and case, ``$`` only at
    the very end, line feed the only line end."""
    out, i, inside = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt:
                raise ValueError("a backslash ends the pattern")
            if nxt.isdigit() or nxt == "k":
                raise ValueError("back-references aren't supported")
            out.append(c + nxt)
            i += 2
            continue
        if inside:
            if pattern.startswith(("&&", "--", "~~"), i):
                raise ValueError("operations on classes aren't supported")
            inside += (c == "[") - (c == "]")
        elif c == "[":
            inside = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        elif c == "(" and re.match(r"\(\?(=|!|<=|<!|>)", pattern[i:]):
            raise ValueError("look-around isn't supported")
        elif c == "(" and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c == "+" and i and pattern[i - 1] in "*+?}" and not (i > 1 and pattern[i - 2] == "\\"):
            raise ValueError("possessive repeats aren't supported")
        elif c == "$":
            c = "\\z"
        out.append(c)
        i += 1
    if inside:
        raise ValueError("a class isn't closed")
    re.compile(re.sub(r"\\[pP](\{[^}]*\}|.)", "x", pattern))  # raises for what isn't well-formed
    return "(?iuUd)" + "".join(out)


def parse(text: str) -> Query:
    terms, exts, size, kind, regex, on_path, error, ext_given = [], [], None, None, None, False, None, False
    for token, quoted in tokens(text):
        head, colon, rest = token.partition(":")
        if quoted or not colon or head not in ("ext", "size", "dir", "file", "re"):
            terms.append(term(token))
        elif head == "ext":
            ext_given = True
            exts += ["".join(c.lower() if c.isascii() else c for c in e.lstrip(".")) for e in rest.split(",") if e]
        elif head == "size":
            try:
                size = parse_size(rest)
            except ValueError as e:
                error = str(e)
        elif head in ("dir", "file"):
            kind = head
            if rest:
                terms.append(term(rest))
        else:
            try:
                regex, on_path = spark_regex(rest), "/" in rest
            except (ValueError, re.error) as e:
                error = f"invalid pattern: {e}"
    return Query(text, tuple(terms), tuple(exts), size, kind, regex, on_path, error, ext_given)
