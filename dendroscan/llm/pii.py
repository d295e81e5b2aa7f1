"""Personal data, in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for bank accounts), and words near
a span raise its score. A text is split at the matches of a kind once: the pieces between the matches give both the
offsets, by summing lengths, and each match's context, so the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn test. False without digits."""

    def add(total: Column, i: Column) -> Column:
        return total + i

    back = F.reverse(_digits(value))

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return (F.length(back) > 0) & (F.aggregate(F.transform(_chars(F.when(F.length(back) > 0, back).otherwise("1")), term), F.lit(0), add) % 10 == 0)


def mod97(value: Column) -> Column:
    """Whether an account number's check digits are right: its first four characters moved to the end and letters
    read as 10 to 35, the remainder by 97 is 1."""
    flat = F.regexp_replace(value, "\\x20", "")
    turned = F.concat(F.substr(flat, F.lit(5)), F.left(flat, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


class Kind(NamedTuple):
    name: str
    pattern: str
    hint: Callable[[Column], Column]
    confirmed: Callable[[Column], Column]
    checked: bool
    context: str


#: The lookbehinds and possessive repeats change no match: they keep long runs from being tried at every character.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), False, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda t: F.contains(t, F.lit(".")), lambda v: F.rlike(v, F.lit(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")), False, r"(?:^|[^a-z0-9])ip(?:[^a-z0-9]|$)|address|host|server|adresse|direcc"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda v: F.length(_digits(v)).between(13, 19) & luhn(v), True, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15), False, "phone|call|mobile|fax|tel"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]")), mod97, True, "iban|account|bank|konto|compte|cuenta"),
)
BASE = tuple(k.name for k in KINDS[:4])


def _found(text: Column, kind: Kind, near: int) -> Column:
    """Array of the confirmed spans of one kind, by start."""
    hint = kind.hint(text)
    matches = F.when(hint, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(hint, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.aggregate(
        F.zip_with(matches, F.zip_with(gaps, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))), lambda b, a: F.struct(b.alias("before"), a.alias("after"))), lambda m, g: F.struct(m.alias("value"), g.alias("gap"))),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: _step(acc, x, kind, near),
        lambda acc: acc["out"],
    )


def _step(acc: Column, x: Column, kind: Kind, near: int) -> Column:
    value = x["value"]
    start = acc["at"] + F.length(x["gap"]["before"])
    end = start + F.length(value)
    around = F.translate(F.concat_ws(" ", F.right(x["gap"]["before"], F.lit(near)), F.left(x["gap"]["after"], F.lit(near))), UPPER, UPPER.lower())
    score = F.lit(0.8 if kind.checked else 0.5) + F.when(F.rlike(around, F.lit(kind.context)), F.lit(0.2)).otherwise(F.lit(0.0))
    span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), score.alias("score"))
    # the last piece is behind the last match: there is no value beside it
    out = F.when(value.isNotNull() & kind.confirmed(value), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
    return F.struct(F.coalesce(end, acc["at"]).alias("at"), out.alias("out"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 40) -> DataFrame:
    """One row per input row: ``id`` and ``found``, an array of (kind, start, end, value, score) by kind as in KINDS,
    then by start. Offsets are code points, ends are exclusive.

    Matches of a kind are leftmost and don't overlap; those that a checksum, a length or a range refutes are dropped
    and not tried again. Hints only save work: without one, a text has no match of the kind. A score is 0.5, or 0.8 for what a checksum confirms, and 0.2 more with a context word within
    ``near`` code points that belong to no other match of the kind. Null and empty texts have no spans; null or
    repeated ids are passed through; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.concat(*[_found(text, k, near) for k in KINDS]).alias("found"))
