"""Scalar functions over names, paths and sizes, as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIR, SYMLINK, DEAD, HIDDEN = 1, 2, 4, 8
#: Fixed value: characters after which a word begins.
BOUNDARY = ("_", "-", ".", " ", "/", "@", "+", ",")
#: The factors that hash pairs of bytes in the two signatures.
PAIR_FACTOR, PAIR_FACTOR2 = 0x9E3779B1, 0x85EBCA6B
#: The offset basis and the prime of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z; lower() would also turn the Kelvin sign into k."""
    return F.translate(c, UPPER, LOWER)


def fold_unicode(c: Column) -> Column:
    """Lower case, with one form of sigma."""
    return F.translate(F.lower(c), "ς", "σ")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), fold_ascii(F.substring_index(name, ".", -1)))


def stem_length(name: Column) -> Column:
    """Characters before the last dot; null without one."""
    return F.when(F.contains(name, F.lit(".")), F.length(name) - F.locate(".", F.reverse(name)))


def path_of(dir_path: Column, name: Column) -> Column:
    return F.concat(dir_path, name)


def parent_of(path: Column) -> Column:
    """The directory of a path, with its final slash."""
    return F.regexp_extract(path, "^(.*/)[^/]+/?$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/?$", 1)


def id_of(path: Column, name: Column, raw: Column) -> Column:
    """An entry's id: a hash of its path, and of its name's bytes where these aren't the name in UTF-8."""
    return F.when(raw.isNull() | (raw == F.encode(name, "UTF-8")), F.xxhash64(path)).otherwise(F.xxhash64(path, raw))


def trim_slash(path: Column) -> Column:
    """Without slashes at the end, but for a bare root."""
    return F.when(F.rlike(path, F.lit("^/+$")), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))


def depth_of(dir_path: Column) -> Column:
    return F.size(F.filter(F.split(dir_path, "/"), lambda x: x != "")).cast("int")


def place_length(depth: Column, name: Column) -> Column:
    """Sort key for short and shallow paths: 16 for each level, one for each byte of the name."""
    return F.least(depth * 16 + F.octet_length(name), F.lit(65535))


def clamped_mtime(mtime: Column) -> Column:
    return F.least(F.greatest(mtime, F.lit(0).cast("bigint")), F.lit(4294967295).cast("bigint"))


def flags_of(name: Column, is_dir: Column, is_symlink: Column) -> Column:
    return (F.when(is_dir, DIR).otherwise(0) + F.when(is_symlink, SYMLINK).otherwise(0) + F.when(F.startswith(name, F.lit(".")), HIDDEN).otherwise(0)).cast("int")


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a root is the path or one of its parents, component by component."""
    tests = [(path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def watchable(relative: Column, excluded: list[str]) -> Column:
    """No component of a path below its root has an excluded name."""
    return ~F.exists(F.split(relative, "/"), lambda x: x.isin(*excluded) if excluded else F.lit(False))


def _byte_bits(b: Column) -> Column:
    """Place of a byte's bit among the first 32: letters, digits by threes, the dot, separators, all others."""
    low = b.bitwiseOR(F.lit(32))
    return (
        F.when(low.between(97, 122), low - 97).when(low.between(48, 57), (low - 48) % 3 + 26).when(low == 46, 29)
        .when(low.isin(45, 47, 32), 30).otherwise(31)
    )


def _bytes_of(name: Column) -> Column:
    """The UTF-8 bytes as integers."""
    raw = F.hex(F.encode(name, "UTF-8"))
    return F.when(F.octet_length(name) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(name) - 1), lambda i: F.conv(F.substr(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _pair_bits(raw: Column, factor: int) -> Column:
    pairs = F.zip_with(F.slice(raw, F.lit(1), F.greatest(F.size(raw) - 1, F.lit(0))), F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), lambda a, b: a.bitwiseOR(F.lit(32)) * 256 + b.bitwiseOR(F.lit(32)))
    return F.transform(pairs, lambda k: F.shiftright((k * F.lit(factor).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), 27))


def _or(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int"))))


def signature(name: Column) -> Column:
    """64 bits: which kinds of bytes a name has, and in the upper half which hashed pairs of neighbours (signed)."""
    raw = _bytes_of(name)
    return _or(F.transform(raw, _byte_bits)).bitwiseOR(_or(F.transform(_pair_bits(raw, PAIR_FACTOR), lambda b: b + 32)))


def signature2(name: Column) -> Column:
    """32 more bits of pairs, by another factor."""
    return _or(_pair_bits(_bytes_of(name), PAIR_FACTOR2))


def needed_bits(term: str) -> tuple[int, int]:
    """The signatures of an ASCII term: a name that contains it has all of their bits. Signed 64 bits, and 32 bits."""
    raw, sig, sig2 = term.encode(), 0, 0
    for i, b in enumerate(raw):
        low = b | 32
        place = low - 97 if 97 <= low <= 122 else 26 + (low - 48) % 3 if 48 <= low <= 57 else 29 if low == 46 else 30 if low in (45, 47, 32) else 31
        sig |= 1 << place
        if i:
            key = (raw[i - 1] | 32) << 8 | low
            sig |= 1 << 32 + ((key * PAIR_FACTOR & 0xFFFFFFFF) >> 27)
            sig2 |= 1 << ((key * PAIR_FACTOR2 & 0xFFFFFFFF) >> 27)
    return sig - (1 << 64) if sig >> 63 else sig, sig2


def human_size(size: Column, units: tuple[str, ...] = ("B", "K", "M", "G", "T")) -> Column:
    """``n B`` below 1024, else one decimal of the largest unit that leaves 1 or more; halves go to the even digit."""
    out = F.format_string(f"%d {units[0]}", size)
    for power, unit in enumerate(units[1:], 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / 1024**power, 1))).otherwise(out)
    return out


def media_clock(micros: Column) -> Column:
    seconds = F.floor(micros / 1000000).cast("bigint")
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("bigint"), seconds % 60)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def mode_string(mode: Column) -> Column:
    return F.concat(*[F.when(mode.bitwiseAND(F.lit(1 << 8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)])


def line_count(text: Column) -> Column:
    """A line feed at the end begins no line."""
    n = F.size(F.split(text, "\n", -1))
    return F.when(F.length(text) == 0, 0).otherwise(n - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def truncate_utf8(text: Column, n: int) -> Column:
    """The longest prefix of whole characters in ``n`` bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, n)
    tail = [F.substring(cut, 1, n - back).cast("string") for back in range(4)]
    whole = F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")
    for t in reversed(tail):
        whole = F.when(F.is_valid_utf8(t), t).otherwise(whole)
    return F.when(F.octet_length(text) <= n, text).otherwise(whole)


#: The beginnings of files and their kinds.
MAGIC = (
    (b"%PDF-", "pdf"), (b"\x7fELF", "elf"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"),
    (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"), (b"#!", "script"), (b"OggS", "ogg"), (b"\x00asm", "wasm"),
)


def looks_like_text(head: Column) -> Column:
    """Not empty, no NUL, UTF-8 but perhaps for a last character that is cut."""
    whole = F.lit(False)
    for back in range(4):
        whole = whole | F.is_valid_utf8(F.substr(head, F.lit(1), F.greatest(F.octet_length(head) - back, F.lit(0))).cast("string"))
    return (F.octet_length(head) > 0) & ~F.contains(head, F.lit(b"\x00")) & whole


def kind_from_magic(head: Column) -> Column:
    out = F.when(F.octet_length(head) == 0, "file").when(looks_like_text(head), "text").otherwise("binary")
    for begin, kind in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(begin)), kind).otherwise(out)
    return out


def svg_size(head: Column) -> Column:
    """Struct of width and height from the first <svg tag: its attributes, else its viewBox, else 0."""
    tag = F.left(F.regexp_extract(head, "(?s)(<svg[^>]*)", 1), F.lit(2048))

    def attribute(name: str) -> Column:
        return F.regexp_extract(tag, f"""(?s)\\s{name}\\s*=\\s*["']([^"']*)["']""", 1)

    def number(c: Column) -> Column:
        return F.regexp_replace(F.trim(c), "[A-Za-z%]+$", "").try_cast("double")

    def pixels(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(2147483647.0)).cast("int")

    w, h = number(attribute("width")), number(attribute("height"))
    box = F.filter(F.transform(F.split(attribute("viewBox"), "[,\\s]+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    own, boxed = w.isNotNull() & h.isNotNull(), F.size(box) >= 4
    return F.struct(
        F.when(own, pixels(w)).when(boxed, pixels(F.get(box, F.lit(2)))).otherwise(0).alias("width"),
        F.when(own, pixels(h)).when(boxed, pixels(F.get(box, F.lit(3)))).otherwise(0).alias("height"),
    )


def _little_endian(number: Column) -> list[Column]:
    return [F.shiftright(number, 8 * i).bitwiseAND(F.lit(255).cast("bigint")) for i in range(8)]


def cache_key(path: Column, mtime: Column, size: Column) -> Column:
    """FNV-1a (64 bits) over the path's bytes, mtime and size as little-endian 8 bytes: 16 hexadecimal digits. The hash
    is folded in two halves of 32 bits, for a product of 64 bits would overflow; the prime is 2**40 + 435."""
    long = lambda n: F.lit(n).cast("bigint")
    half, rest = long(0xFFFFFFFF), FNV_PRIME - (1 << 40)

    def fold(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        product = low * rest
        high = acc["high"] * rest + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    data = F.concat(_bytes_of(path), F.array(*_little_endian(mtime.cast("bigint")), *_little_endian(size.cast("bigint"))))
    begin = F.struct(long(FNV_BASIS >> 32).alias("high"), long(FNV_BASIS & 0xFFFFFFFF).alias("low"))
    digits = lambda c: F.lpad(F.hex(c), 8, "0")
    return F.aggregate(data, begin, fold, lambda acc: F.lower(F.concat(digits(acc["high"]), digits(acc["low"]))))


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h
