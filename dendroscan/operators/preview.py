"""Bounded previews of files: text, images, audio, PDF, or a card of metadata."""

from __future__ import annotations

import mimetypes
import os
import shutil
import stat
import struct
import subprocess
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import MAGIC, fnv1a

SCHEMA = (
    "kind string, content string, truncated boolean, lines int, width int, height int, pages int, "
    "meta struct<path:string,size:bigint,mtime:bigint,mode:int,owner:string,kind:string,is_dir:boolean>, error string"
)
#: Icons by MIME type or its first part, and by extension where these name none.
ICONS = {
    "image": "image-x-generic-symbolic", "audio": "audio-x-generic-symbolic", "video": "video-x-generic-symbolic",
    "application/pdf": "application-pdf-symbolic", "text": "text-x-generic-symbolic",
}
ICONS_BY_EXTENSION = {
    "application-pdf-symbolic": "pdf",
    "image-x-generic-symbolic": "png jpg jpeg gif webp svg bmp tiff ico",
    "audio-x-generic-symbolic": "mp3 ogg oga opus flac wav m4a aac aiff aif",
    "video-x-generic-symbolic": "mp4 mkv webm avi",
    "package-x-generic-symbolic": "zip tar gz 7z rar",
}
FOLDER_ICON, OTHER_ICON = "folder-symbolic", "text-x-generic-symbolic"


@dataclass(frozen=True)
class Limits:
    head_bytes: int = 8 << 10
    text_bytes: int = 64 << 10
    image_bytes: int = 64 << 20
    timeout_s: float = 10.0


def mime_of(name: str) -> str | None:
    kind, encoding = mimetypes.guess_type(name)
    return {"gzip": "application/gzip", "xz": "application/x-xz", "bzip2": "application/x-bzip2"}.get(encoding, kind)


def icon_of(mime: str | None, ext: str | None = None, is_dir: bool = False) -> str:
    if is_dir:
        return FOLDER_ICON
    found = ICONS.get(mime or "") or ICONS.get((mime or "").split("/")[0])
    return found or next((icon for icon, names in ICONS_BY_EXTENSION.items() if ext in names.split()), OTHER_ICON)


def mime_types(spark: SparkSession) -> DataFrame:
    """(ext, mime, icon) for all extensions that the standard library knows: about a thousand rows."""
    table = {e.lstrip("."): m for e, m in mimetypes.types_map.items()} | {"gz": "application/gzip", "xz": "application/x-xz", "bz2": "application/x-bzip2"}
    known = {e for names in ICONS_BY_EXTENSION.values() for e in names.split()}
    rows = [(e, table.get(e), icon_of(table.get(e), e)) for e in sorted({*table, *known})]
    return spark.createDataFrame(rows, "ext string, mime string, icon string")


def looks_like_text(head: bytes) -> bool:
    if not head or b"\0" in head:
        return False
    try:
        head.decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and len(head) - e.start < 4
    return True


def kind_from_magic(head: bytes) -> str:
    for begin, kind in MAGIC:
        if head.startswith(begin):
            return kind
    return "file" if not head else "text" if looks_like_text(head) else "binary"


def truncate(data: bytes, n: int) -> str:
    cut = data[:n]
    while cut and n < len(data):
        try:
            return cut.decode()
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                break
            cut = cut[: e.start]
    return cut.decode("utf-8", "replace")


def is_audio(name: str, head: bytes) -> bool:
    if head.startswith((b"fLaC", b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xf2")):
        return True
    if (head[:4], head[8:12]) in ((b"RIFF", b"WAVE"), (b"FORM", b"AIFF"), (b"FORM", b"AIFC")):
        return True
    return (mime_of(name) or "").startswith("audio/")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of PNG, GIF, BMP, WebP, ICO, JPEG and TIFF."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data.startswith(b"BM"):
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            return struct.unpack("<HH", data[26:30])[0] & 0x3FFF, struct.unpack("<HH", data[26:30])[1] & 0x3FFF
        if data[:4] == b"\0\0\1\0":
            return data[6] or 256, data[7] or 256
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
        if data[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if data[:1] == b"I" else ">"
            at = struct.unpack(f"{order}I", data[4:8])[0]
            tags = {}
            for i in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
                tag, kind = struct.unpack(f"{order}HH", data[at + 2 + 12 * i : at + 6 + 12 * i])
                tags[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", data[at + 10 + 12 * i : at + (12 if kind == 3 else 14) + 12 * i])[0]
            return tags[256], tags[257]
    except (struct.error, KeyError, IndexError):
        pass
    return None


def cache_key(path: str, mtime: int, size: int) -> str:
    return f"{fnv1a(os.fsencode(path) + mtime.to_bytes(8, 'little', signed=True) + size.to_bytes(8, 'little')):016x}"


@lru_cache(maxsize=1)
def _owners(changed: float) -> dict[str, str]:
    """Names by number, read once for each state of the file."""
    with open("/etc/passwd", encoding="utf-8", errors="replace") as f:
        rows = [line.split(":") for line in f]
    return {x[2]: x[0] for x in reversed(rows) if len(x) > 2}


def owner_name(uid: int) -> str:
    try:
        return _owners(os.stat("/etc/passwd").st_mtime).get(str(uid), str(uid))
    except OSError:
        return str(uid)


def _pdf(path: str, limits: Limits) -> dict | None:
    """Pages and the first page's text by the poppler tools; None if they are missing or fail."""
    if not shutil.which("pdftotext"):
        return None
    run = lambda *a: subprocess.run(a, capture_output=True, timeout=limits.timeout_s, check=True).stdout
    try:
        text = run("pdftotext", "-l", "1", path, "-")
        info = run("pdfinfo", path).decode("utf-8", "replace") if shutil.which("pdfinfo") else ""
    except (OSError, subprocess.SubprocessError):
        return None
    pages = next((int(x.split(":")[1]) for x in info.splitlines() if x.startswith("Pages:")), None)
    return {"kind": "pdf", "content": truncate(text, limits.text_bytes), "pages": pages, "truncated": len(text) > limits.text_bytes}


def preview(path: str, limits: Limits = Limits()) -> dict:
    """The preview of one file as a dict of SCHEMA's fields; what can't be shown otherwise is a card."""
    empty = dict.fromkeys(("kind", "content", "truncated", "lines", "width", "height", "pages", "meta", "error"))
    try:
        s = os.lstat(path)
    except OSError as e:
        return empty | {"kind": "error", "error": str(e)}
    is_dir, name = stat.S_ISDIR(s.st_mode), os.path.basename(path)
    head = b""
    if stat.S_ISREG(s.st_mode):
        try:
            with open(path, "rb") as f:
                head = f.read(limits.head_bytes)
        except OSError as e:
            return empty | {"kind": "error", "error": str(e)}
    ext = os.path.splitext(name)[1].lstrip(".").lower()
    kind = "directory" if is_dir else "symlink" if stat.S_ISLNK(s.st_mode) else ext or kind_from_magic(head[:16])
    meta = {"path": path, "size": s.st_size, "mtime": int(s.st_mtime), "mode": s.st_mode & 0o7777, "owner": owner_name(s.st_uid), "kind": kind, "is_dir": is_dir}
    card = empty | {"kind": "meta", "meta": meta}
    if not head:
        return card
    if head.startswith(b"%PDF-"):
        return empty | (_pdf(path, limits) or card)
    if b"<svg" in head and mime_of(name) == "image/svg+xml":
        w, h = svg_size(head.decode("utf-8", "ignore"))
        return empty | {"kind": "image", "width": w, "height": h} if s.st_size <= limits.image_bytes else card
    if (size := image_size(head)) and s.st_size <= limits.image_bytes:
        return empty | {"kind": "image", "width": size[0], "height": size[1]}
    if is_audio(name, head):
        return empty | {"kind": "audio", "meta": meta}
    if looks_like_text(head):
        with open(path, "rb") as f:
            body = f.read(limits.text_bytes + 1)
        text = truncate(body, limits.text_bytes)
        return empty | {"kind": "text", "content": text, "truncated": len(body) > limits.text_bytes, "lines": text.count("\n") + (text != "" and not text.endswith("\n"))}
    return card


def svg_size(text: str) -> tuple[int, int]:
    import re

    start = text.find("<svg")
    tag = text[start:].split(">", 1)[0][:2048] if start >= 0 else ""

    def attribute(name: str) -> str | None:
        m = re.search(rf"""\s{name}\s*=\s*(["'])(.*?)\1""", tag, re.S)
        return m[2] if m else None

    def number(x: str | None) -> float | None:
        try:
            return float(re.sub(r"[A-Za-z%]+$", "", (x or "").strip()))
        except ValueError:
            return None

    pixels = lambda v: int(min(max(v, 0), 2**32 - 1))
    w, h = number(attribute("width")), number(attribute("height"))
    if w is None or h is None:
        box = [n for n in map(number, re.split(r"[,\s]+", attribute("viewBox") or "")) if n is not None]
        w, h = box[2:4] if len(box) >= 4 else (0, 0)
    return pixels(w), pixels(h)


def previews(paths: DataFrame, path_col: str = "path", limits: Limits = Limits()) -> DataFrame:
    """(path, preview) for paths that the executors can open."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [{"path": p, **preview(p, limits)} for p in frame["path"]]
            yield pd.DataFrame(rows, columns=["path", "kind", "content", "truncated", "lines", "width", "height", "pages", "meta", "error"])

    return paths.select(paths[path_col].alias("path")).mapInPandas(run, f"path string, {SCHEMA}")
