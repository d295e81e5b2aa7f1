"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records up to a size, and a seek table in a
last, skippable frame (the Zstandard seekable format). The index maps a record to (bundle, frame, offset in the
decompressed frame, length), so one record costs the read of the table and of one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches, met, rows_of, shared_dir, small_batches

# The seekable format's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id string, bundle string, frame long, offset long, length long"


def open_folder(folder: str):
    """(filesystem, path) of a folder that all machines share: a path or a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class BundleWriter:
    """Frames of whole records, and the seek table behind them."""

    def __init__(self, stream, frame_bytes: int, level: int):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record. One larger than a frame's size has a frame for itself."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.squeeze.compress(b"".join(self.held))
            self.stream.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.restore = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = self._at(size - 9 - n * width, n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return self.restore.decompress(self._at(at, packed), max_output_size=plain)


def _name(record_id: str | None) -> str:
    return f"<urn:x-page:{'null' if record_id is None else record_id}>"


def _header(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_header(url)}")
    fields += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    fields += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"] * revisit
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields: id, type, url, digest (hex), refers_to, payload_bytes, payload (None for a revisit). The
    payload is checked against the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}

    def name(field: str) -> str | None:
        got = fields.get(field, "")[len("<urn:x-page:") : -1]
        return None if got in ("", "null") else got

    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
    return {"id": name("warc-record-id"), "type": kind, "url": fields.get("warc-target-uri"), "digest": digest, "refers_to": name("warc-refers-to"), "payload_bytes": int(told["content-length"]), "payload": None if kind == "revisit" else payload}


def plan(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(id, url, payload, digest, refers_to, revisit): of equal payloads of ``least`` bytes or more the one with the
    largest id is a response and the others revisit it. Payloads move only if the digests that occur again are too many
    for a broadcast, and then those of the most frequent ones are dealt out evenly."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    # one small row per digest that occurs again, written so that counting and joining don't read the pages again
    big = pages.where(F.octet_length("payload") >= least)
    again = durable(big.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = met(pages, again, "digest", "n", F.sha1(F.concat_ws("/", "digest", F.col("id").cast("string"), "url")), asks=F.octet_length("payload") >= least)
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    return found.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("keep"))).select("id", "url", "payload", "digest", "refers_to", "revisit")


def write(df: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z", **columns) -> DataFrame:
    """Writes a record for each row and returns the index: ``id`` (string), ``bundle``, ``frame``, ``offset``, ``length``.

    Bundles are files of the shared ``folder`` (default: in spark.checkpoint.dir). A task that is run again writes
    bundles with new names; the index, which is written too, names those of the attempts that count.
    Null html is an empty payload, a null url leaves its header out, a null id is written as such; rows that repeat
    the id and payload of a response are responses too. Other columns are ignored; an empty table writes nothing.
    """
    import pyarrow as pa

    folder = folder or f"{shared_dir(df.sparkSession).rstrip('/')}/bundles-{uuid.uuid4().hex}"
    schema = pa.schema([("id", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator):
        system, path = open_folder(folder)

        def rows():
            out, written, name = None, 0, ""
            for batch in batches:
                for i, url, payload, digest, refers, revisit in rows_of(batch):
                    if out is None:
                        system.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        out, written = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes, level), 0
                    raw = record(i, url, payload, digest, refers, revisit, date)
                    frame, offset = out.add(raw)
                    written += len(raw)
                    yield i, f"{folder}/{name}", frame, offset, len(raw)
                    if written >= bundle_bytes:
                        out.close()
                        out = None
            if out is not None:
                out.close()

        yield from in_batches(rows(), schema, lambda r: 200)

    planned = plan(small_batches(df), **columns)
    return durable(planned.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).mapInArrow(run, INDEX))


def read(index: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """The records that an index names: ``id``, ``type``, ``url``, ``digest``, ``refers_to``, ``payload_bytes``,
    ``payload`` (binary, null for revisits). Each frame is read and decompressed once by one task; there is a task for
    about ``task_bytes`` of records, and no fewer than shuffles have. An empty index gives no rows."""
    import pyarrow as pa

    schema = pa.schema([("id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator):
        def rows():
            name, reader, at, frame = None, None, None, b""
            for batch in batches:
                for bundle, i, offset, length in rows_of(batch):
                    if bundle != name:
                        if reader is not None:
                            reader.source.close()
                        system, path = open_folder(bundle)
                        name, reader, at = bundle, BundleReader(system.open_input_file(path)), None
                    if i != at:
                        at, frame = i, reader.frame(i)
                    yield tuple(parse(frame[offset : offset + length]).values())
            if reader is not None:
                reader.source.close()

        yield from in_batches(rows(), schema, lambda r: len(r[6] or b"") + 200)

    total = small_batches(index).agg(F.sum("length").alias("n")).first().n or 0
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    frames = index.repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return frames.select("bundle", "frame", "offset", "length").mapInArrow(run, "id string, type string, url string, digest string, refers_to string, payload_bytes long, payload binary")
