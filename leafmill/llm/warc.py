"""WARC archives: a writer with identical-payload revisits, and a salvage reader.

Each record is one gzip member. Tasks write bounded files into the shared folder under names of their own;
the list of files that finished tasks report is what counts, so the leavings of a lost or repeated task are never
read. The reader checks every member and record. After a failed check it searches for the next valid gzip member or version line,
goes on from there, and reports the bytes in between as a quarantined gap. Inside a member it goes on the same way in the unpacked
octets; of a damaged member, what was unpacked before the damage is read too, and records with a digest that holds are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_rows, map_arrow, release, sliced, written
from leafmill.session import scratch_path

REVISIT_FROM = 100  # octets; smaller payloads are always stored
FILE_BYTES = 4_000_000

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_URI_SAFE = "%/:?#[]@!$&'()*+,;=~"

RECORDS = (
    "path string, start long, length long, gap string, record_type string, record_id string, refers_to string, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=_URI_SAFE)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first) of the pages whose payload an earlier id has. Only ids and digests are shuffled."""
    slim = pages.filter(F.octet_length("html") >= REVISIT_FROM).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"))
    return slim.join(first, "digest").filter("page_id > first").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``; returns (path, records, octets) of the files that count.

    Null html is an empty payload. Of equal payloads of ``REVISIT_FROM`` octets or more, the one of the smallest id
    is a response and the others revisits of it; a row without an id and repeated rows of that id are responses.
    Other columns are ignored; an empty table writes nothing.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.sha2("html", 256))
    earlier = written(_revisits(plain), "revisits")
    release(pages.sparkSession)
    joined = plain.join(earlier, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}")
        store.create_dir(top, recursive=True)
        done: list[tuple] = []
        members: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal members, size
            if members:
                path = f"{top}/part-{uuid.uuid4().hex}.warc.gz"
                with store.open_output_stream(path, compression=None) as out:
                    for member in members:
                        out.write(member)
                done.append((path.rsplit("/", 1)[1], len(members), size))
            members, size = [], 0

        for batch in batches:
            for page_id, url, html, digest, first in arrow_rows(batch, "page_id", "url", "html", "digest", "first"):
                member = zlib.compress(record_of(page_id, url.decode() if url else None, html, digest.decode(), first), 6, wbits=31)
                members.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "octets"])

    return written(map_arrow(joined, write, "path string, records long, octets long"), "manifest")


_FIELD = re.compile(rb"([^\s:]+):[ \t]*(.*?)[ \t]*$")


def _holds(said: str | None, data: bytes) -> bool | None:
    """Whether a digest, hexadecimal or base32 behind the name of its algorithm, is that of ``data``; null without a known algorithm."""
    name, _, value = (said or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    digest, value = hashlib.new(name, data).digest(), value.strip()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse_record(data: bytes, at: int, proven: bool = False) -> tuple[dict, int]:
    """The record that begins at ``at`` and where it ends; ValueError if a check fails, or if its block digest cannot be checked
    and it must be ``proven``."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("no end of the header")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        found = _FIELD.match(line)
        if not found:
            raise ValueError("bad header line")
        fields[found[1].decode("latin-1").lower()] = found[2].decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = data[start:stop]
    holds = [_holds(fields.get("warc-block-digest"), block)]
    if holds[0] is False:
        raise ValueError("wrong block digest")
    kind = fields.get("warc-type")
    http = "application/http" in fields.get("content-type", "application/http" if kind in ("response", "request", "revisit") else "").lower()
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "payload": payload}
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length: *([0-9]+)", head)
        out |= {"payload_bytes": int(length[1]) if length else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, "payload": b""}
    else:
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        holds.append(_holds(fields.get("warc-payload-digest"), payload))
        if holds[1] is False:
            raise ValueError("wrong payload digest")
    if proven and holds[0] is None:
        raise ValueError("no known block digest in a damaged member")
    return out, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The gzip member at ``at`` as far as it unpacks, where that ends, and what is wrong with it, if anything."""
    unpack, parts, step = zlib.decompressobj(wbits=31), [], 1 << 15
    for start in range(at, len(data), step):
        before = unpack.copy()
        try:
            parts.append(unpack.decompress(data[start : start + step]))
        except zlib.error as exc:
            for k in range(start, min(start + step, len(data))):  # up to the octet that fails
                try:
                    parts.append(before.decompress(data[k : k + 1]))
                except zlib.error:
                    return b"".join(parts), k, str(exc)
            return b"".join(parts), min(start + step, len(data)), str(exc)
        if unpack.eof:
            return b"".join(parts), min(start + step, len(data)) - len(unpack.unused_data), None
    return b"".join(parts), len(data), "truncated member"


def _inside(plain: bytes, fault: str | None) -> list[dict | str]:
    """Every valid record of unpacked octets and the reason of every gap between them, in order."""
    out: list[dict | str] = []
    at, lost = 0, False
    while at < len(plain):
        try:
            record, at = parse_record(plain, at, proven=fault not in (None, "truncated member"))
        except ValueError as exc:
            if not lost:
                out.append(str(exc))
            lost = True
            found = _VERSION.search(plain, at + 1)
            at = found.start() if found else len(plain)
            continue
        out.append(record)
        lost = False
    if fault and not lost:
        out.append(fault)
    return out


def _unit(data: bytes, at: int) -> tuple[list[dict | str], int]:
    """What is found in the member, or the plain record, at ``at``, and where it ends; ValueError if that is no record."""
    if data[at : at + 2] != b"\x1f\x8b":
        record, end = parse_record(data, at)
        return [record], end
    plain, end, fault = _member(data, at)
    found = _inside(plain, fault)
    if found and not any(isinstance(x, dict) for x in found):
        raise ValueError(fault or found[0])
    return found, end


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) of every valid record and (start, end, reason) of every gap, in order of the archive.

    Several records or gaps of one member have the member's places. A damaged member ends where it stops unpacking, and a gap at its end
    goes from its start to what is valid next.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = _unit(data, at)
        except ValueError as exc:
            if gap is None:
                gap, reason = at, str(exc)
            after = _NEXT.search(data, at + 1)
            at = after.start() if after else len(data)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        if found and isinstance(found[-1], str):
            gap, reason = at, found.pop()
        for record in found:
            yield at, end, record
        at = end
    if gap is not None:
        yield gap, len(data), reason


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """Every record (gap null) and every quarantined gap (gap has the reason) of the archives in ``folder``.

    ``start`` and ``length`` are places in the file. With a ``manifest`` only its files are read. Payloads are
    left out unless asked for. A file without a valid record is one gap; an empty file gives nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    if manifest is not None:
        listed = manifest.select(F.col("path").alias("name"))
        files = files.withColumn("name", F.substring_index("path", "/", -1)).join(listed, "name", "left_semi").select("path", "content")
    names = [field.split()[0] for field in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            path, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            rows = []
            for start, end, found in salvage(data):
                row = {"path": path, "start": start, "length": end - start} | (found if isinstance(found, dict) else {"gap": found})
                rows.append(row if payloads else row | {"payload": None})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, **columns)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = read_archives(spark, folder, manifest).filter("gap is null")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
