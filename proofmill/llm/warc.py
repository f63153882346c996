"""WARC archives: a deduplicating writer and a splittable reader.

Writer: one gzip member per record, one archive per task. Of records with equal payloads (SHA-1) the one with the smallest id is a response,
the others revisit it: their block holds the HTTP header only. A task names its archive at random and reports it in a table that Spark
commits; archives that are not in that table (of failed or repeated attempts) are never read.

Reader: archives are cut into byte ranges, each a task's work. A task looks for the gzip magic from the start of its range, takes a candidate
for a member only if it inflates to a WARC header, and owns the records that start inside its range; the last may end beyond it. After
a record the next member follows at once, so only the first of a range, or one after damage, is searched. Our members carry their offset
in a gzip extra field, so that an archive inside a payload is not mistaken for records of the outer one; other archives are read
without it. Payloads are hashed as they stream; unless they are asked for, a task never holds one.

Defined results: a null payload is empty; a null url is written as "unknown:"; a null id has none, goes first nowhere, and revisits an equal
payload that has an id; payloads below `min_bytes` are all responses; rows with equal ids and payloads are all alike; an empty table
gives an archive folder without archives; damaged stretches of an archive are skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.common import working_path, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32_000_000
READ_BYTES = 1 << 16
#: A WARC and an HTTP header together must fit in here; a candidate with a longer one is no record.
HEADER_BYTES = 1 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
URN = "urn:proofmill:record:"
RECORD_SCHEMA = "archive string, offset bigint, record_type string, id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"


def opened(uri: str):
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_first(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, first): first is the response's id where the row revisits an equal payload, otherwise null.

    The smallest id of each payload is aggregated before the shuffle; rows meet it under a salt, so that a payload held by a third of all rows spreads.
    """
    rows = pages.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.join(shared, ["digest", "salt"], "left")
    return met.select("id", "url", "payload", F.when(F.coalesce(F.col("id") != F.col("first"), F.lit(True)), F.col("first")).alias("first"))


def member(record: bytes, offset: int) -> bytes:
    """A gzip member that names its own offset in an extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    extra = b"PO" + struct.pack("<HQ", 8, offset)
    head = MAGIC + b"\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + deflate.compress(record) + deflate.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row_id, url, payload: bytes, first) -> bytes:
    """A response or revisit record with its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:"
    lines = ["WARC/1.0", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if row_id is None else row_id}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <{URN}{first}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the archives below a shared folder; returns (archive, bytes, records) of those that count."""
    named = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = with_first(named, "id", "payload", min_bytes).withColumn("id", F.col("id").cast("string")).withColumn("first", F.col("first").cast("string"))

    def write(batches):
        out, path, size, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            if out is None and len(batch):
                system, place = opened(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place, compression=None)
            for row_id, url, payload, first in zip(*(batch[c] for c in ("id", "url", "payload", "first"))):
                data = member(record(row_id, url, payload, first), size)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [path], "bytes": [size], "records": [n]})

    return written(rows.mapInPandas(write, "archive string, bytes bigint, records bigint"), "archives")


class Stream:
    """Bytes of an archive from an offset on, read in pieces as far as they are asked for; what was dropped is read again if need be."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.base, self.buffer = source, size, at, bytearray()
        source.seek(at)

    def more(self) -> bytes:
        piece = self.source.read(min(READ_BYTES, max(0, self.size - self.base - len(self.buffer))))
        self.buffer += piece
        return piece

    def at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from an offset."""
        if not self.base <= offset <= self.base + len(self.buffer):
            self.base, self.buffer = offset, bytearray()
            self.source.seek(offset)
        while self.base + len(self.buffer) < offset + n and self.more():
            pass
        return bytes(self.buffer[offset - self.base : offset - self.base + n])

    def drop(self, offset: int) -> None:
        """Forget what lies before the offset."""
        if offset - self.base > 16 * READ_BYTES:
            del self.buffer[: offset - self.base]
            self.base = offset


def foreign_offset(head: bytes) -> int | None:
    """The offset that a member's extra field names, if it has one."""
    if len(head) >= 24 and head[3] & 4:
        extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
        if extra[:2] == b"PO" and len(extra) >= 12:
            return struct.unpack("<Q", extra[4:12])[0]
    return None


def read_member(stream: Stream, offset: int, keep: bool) -> tuple[dict, int] | None:
    """(record, offset after the member) if a whole record starts at the offset, otherwise None."""
    named = foreign_offset(stream.at(offset, 64))
    if named is not None and named != offset:
        return None
    inflate, at = zlib.decompressobj(31), offset
    head, fields, http, hashed, length, kept = b"", None, None, hashlib.sha1(), 0, []
    left = None  # bytes of the block that are still to come
    try:
        while not inflate.eof:
            data = stream.at(at, READ_BYTES)
            if not data:
                return None
            text = inflate.decompress(data)
            at += len(data)
            if fields is not None:  # a record by its headers: the bytes before are hardly needed again
                stream.drop(at)
            if http is None:
                head += text
                if fields is None:
                    if not head.startswith(b"WARC/1.") and len(head) >= 7:
                        return None
                    if b"\r\n\r\n" not in head:
                        if len(head) > HEADER_BYTES:
                            return None
                        continue
                    first, _, head = head.partition(b"\r\n\r\n")
                    fields = fields_of(first)
                    left = int(fields["content-length"])
                if "application/http" not in fields.get("content-type", ""):
                    http, text = {}, head
                elif b"\r\n\r\n" in head[:left]:
                    first, _, text = head.partition(b"\r\n\r\n")
                    http = fields_of(first)
                    left -= len(first) + 4
                elif len(head) >= min(left, HEADER_BYTES):
                    return None
                else:
                    continue
            text = text[:left]
            left -= len(text)
            hashed.update(text)
            length += len(text)
            if keep:
                kept.append(text)
    except (zlib.error, KeyError, ValueError):
        return None
    if fields is None or http is None or left:
        return None
    revisit = fields.get("warc-type") == "revisit"
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    own = base64.b32encode(hashed.digest()).decode()
    found = {
        "offset": offset, "record_type": fields.get("warc-type"), "id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
        "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": int(http.get("content-length", length)) if revisit else length,
        "payload_digest": told if revisit else own, "digest_ok": None if revisit or told is None else told == own, "payload": b"".join(kept) if keep and not revisit else None,
    }
    return found, at - len(inflate.unused_data)


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if re.fullmatch("-?[0-9]+", digits) else None


def records_in(uri: str, size: int, start: int, end: int, keep: bool):
    """Records that start in [start, end) of an archive."""
    system, place = opened(uri)
    with system.open_input_file(place) as source:
        stream = Stream(source, size, start)
        at = start
        while at < end:
            stream.drop(at)
            window = stream.at(at, READ_BYTES)
            found = window.find(MAGIC)
            if found < 0:
                if len(window) < len(MAGIC):
                    return
                at += len(window) - len(MAGIC) + 1
                continue
            at += found
            if at >= end:
                return
            got = read_member(stream, at, keep)
            if got is None:
                at += 1
            else:
                yield {"archive": uri} | got[0]
                at = got[1]


def read_archives(spark: SparkSession, archives: DataFrame, keep_payloads: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives (archive, bytes), cut into ranges of range_bytes."""
    ranges = archives.where("bytes > 0").select("archive", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    names = [x.partition(" ")[0] for x in RECORD_SCHEMA.split(", ")]

    def read(batches):
        for batch in batches:
            for uri, size, start in zip(batch["archive"], batch["bytes"].tolist(), batch["start"].tolist()):
                held, total = [], 0
                for r in records_in(uri, size, start, min(size, start + range_bytes), keep_payloads):
                    held.append(r)
                    total += 1000 + len(r["payload"] or b"")
                    if total > 8_000_000:
                        yield framed(held, names)
                        held, total = [], 0
                yield framed(held, names)

    return ranges.repartition(max(spark.sparkContext.defaultParallelism, 1), "archive", "start").mapInPandas(read, RECORD_SCHEMA)


def framed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("id", "refers_to", "offset", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame


def archive_folder(spark: SparkSession) -> str:
    return working_path(spark, "warc")
