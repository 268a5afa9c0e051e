"""WARC archives: a writer and a salvage reader.

Writer: one gzip member a record, written by Spark's text writer so that it works on any file system that Spark does. The text writer puts a
separator between values; it is an empty gzip member, which decompresses to nothing, so the files are plain multi-member archives.
Of records with equal payloads the one with the smallest page_id is a response and the others revisit it.

Salvage reader: reads members and bare records. Each must pass its checks: gzip CRC and length, version line, headers, content
length, end mark, block digest and payload digest. After a failed check the reader searches the next gzip member or version line that passes,
goes on from there, and logs the bytes between as a gap with its reason. Inside a member it does the same with the decompressed bytes, also
with those that come before a gzip error: every record that passes is given, with the place of its member and its own place (inner_offset, inner_length) in the member; so are the gaps inside.
A member with a gzip error is a gap as a whole besides, up to the next start.

Nulls and edge cases: a null html is an empty payload; a null url gives a record without target; a null page_id gives a record without page id, which is a response only if no equal payload has an id;
repeated rows with the smallest page_id are all responses; empty tables give an empty result; control characters of a url are percent-encoded; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm._store import materialize
from ledgerloom.sources.session import ensure_importable

DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats: an empty gzip member, the gzip magic and the record's end mark.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORDS_PER_FILE = 20_000
LEVEL = 4
SLICE = 1 << 14


def sha1(raw: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as bytes; with refers_to a revisit without its payload."""
    block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else safe_url(url),
        "X-Page-ID": page_id,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, digest),
        "X-Refers-To-Page-ID": refers_to,
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + END


def member(raw: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class Damage(Exception):
    """Why a record failed its checks."""


def parse(raw: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at `at` of raw, and its end."""
    if not (version := VERSION.match(raw, at)):
        raise Damage("no version line")
    if (stop := raw.find(END, at)) < 0:
        raise Damage("headers do not end")
    head: dict[str, str] = {}
    for line in raw[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not {"warc-type", "warc-record-id", "warc-date"} <= head.keys():
        raise Damage("header missing")
    if not head.get("content-length", "").isdigit():
        raise Damage("no content length")
    start = stop + len(END)
    end = start + int(head["content-length"])
    block = raw[start:end]
    if len(block) != end - start:
        raise Damage("block cut short")
    if raw[end : end + len(END)] != END:
        raise Damage("no end mark")
    if (want := head.get("warc-block-digest")) and want.startswith("sha1:") and want[5:] != sha1(block):
        raise Damage("block digest")
    body = block
    if head.get("content-type", "").startswith("application/http") or head["warc-type"] == "response" and block.startswith(b"HTTP/"):
        body = block.partition(END)[2]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "revisit":
        body = b""
    elif digest and head.get("warc-payload-digest", "").startswith("sha1:") and digest != sha1(body):
        raise Damage("payload digest")
    else:
        digest = sha1(body)
    number = lambda name: int(v) if re.fullmatch(r"-?\d+", v := head.get(name, "")) else None
    row = {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "page_id": number("x-page-id"), "payload": body, "payload_bytes": len(body), "payload_digest": digest, "refers_to_id": head.get("warc-refers-to"), "refers_to": number("x-refers-to-page-id")}
    return row, end + len(END)


def unpack(raw: bytes, at: int) -> tuple[bytes, int | None, str | None]:
    """The gzip member that starts at `at`, and its end; after an error what comes before it, None and the reason."""
    engine, out, begin = zlib.decompressobj(31), [], at
    try:
        while not engine.eof and at < len(raw):  # in slices: what follows the member is copied
            out.append(engine.decompress(raw[at : at + SLICE]))
            at += SLICE
    except zlib.error as e:
        engine = zlib.decompressobj(31)  # the slice that fails once more, byte by byte, for what it gives until then
        for i in range(begin, at, SLICE):
            engine.decompress(raw[i : i + SLICE])
        try:
            for i in range(at, len(raw)):
                out.append(engine.decompress(raw[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out), None, "gzip: " + str(e).split(":")[-1].strip()
    if not engine.eof:
        return b"".join(out), None, "gzip member cut short"
    return b"".join(out), min(at, len(raw)) - len(engine.unused_data), None


def inside(raw: bytes) -> Iterator[dict]:
    """Records and gaps of the decompressed bytes of a member, in order."""
    at = 0
    while at < len(raw):
        try:
            row, end = parse(raw, at)
        except Damage as damage:
            begin, at, end, row = at, len(raw), len(raw), None
            for found in VERSION.finditer(raw, begin + 1):
                try:
                    row, end = parse(raw, found.start())
                    at = found.start()
                    break
                except Damage:
                    continue
            yield {"kind": "gap", "inner_offset": begin, "inner_length": at - begin, "reason": str(damage)}
        if row is not None:
            yield row | {"kind": "record", "inner_offset": at, "inner_length": end - at}
        at = end


def read_at(raw: bytes, at: int) -> tuple[list[dict], int | None, str | None]:
    """All records and inner gaps of the member at `at`, or the bare record there, and where it ends; if that can't be told, None and the reason."""
    if not raw.startswith(MAGIC, at):
        try:
            row, end = parse(raw, at)
        except Damage as damage:
            return [], None, str(damage)
        return [row | {"kind": "record"}], end, None
    inner, end, reason = unpack(raw, at)
    rows = list(inside(inner))
    if end is None and not any(r["kind"] == "record" for r in rows):
        rows = []
    return rows, end, reason


def salvage(raw: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order; together they account for every byte."""
    at, known = 0, None
    while at < len(raw):
        rows, end, reason = known or read_at(raw, at)
        known = None
        if end is None:
            end, after = len(raw), at + 1
            while found := START.search(raw, after):  # the next start that has something to give
                after = found.start() + 1
                trial = read_at(raw, found.start())
                if trial[0] or trial[1] is not None:
                    end, known = found.start(), trial
                    break
            yield {"kind": "gap", "offset": at, "length": end - at, "reason": reason}
        for row in rows:
            yield row | {"offset": at, "length": end - at}
        at = end


FIELDS = {"path": pa.string(), "kind": pa.string(), "offset": pa.int64(), "length": pa.int64(), "inner_offset": pa.int64(), "inner_length": pa.int64(), "reason": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
DDL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind record and gap of all archive files under path. A file is read whole by one task."""
    ensure_importable(spark)
    fields = {k: v for k, v in FIELDS.items() if with_payload or k != "payload"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, found, held = batch.column(0)[i].as_py(), [], 0
                for row in salvage(batch.column(1)[i].as_py()):
                    found.append({"path": name} | (row if with_payload else row | {"payload": None}))
                    held += row.get("payload_bytes", 0) * with_payload + 1000
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(found, pa.schema(list(fields.items())))
                        found, held = [], 0
                yield pa.RecordBatch.from_pylist(found, pa.schema(list(fields.items())))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{k} {DDL[v]}" for k, v in fields.items()))


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """digest, first: the smallest page_id of each payload of min_bytes or more that several rows have."""
    ensure_importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sha1(x) if len(x) >= min_bytes else None for x in raw], pa.string())], ["page_id", "digest"])

    digests = pages.select("page_id", "html").mapInArrow(run, "page_id long, digest string").where("digest is not null")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return groups.where("n > 1 and first is not null").select("digest", "first")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record of each row (page_id, url, html) under path."""
    ensure_importable(pages.sparkSession)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sha1(x) for x in raw], pa.string())], ["page_id", "url", "html", "digest"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                page_id, url, html, digest, first = (whole.slice(at, 500).column(i) for i in range(5))
                raw = [x or b"" for x in html.cast(pa.large_binary()).to_pylist()]
                out = []
                for p, u, x, d, f in zip(page_id.to_pylist(), url.to_pylist(), raw, digest.to_pylist(), first.to_pylist()):
                    out.append(member(record(p, u, x, d, None if f is None or len(x) < min_bytes or f == p else f)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # few or small groups make Spark broadcast them; else the payloads are joined by digest, large groups split
    groups = materialize(first_copies(pages, min_bytes), "warc-groups", lean=True)
    rows = pages.select("page_id", "url", "html").mapInArrow(digested, "page_id long, url string, html string, digest string").join(groups, "digest", "left")
    members = rows.select("page_id", "url", "html", "digest", "first").mapInArrow(built, "value binary").select(F.col("value").cast("string"))
    separator = EMPTY_MEMBER.decode("iso-8859-1")
    members.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def resolved(records: DataFrame) -> DataFrame:
    """Records of an archive with the size of the payload that a revisit refers to."""
    own = records.where("kind = 'record'")
    sizes = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("payload_bytes").alias("_full"))
    revisits = own.where("record_type = 'revisit'").join(sizes, "refers_to_id", "left").withColumn("payload_bytes", F.col("_full")).drop("_full")
    return own.where("record_type != 'revisit'").unionByName(revisits)
