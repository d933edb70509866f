"""WARC archives: a writer with revisit records, and a reader that salvages what it can.

Each record is a gzip member of its own. The reader checks lengths, check sums and digests; after a failed check it
looks for the next valid member or version line, goes on from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import place, small_batches, staged

#: Bytes of the smallest payload that others revisit.
LEAST = 100
#: Bytes of a row of the writer, or one record; rows of an archive, which is read as one value.
ROW_BYTES, ROWS = 4 << 20, 8
#: Payloads of more rows than the larger of these, the second as a share of all rows that repeat, are joined by broadcast: 10,000 payloads at most.
HOT_ROWS, HOT_SHARE = 1000, 10_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: A member without content: its last byte is 0.
EMPTY = zlib.compressobj(wbits=31).flush()
PIECE = 1 << 14

RECORDS = "archive string, start bigint, end bigint, page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, reason string, member bigint"


# --- writing


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(value: str | None) -> str | None:
    return unquote(value[len("<urn:page:") : -1]) if value and value.startswith("<urn:page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit without."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: quote(m[0]), url)))
    if revisit:
        fields += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress(content) + z.flush()


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, size, first (the smallest page_id of an equal payload that others revisit), revisit.

    Where rows share that page_id all of them are responses; where a payload has no page_id at all, so are its rows. Payloads of many rows go by broadcast, the others by one shuffle on their
    digest, which deals rows that need no partner evenly.
    """
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = staged(shared, "shared")
    hot = max(HOT_ROWS, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    top = shared.where(F.col("n") > hot).select("digest", F.col("first").alias("hot"))
    rows = rows.join(F.broadcast(top), "digest", "left")
    alone = F.col("hot").isNotNull() | (F.col("size") < least)
    rows = rows.withColumn("key", F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url", F.rand(7)).cast("string"))).otherwise(F.col("digest")))
    rest = shared.where(F.col("n") <= hot).select(F.col("digest").alias("key"), F.col("first").alias("cold"))
    first = F.when(F.col("size") >= least, F.coalesce("hot", "cold"))
    return rows.join(rest, "key", "left").withColumn("first", first).withColumn("revisit", F.expr("first is not null and not (page_id <=> first)")).select("page_id", "url", "payload", "digest", "size", "first", "revisit")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, compress: bool = True) -> None:
    """A record for each row of pages (page_id, url, html) in archives under path.

    Of equal payloads of at least so many bytes that with the smallest page_id is a response with its payload, the others are revisits. A null html is an empty payload, a null url gives no
    target, a null page_id a record without a page. White space and controls of an url are percent-encoded. Spark's own writer puts the bytes there, so any file system it knows will do.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            whole = b"".join(held)
            if compress and whole[-1]:
                whole += EMPTY
            # the writer ends a row with the byte that is cut off here
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.large_binary())], names=["data"])

        for batch in batches:
            for k in range(batch.num_rows):
                made = record(*(batch.column(i)[k].as_py() for i in range(6)))
                held.append(member(made) if compress else made)
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    found = with_revisits(pages, least)
    found = found.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", "digest", F.col("first").cast("string"), "revisit")
    data = found.mapInArrow(run, "data binary").select(F.col("data").cast("string"))
    data.write.option("lineSep", "\x00" if compress else "\n").option("maxRecordsPerFile", ROWS).text(path)


# --- reading


class Damaged(Exception):
    """A check failed."""


@dataclass
class Found:
    """A record of bytes start to end of the archive, or a gap (a reason is given). Inside a member that starts at ``member``, a gap's places are in its content."""

    start: int
    end: int
    fields: dict[str, str] | None = None
    payload: bytes | None = None
    reason: str | None = None
    member: int | None = None


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the member at a place; its check sum and length are tested."""
    z, out, upto = zlib.decompressobj(wbits=31), [], at
    try:
        while not z.eof and upto < len(data):
            out.append(z.decompress(data[upto : upto + PIECE]))
            upto = min(upto + PIECE, len(data))
    except zlib.error as e:
        raise Damaged(f"member: {e}") from e
    if not z.eof:
        raise Damaged("member: cut short")
    return b"".join(out), upto - len(z.unused_data)


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and end of the record at a place; its length and digests are tested."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", version.end() - 2)
    if head < 0:
        raise Damaged("header: cut short")
    fields: dict[str, str] = {}
    try:
        for line in data[version.end() : head].decode().split("\r\n"):
            name, sign, value = line.partition(":")
            name = name.strip().lower()
            if not sign or CONTROL.search(line) or (name in fields and name != "warc-concurrent-to"):
                raise Damaged("header: a line that can't be")
            fields[name] = value.strip(" \t")
    except UnicodeDecodeError as e:
        raise Damaged("header: not UTF-8") from e
    if not NEEDED <= fields.keys():
        raise Damaged("header: a field is missing")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Damaged("header: no length")
    start, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block: no end where its length says")
    block = data[start:end]
    if not agrees(fields.get("warc-block-digest"), block):
        raise Damaged("block: digest differs")
    parted = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -4
    payload = block[parted + 4 :] if parted != -1 else b""
    if fields.get("warc-type") != "revisit" and not agrees(fields.get("warc-payload-digest"), payload):
        raise Damaged("payload: digest differs")
    return fields, payload, end + 4


def agrees(digest: str | None, data: bytes) -> bool:
    """Whether a digest is that of data; one that is missing or of another kind can't tell."""
    kind, _, value = (digest or "").partition(":")
    return kind.lower() != "sha256" or value.lower() == hashlib.sha256(data).hexdigest()


def salvage(data: bytes, member_at: int | None = None) -> Iterator[Found]:
    """All records of an archive (members, plain records or both) and the gaps between them, in order.

    What follows a failed check is searched for the next member or version line whose checks succeed; a whole record inside the payload of a damaged one is then taken for one of the archive.
    """
    at, bad, why = 0, None, None
    coming = {b"WARC/1.": -1} | ({MAGIC: -1} if member_at is None else {})
    while at < len(data):
        try:
            if member_at is None and data.startswith(MAGIC, at):
                content, end = inflate(data, at)
                found = [Found(at, end, f.fields, f.payload) if f.fields is not None else f for f in salvage(content, at)]
            else:
                fields, payload, end = parse(data, at)
                found = [Found(at, end, fields, payload)]
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            for sign, seen in coming.items():
                if seen <= at:
                    where = data.find(sign, at + 1)
                    coming[sign] = where if where >= 0 else len(data)
            at = min(coming.values())
            continue
        if bad is not None:
            yield Found(bad, at, reason=why, member=member_at)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Found(bad, len(data), reason=why, member=member_at)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives under path.

    A record: archive, start and end (its bytes, those of its member), page_id, url, record_type, refers_to, payload_bytes and payload_digest (of the full payload, as a revisit states them),
    payload (null for revisits and without payloads), reason null. A gap: archive, start, end, reason (the first check that failed there) and, where it lies inside a valid member, that
    member's start; its places are then in the member's content. Records come as often as they are there. Empty archives, and none, give no rows.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for f in salvage(data.as_py()):
                    rows.append(values(archive, f, payloads))
                    size += len(rows[-1]["payload"] or b"") + 500
                    if size >= ROW_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema := schema or arrow_schema())
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema := schema or arrow_schema())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in RECORDS.split(", "))])


def values(archive: str, f: Found, payloads: bool) -> dict:
    row: dict = {"archive": archive, "start": f.start, "end": f.end, "reason": f.reason, "member": f.member, "payload": None}
    if f.fields is None:
        return row
    revisit = f.fields.get("warc-type") == "revisit"
    row |= {"page_id": page_of(f.fields.get("warc-record-id")), "url": f.fields.get("warc-target-uri"), "record_type": f.fields.get("warc-type"), "refers_to": page_of(f.fields.get("warc-refers-to"))}
    if revisit:
        length, digest = f.fields.get("warc-payload-length"), f.fields.get("warc-payload-digest") or ""
        row |= {"payload_bytes": int(length) if length and length.isdigit() else None, "payload_digest": digest.partition(":")[2].lower() or None}
    else:
        row |= {"payload_bytes": len(f.payload), "payload_digest": hashlib.sha256(f.payload).hexdigest(), "payload": f.payload if payloads else None}
    return row


def records(found: DataFrame) -> DataFrame:
    return found.where("reason is null")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined bytes: archive, start, end, member, reason."""
    return found.where("reason is not null").select("archive", "start", "end", "member", "reason")


def archive_report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) into archives and read these back: a row for each record.

    Nulls, equal payloads and rows that share a page_id are as in ``write_archives``; repeated rows are a record each; an empty table gives an empty result; other columns aren't read.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = place(spark, "archives")
    write_archives(pages, path, least)
    found = records(read_archives(spark, path, payloads=False))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
