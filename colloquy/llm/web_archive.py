"""Conversion of legacy ARC archives to WARC, and reading WARC archives back.

An ARC file starts with a ``filedesc://`` record whose second line gives the version and whose third line names the
fields of the URL lines that follow: version 1 has 5 of them, version 2 has 10. Each record is a URL line, then as
many bytes as its last field declares, then a line end. The converter reads URL lines by the fields of their version
and payloads by their declared lengths; it never searches payloads for markers. For each record it makes:

- WARC-Record-ID: a name-based UUID of URL, date and payload digest, so that converting again gives the same id;
- WARC-Date: the 14-digit ARC date as an ISO timestamp;
- WARC-Type: ``response``, or ``revisit`` for a record whose payload another record of the same conversion holds;
- WARC-Payload-Digest: SHA-1 in base 32, of the bytes after the HTTP header; WARC-Block-Digest of the whole block.

Archives hold one gzip member a record, a warcinfo record first, and at most FILE_BYTES of compressed bytes (a larger
record has a file of its own). They are written with Spark's text writer, one archive a row, so that they land wherever
Spark can write, and read back with ``binaryFile``, member by member.

Payloads are equal if their SHA-256 digests are. A record that surely has no copy is written where it is; of the others,
only headers are joined, and payloads of those that stay responses are moved.

Defined cases: a null or empty payload is a response of 0 bytes. Payloads under ``min_bytes`` are never revisits.
Of equal payloads, the row with the largest id stays a response. Rows that repeat an id and payload all become
responses. A record with a damaged URL line or fewer bytes than declared raises an error that names it. An empty
table gives an empty result. Other columns than id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import folders_named, materialise, new_path, release, salted_join, whole_ids
from colloquy.llm.exact_dedup import filter_words, passes_filter

# Fixed by the ARC format: field names of the URL lines of its two versions.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
# Fixed by the WARC format.
SEPARATOR = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000
#: Compressed bytes of an archive.
FILE_BYTES = 8 << 20
#: Rows that are Python objects at once.
SLICE = 512
#: Name space of the record ids.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = pa.schema([("version", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("block", pa.binary())])
RECORD_DDL = "version string, url string, ip string, date string, content_type string, block binary"


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file's bytes (gzip members or plain)."""
    content = inflated(content)
    line, at = _line(content, 0)
    if not line.startswith(b"filedesc://"):
        raise ValueError("an ARC file starts with a filedesc record")
    size = int(line.rsplit(b" ", 1)[-1])
    version = _line(content, at)[0].split(b" ")[0].decode()
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    fields, at = ARC_FIELDS[version], at + size + 1
    while at < len(content):
        line, at = _line(content, at)
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if len(values) < len(fields) or not values[-1].isdigit():
            raise ValueError(f"bad ARC URL line {line[:200]!r}")
        # a URL may hold spaces: the other fields are counted from the end
        extra = len(values) - len(fields)
        values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        named = dict(zip(fields, values, strict=True))
        size = int(named["Archive-length"])
        if at + size > len(content):
            raise ValueError(f"ARC record {named['URL'][:200]!r} declares {size} bytes; {len(content) - at} are left")
        yield {"version": version, "url": named["URL"], "ip": named["IP-address"], "date": named["Archive-date"], "content_type": named["Content-type"], "block": content[at : at + size]}
        at += size + 1


def _line(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\n", at)
    end = len(content) if end < 0 else end
    return content[at:end].rstrip(b"\r"), end + 1


def inflated_parts(content: bytes) -> Iterator[bytes]:
    """The bytes of gzip members, or of plain content, in parts of about a megabyte."""
    size = 1 << 20
    if content[:2] != b"\x1f\x8b":
        yield from (content[a : a + size] for a in range(0, len(content), size))
        return
    at, end = 0, len(content.rstrip(b"\0")) if content.endswith(b"\0" * 9) else len(content)
    while at < end:
        member = zlib.decompressobj(31)
        while not member.eof and at < end:
            piece = content[at : at + 65536]
            out = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if out:
                yield out
        if not member.eof:
            raise ValueError("a gzip member is cut short")


def inflated(content: bytes) -> bytes:
    return b"".join(inflated_parts(content))


def read_arc(archives: DataFrame, column: str = "content") -> DataFrame:
    """Rows of whole ARC files in a binary column to rows of records, handed on about 4 MB at a time."""

    def run(batches):
        rows, size = [], 0
        for content in (c for batch in batches for c in batch.column(0)):
            for record in parse_arc(content.as_py()):
                rows.append(record)
                size += len(record["block"])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    return archives.select(column).mapInArrow(run, RECORD_DDL)


def arc_file(name: str, version: str, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, date, content type, block) records."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 local\n{' '.join(fields)}\n".encode()
    filler = ["200", "-", "-", "0", name] if version == "2" else []

    def line(url: str, ip: str, date: str, kind: str, size: int) -> bytes:
        return " ".join([url, ip, date, kind, *filler, str(size)]).encode() + b"\n"

    out = [line(f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about)), about, b"\n"]
    for url, ip, date, kind, block in records:
        out += [line(url.replace("\n", "%0A").replace("\r", "%0D") or "-", ip, date, kind, len(block)), block, b"\n"]
    return b"".join(out)


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Web pages as small legacy archives: one ARC file per row of the result, of version 1 or 2 by the page's id.

    The page's id travels in an HTTP header field of the block.
    """

    def run(batches):
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            files = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                named = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode()
                date = f"{1996 + (page or 0) % 10:04d}0102030405"
                files.append(arc_file(f"page-{page}.arc", "1" if (page or 0) % 2 else "2", [(url or "-", "0.0.0.0", date, "text/html", head + payload)]))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["content"])

    return pages.select(whole_ids(pages, id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, "content binary")


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its empty line, payload); a block without a header is all payload."""
    if block.startswith(b"HTTP/"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def described(records: DataFrame) -> DataFrame:
    """ARC records with what WARC headers need: page_id, http, payload, payload_digest (hex SHA-1), payload_key (SHA-256), payload_bytes, record_id."""
    columns = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_key", pa.string()), ("record_id", pa.string()), ("http", pa.binary()), ("payload", pa.binary())]

    def run(batches):
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            rows = batch.to_pylist()
            new = []
            for r in rows:
                http, payload = split_block(r["block"])
                digest = hashlib.sha1(payload).hexdigest()
                page = next((int(x[10:]) for x in http.split(b"\r\n") if x[:10].lower() == b"x-page-id:"), None)
                new.append({"page_id": page, "payload_bytes": len(payload), "payload_digest": digest, "payload_key": hashlib.sha256(payload).hexdigest(), "record_id": record_id(r["url"], r["date"], page, digest), "http": http, "payload": payload})
            made = pa.RecordBatch.from_pylist(new, pa.schema(columns))
            yield pa.RecordBatch.from_arrays([*made.columns, *(batch.column(c) for c in ("url", "ip", "date", "content_type"))], [*(c for c, _ in columns), "url", "ip", "date", "content_type"])

    return records.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, payload_key string, record_id string, http binary, payload binary, url string, ip string, date string, content_type string")


def record_id(url: str, date: str, page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page} {digest}')}>"


def warc_record(r: dict, version: str = "1.1") -> bytes:
    """The bytes of one WARC record, without the separator that ends it. r: a row of described(), with refers_to, refers_id."""
    revisit = r["refers_to"] is not None
    date = r["date"]
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = r["http"] if revisit else r["http"] + r["payload"]
    head = [
        f"WARC/{version}",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-Date: {iso}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{base32(r['payload_digest'])}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response" if r["http"] else f"Content-Type: {r['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {r['refers_id']}", f"WARC-Truncated: length\r\nX-Refers-To-Page: {r['refers_to']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def convert(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """ARC records (read_arc) to rows of WARC records: record binary.

    Of equal payloads of min_bytes or more, the record with the largest page_id keeps its payload.
    """
    full = materialise(described(records), "arc-records")
    kept = full.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_key").agg(F.max("page_id").alias("keep"), F.max_by("record_id", "page_id").alias("refers_id"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    kept = materialise(kept, "kept-payloads")
    known = filter_words(kept.select(F.col("payload_key").alias("digest")))
    none = {"refers_to": F.lit(None).cast("long"), "refers_id": F.lit(None).cast("string")}
    alone = passes_filter(full.withColumn("digest", F.col("payload_key")), known, inverse=True).drop("digest").withColumns(none)
    some = passes_filter(full.withColumn("digest", F.col("payload_key")), known).drop("digest")
    heads = materialise(salted_join(some.drop("payload"), kept, ["payload_key"], ["record_id"], "left"), "record-heads")
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id"))
    revisits = heads.filter(revisit).withColumn("refers_to", F.col("keep")).withColumn("payload", F.lit(None).cast("binary")).drop("keep")
    stay = heads.filter(~revisit).select("record_id").distinct()
    bodies = passes_filter(some.withColumn("digest", F.col("record_id")), filter_words(stay.select(F.col("record_id").alias("digest")))).drop("digest").join(stay, "record_id", "left_semi").withColumns(none)

    def run(batches):
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in batch.to_pylist()], pa.binary())], ["record"])

    return alone.unionByName(revisits).unionByName(bodies).mapInArrow(run, "record binary")


def warc_info(number: str) -> bytes:
    """The record that opens an archive. Its id and date follow from what the archive holds, so that writing again gives the same bytes."""
    block = b"software: colloquy\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'warcinfo {number}')}>", "WARC-Date: 1996-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def packed(records: Iterator[bytes], file_bytes: int = FILE_BYTES) -> Iterator[bytes]:
    """Archives of WARC records: gzip members, a warcinfo record first.

    The last byte of an archive is the highest one of its last member's length, 0 for a member under 16 MB; an empty
    member follows a larger one.
    """

    def member(record: bytes) -> bytes:
        return gzip.compress(record + SEPARATOR, mtime=0)

    held, size, last = [], 0, 0

    def archive() -> bytes:
        first = member(warc_info(hashlib.sha1(held[0]).hexdigest()))
        return b"".join([first, *held, *([gzip.compress(b"", mtime=0)] if last >= 1 << 24 else [])])

    for record in records:
        held.append(member(record))
        size, last = size + len(held[-1]), len(record) + len(SEPARATOR)
        if size >= file_bytes:
            yield archive()
            held, size = [], 0
    if held:
        yield archive()


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write WARC records as archives of one gzip member a record."""

    def run(batches):
        for archive in packed((r.as_py() for batch in batches for r in batch.column(0)), file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive[:-1]], pa.binary())], ["archive"])

    # the bytes pass through a string column unchanged: neither the cast nor the writer looks at them; the end of line is the byte that was taken off
    writer = records.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value")).write
    writer.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file's bytes, which are inflated as far as needed."""
    held, at = bytearray(), 0
    for part in inflated_parts(content):
        held += part
        while (end := held.find(b"\r\n\r\n")) >= 0:
            if not held.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            pairs = (line.partition(":") for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:])
            fields = {name.lower(): value.strip() for name, _, value in pairs}
            size = int(fields["content-length"])
            if len(held) < end + 8 + size:
                break
            if held[end + 4 + size : end + 8 + size] != SEPARATOR:
                raise ValueError(f"WARC record {fields.get('warc-record-id')} is not {size} bytes long")
            yield fields, bytes(held[end + 4 : end + 4 + size])
            del held[: end + 8 + size]
            at += end + 8 + size
    if held:
        raise ValueError(f"a WARC record at byte {at} is cut short")


def read_warc(spark, path: str) -> DataFrame:
    """The records of the archives below path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, date.

    Length and digest are taken from the payload itself; those of a revisit from its headers, which describe the full payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())])

    def row(fields: dict[str, str], block: bytes) -> dict:
        http, payload = split_block(block)
        inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        size, kind = len(payload), fields["warc-type"]
        if kind == "revisit":
            size = int(inner["content-length"])
        elif hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
        page, to = inner.get("x-page-id"), fields.get("x-refers-to-page")
        return {"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": to and int(to), "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "date": fields.get("warc-date")}

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = (row(*r) for r in parse_warc(content.as_py()) if r[0].get("warc-type") in ("response", "revisit"))
                while some := list(itertools.islice(rows, SLICE)):
                    yield pa.RecordBatch.from_pylist(some, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages through a legacy archive and the converter to WARC files in the shared folder, and read back."""
    since = folders_named()
    path = new_path(pages.sparkSession, "warc")
    write_warc(convert(read_arc(pages_as_arc(pages)), min_bytes), path)
    release(pages.sparkSession, since, path)
    return read_warc(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")
