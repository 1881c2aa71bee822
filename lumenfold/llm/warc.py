"""Web archives: legacy ARC files become WARC records; WARC files are written and read back.

An ARC file starts with a version block that names the fields of its URL records: version 1 has URL, address, date, type and length,
version 2 also status, checksum, location, offset and file name.  Every record is one such line and as many bytes as
it declares.  The converter synthesises what WARC asks for and ARC lacks: record identifiers (UUIDs of URL, date and digest), ISO
timestamps, record types and SHA-256 digests.

WARC files are written by Spark's own text writer, one record a row, parted by the two line ends that end a record; so
a task's file appears only when it is committed, wherever the output is.  That holds for payloads that are text; a
payload that isn't valid UTF-8 is refused.  They are read as binary files and cut by declared lengths alone.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, raw, scratch_dir, small_batches

#: Largest payload of a size class and records in its WARC files at most, so a file that is read back holds about 32 MB or a single record.
SIZE_CLASSES = ((1 << 14, 2_000), (1 << 19, 64), (1 << 23, 4), (1 << 31, 1))
#: Payload bytes from which copies are revisits.
REVISIT_BYTES = 100
#: The ARC URL record fields of each version, and WARC 1.1's names.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GAP = b"\r\n\r\n"

ENTRY = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("http_head", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: str = "1", name: str = "legacy.arc") -> bytes:
    """An ARC file of records (URL, address, 14-digit date, type, content); blanks in fields are encoded, empty ones are ``-``."""
    clean = lambda x: re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", x or "") or "-"
    fields = " ".join(ARC_FIELDS[version])
    block = f"{version} 0 lumenfold\n{fields}\n".encode()

    def line(url: str, address: str, date: str, kind: str, content: bytes, at: int) -> bytes:
        values = {"URL": clean(url), "IP-address": clean(address), "Archive-date": clean(date), "Content-type": clean(kind), "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(at), "Filename": clean(name), "Archive-length": str(len(content))}
        return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n"

    out = [line(f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", block, 0) + block]
    at = len(out[0])
    for record in records:
        made = b"\n" + line(*record, at + 1) + record[4]
        out.append(made)
        at += len(made)
    return b"".join(out) + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and content of each record after the version block, whose version says which fields a line has."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"a record at byte {at} declares {length} bytes and has {len(content)}")
        at = end + 1 + length
        if fields is None:
            version = content.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r} is unknown")
            fields = ARC_FIELDS[version]
            continue
        if len(values) > len(fields):  # blanks in the URL, which stands first
            extra = len(values) - len(fields)
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        yield dict(zip(fields, values, strict=True)), content


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block (with the empty line) and body of an HTTP response; other content is all body."""
    if content.startswith(b"HTTP/"):
        for gap in (_GAP, b"\n\n"):
            if gap in content:
                at = content.index(gap) + len(gap)
                return content[:at], content[at:]
    return b"", content


def _readable(data: bytes, strict: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    try:
        yield from parse_arc(data)
    except ValueError:
        if strict:
            raise


def converted(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """The values of :data:`ENTRY` for each record of an ARC file; if not ``strict``, of those before the first that can't be read."""
    for fields, content in _readable(data, strict):
        head, payload = split_http(content)
        digest = hashlib.sha256(payload).hexdigest()
        d = fields["Archive-date"].ljust(14, "0")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {date} {digest} {hashlib.sha256(head).hexdigest()}")
        kind = "response" if head else ("metadata" if fields["URL"].startswith("dns:") else "resource")
        yield f"<urn:uuid:{name}>", fields["URL"], fields["IP-address"], date, fields["Content-type"], kind, head, payload, digest


_ARROW_ENTRY = pa.schema([(f.name, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string()) for f in ENTRY])


def from_arc(files: DataFrame, content_col: str = "content", *, strict: bool = True, payload: bool = True) -> DataFrame:
    """:data:`ENTRY` columns of the records of ARC files, a file a row (as Spark's binaryFile source gives them); without ``payload`` its size, ``payload_bytes``, instead.

    Null and empty contents have no records; an unknown version or a declared length beyond the file fails, or ends the file if not ``strict``.
    """
    small_batches(files.sparkSession, 64)
    place, schema, arrow = ENTRY.names.index("payload"), ENTRY, _ARROW_ENTRY
    if not payload:
        schema = T.StructType([f if f.name != "payload" else T.StructField("payload_bytes", T.LongType()) for f in ENTRY])
        arrow = _ARROW_ENTRY.set(place, pa.field("payload_bytes", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in raw(batch.column(0)):
                rows = list(converted(data, strict))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    if not payload:
                        columns[place] = [len(x) for x in columns[place]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select(content_col).mapInArrow(run, schema)


def rendered(refers_to: Column, refers_to_uri: Column, marks: dict[str, Column]) -> Column:
    """A WARC record (without the empty lines at its end) from :data:`ENTRY` columns; a revisit of ``refers_to`` keeps its HTTP header only."""
    revisit = F.col("record_type") == "revisit"
    head, body = F.col("http_head").cast("string"), F.when(revisit, "").otherwise(F.col("payload").cast("string"))
    block = F.concat(head, body)
    field = lambda name, value: F.when(value.isNull() | (value == ""), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    http = F.octet_length("http_head") > 0
    parts = [
        F.lit(f"{WARC_VERSION}\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-IP-Address", F.when(F.col("address") != "-", F.col("address"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n")).otherwise(""),
        F.when(revisit, field("WARC-Refers-To", refers_to)).otherwise(""),
        F.when(revisit, field("WARC-Refers-To-Target-URI", refers_to_uri)).otherwise(""),
        *[field(name, value.cast("string")) for name, value in marks.items()],
        field("Content-Type", F.when(http, F.lit("application/http;msgtype=response")).otherwise(F.col("content_type"))),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ]
    return F.concat(*parts)


def write_warc(records: DataFrame, path: str, record_col: str = "record", compression: str = "gzip", file_records: int = SIZE_CLASSES[0][1]) -> None:
    """Writes records (rendered text, null ones left out) as WARC files of at most ``file_records`` each, compressed as a whole and fast (or ``none``), to a new folder or beside older ones."""
    whole = records.select(F.col(record_col).alias("value")).where("value is not null")
    whole.write.mode("append").option("lineSep", _GAP.decode()).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", file_records).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file, gzipped or not, cut by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(_GAP, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {name: value.strip() for name, _, value in (x.partition(":") for x in lines)}
        begin = end + len(_GAP)
        stop = begin + int(head["Content-Length"])
        if data[stop : stop + 4] != _GAP:
            raise ValueError(f"the record at byte {at} isn't as long as it declares")
        yield head, data[begin:stop]
        at = stop + 4


def read_warc(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``headers`` (a map) and ``block`` of each record of WARC files, a file a row; null and empty files have none."""
    small_batches(files.sparkSession, 16)
    schema = T.StructType([T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType())])
    kinds = (pa.map_(pa.string(), pa.string()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in raw(batch.column(0)):
                heads, blocks = [], []
                for head, block in parse_warc(data):
                    heads.append(list(head.items()))
                    blocks.append(block)
                if heads:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((heads, blocks), kinds, strict=True)], names=schema.names)

    return files.select(content_col).mapInArrow(run, schema)


def pages_as_arc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Legacy archives of pages, ``content`` binary: versions by turns, an HTTP response a record that also carries the page's id."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                records = []
                for page, url, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), raw(some.column(2)), strict=True):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page: {'' if page is None else page}\r\nContent-Length: {len(html)}\r\n\r\n"
                    records.append((url or "", "192.0.2.1", "20240101000000", "text/html", head.encode() + html))
                yield pa.RecordBatch.from_arrays([pa.array([arc_file(records, str(1 + (k + at // 250) % 2))], pa.binary())], names=["content"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, "content binary")


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Pages through ARC and WARC files and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri``.

    Of records with equal payloads of at least :data:`REVISIT_BYTES` bytes the one with the smallest page id is a response and the others revisit it; all
    smaller ones are responses.  Null html is an empty payload, null URLs are ``-``.  Of rows that repeat the smallest id those of the first URL are responses, all of them if that is the same too.
    Pages with a null id are always responses.  The files stay at ``path`` (by default a new folder in the shared one).
    """
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark).rstrip('/')}/lumenfold-scratch/warc-{uuid.uuid4().hex}"

    def entries(some: DataFrame, payload: bool = True) -> DataFrame:
        told = from_arc(pages_as_arc(some, id_col=id_col, url_col=url_col, html_col=html_col), payload=payload)
        told = told.withColumn("page", F.expr(r"try_cast(regexp_extract(cast(http_head as string), 'X-Page: (-?\\d*)', 1) as bigint)")).withColumn("size", F.octet_length("payload") if payload else F.col("payload_bytes"))
        return told.withColumn("alike", F.when((F.col("size") >= REVISIT_BYTES) & F.col("page").isNotNull(), F.col("payload_digest")))

    alike = entries(pages, payload=False).where("alike is not null").groupBy("alike").agg(F.min(F.struct("page", "uri", "record_id")).alias("first"), F.count("*").alias("n"))
    first = checkpointed(alike.where("n > 1").select(F.col("alike").alias("same"), "first"))
    size, least, of_class = F.coalesce(F.octet_length(F.col(html_col).cast("string")), F.lit(0)), -1, []
    for most, _ in SIZE_CLASSES:
        of_class.append((size > least) & (size <= most))
        least = most
    held = pages.agg(*[F.count_if(c) for c in of_class]).head()
    for k, (_, file_records) in enumerate(SIZE_CLASSES):
        if k and not held[k]:
            continue
        told = entries(pages.where(of_class[k])).join(first, F.col("alike") == F.col("same"), "left")
        again = F.coalesce((F.col("first.page") != F.col("page")) | (F.col("first.uri") != F.col("uri")), F.lit(False))
        told = told.withColumn("record_type", F.when(again, "revisit").otherwise(F.col("record_type")))
        marks = {"X-Page": F.col("page"), "X-Payload-Length": F.col("size"), "X-Refers-To-Page": F.when(again, F.col("first.page"))}
        write_warc(told.select(rendered(F.col("first.record_id"), F.col("first.uri"), marks).alias("record")), path, file_records=file_records)
    back = read_warc(spark.read.format("binaryFile").load(path).select("content"))
    # what a response holds is measured again; a revisit only tells
    body = F.expr(r"substring(block, instr(cast(block as string), '\r\n\r\n') + 4)")
    stored = F.col("headers")["WARC-Type"] != "revisit"
    return back.select(
        F.expr("try_cast(headers['X-Page'] as bigint)").alias("page_id"),
        F.when(stored, F.octet_length(body)).otherwise(F.expr("cast(headers['X-Payload-Length'] as bigint)")).cast("long").alias("payload_bytes"),
        F.when(stored, F.sha2(body, 256)).otherwise(F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1)).alias("payload_digest"),
        F.col("headers")["WARC-Type"].alias("record_type"),
        F.expr("try_cast(headers['X-Refers-To-Page'] as bigint)").alias("refers_to"),
        F.col("headers")["WARC-Record-ID"].alias("record_id"),
        F.col("headers")["WARC-Target-URI"].alias("uri"),
    )
