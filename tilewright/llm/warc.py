"""Legacy web archives (ARC) to WARC, and WARC writing and reading.

An ARC file opens with a version block: `filedesc://` line, a line `1 0 organisation` (or `2 0 ...`) and a
line that names the fields of all URL records. Version 1 records have five fields (URL, IP address, archive
date, content type, length), version 2 has ten (result code, checksum, location, offset and filename
besides). A record is its header line, as many bytes as it declares, and a line feed. The converter reads
fields by the version line and payloads by declared length alone, and gives each record a WARC identifier,
date, type, address and digest that depend only on the record. The version block becomes a warcinfo record that the
archive's records name. A revisit names the record, URI and date that it refers to.

Archives are written by Spark's text writer, whose output is committed by task and goes to any Hadoop file
system. ARC: one row is one record, the line separator is what ends a record in the format, and files are gzipped
whole. WARC: every record is a gzip member of its own, so that a reader can start at any; the writer's separator is
the member's last byte. A task starts another archive after as many records as make ARCHIVE_MB in the mean, which
bounds what reading one whole takes. Bytes that are not UTF-8 pass through unchanged.

Defined results: a null html is an empty payload; a null url is `unknown:`; rows that share page_id and
payload are all of the same type and refer alike; a null page_id is less than any other; an empty table
gives no archives and no rows; columns other than page_id, url and html do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Scratch, tidy

ARCHIVE_MB = 8
REVISIT_FROM = 1000
CONVERTED = "page_id long, uri string, record_id string, date string, warc_type string, digest string, payload binary, ip string, info_id string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks its format."""


def _version_block(data: bytes) -> tuple[list[str], str, list[str], int]:
    """Of an ARC file: the values of its filedesc line, its version line, the names of its fields, and where its records start."""
    end = data.index(b"\n")
    head = data[:end].decode("utf-8", "surrogateescape").split(" ")
    if not head[0].startswith("filedesc:"):
        raise ArchiveError("no filedesc line")
    size = int(head[-1])
    block = data[end + 1 : end + 1 + size].decode("utf-8", "surrogateescape").split("\n")
    if block[0].split(" ")[0] not in ("1", "2"):
        raise ArchiveError(f"ARC version {block[0].split(' ')[0]!r}")
    return head, block[0], block[1].split(" "), end + 1 + size


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of each URL record of one uncompressed ARC file, of version 1 or 2."""
    if not data:
        return
    _, version, names, at = _version_block(data)
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("a header line without its end")
        values = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        if len(values) < len(names):
            raise ArchiveError(f"{len(values)} fields where version {version.split(' ')[0]} names {len(names)}")
        if over := len(values) - len(names):  # spaces in the URL
            values = [" ".join(values[: over + 1]), *values[over + 1 :]]
        fields = dict(zip(names, values))
        at = end + 1 + int(fields["Archive-length"])
        if at > len(data):
            raise ArchiveError("a record shorter than it declares")
        yield fields, data[end + 1 : at]


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of one uncompressed WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ArchiveError("no WARC version line")
        end = data.find(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        start = end + 4
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ArchiveError("a block of another length than it declares")
        yield fields, data[start : start + size]
        at = start + size + 4


def _members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """What each gzip member of a file holds, one after another."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ArchiveError("a member without its end")
            parts.append(z.decompress(view[at : at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data)
        yield b"".join(parts)


def _unzip(data: bytes) -> bytes:
    return b"".join(_members(data))


def _member(data: bytes) -> bytes:
    """data as a gzip member whose last byte is 0.

    That byte is the highest of the size, 0 below 16 MB; a larger member is followed by an empty one.
    """
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out + _member(b"") if out[-1] else out


def _write(records: DataFrame, most: int, path: str, end: str, opening: bytes | None = None) -> None:
    """records: a column record of bytes. most: records of an archive. opening: a first record of each archive.

    Tasks write what they have read, without a shuffle; the writer starts a new file after `most` records.
    """
    if opening is not None:
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # rows of the task before this one
        both = F.array(F.lit(bytearray(opening)), F.col("record"))
        records = records.withColumn("_row", row).select(F.explode(F.when(F.col("_row") % (most - 1) == 0, both).otherwise(F.array("record"))).alias("record"))
    out = records.select(F.col("record").cast("string").alias("value")).write
    out.option("lineSep", end).option("maxRecordsPerFile", most).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").mode("overwrite").text(path)


def _files(spark, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")


def records_an_archive(pages: DataFrame) -> int:
    """As many records of mean size as make ARCHIVE_MB, two at least."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    return max(2, int(ARCHIVE_MB * 1_000_000 / (mean + 500)))


def write_arc(pages: DataFrame, path: str, most: int, versions: tuple[int, ...] = (1, 2)) -> None:
    """pages (page_id, url, html) as ARC archives under path: one folder for each version."""
    url = F.regexp_replace(F.coalesce("url", F.lit("unknown:")), r"[\r\n]", "%0A")
    html = F.coalesce("html", F.lit("")).cast("binary")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.col("page_id") % 300_000_000, F.lit(0))), "yyyyMMddHHmmss")
    fields = {1: [url, F.lit("0.0.0.0"), date, F.lit("text/html"), F.octet_length(html).cast("string")], 2: [url, F.lit("0.0.0.0"), date, F.lit("text/html"), F.lit("200"), F.lit("-"), F.concat(F.lit("page:"), name), F.lit("0"), F.lit("pages.arc"), F.octet_length(html).cast("string")]}
    for i, version in enumerate(versions):
        mine = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(len(versions))) == i)
        record = F.concat(F.concat_ws(" ", *fields[version][:1], *fields[version][1:]).cast("binary"), F.lit("\n").cast("binary"), html)
        # version 1 has no field to spare: the page's number rides in the URL's fragment
        if version == 1:
            record = F.concat(F.concat(url, F.lit("#page:"), name).cast("binary"), F.lit(" ").cast("binary"), F.concat_ws(" ", *fields[1][1:]).cast("binary"), F.lit("\n").cast("binary"), html)
        _write(mine.select(record.alias("record")), most, f"{path}/v{version}", "\n", version_block(version)[:-1])


_HEADS = {
    1: (b"1 0 archive\n", b"URL IP-address Archive-date Content-type Archive-length\n"),
    2: (b"2 0 archive\n", b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"),
}


def version_block(version: int, date: str = "20000101000000") -> bytes:
    """The filedesc record that opens an ARC file."""
    body = b"".join(_HEADS[version]) + b"\n"
    return f"filedesc://archive.arc 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def _warc_date(stamp: str) -> str:
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"


def _urn(*parts: object) -> str:
    """An identifier that depends on the parts alone."""
    name = "\n".join(map(str, parts)).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def converted(fields: dict[str, str], payload: bytes) -> tuple:
    """One ARC record as the values of a WARC record."""
    url, page = fields["URL"], None
    if "Location" in fields:
        found = re.fullmatch(r"page:(-?\d+)", fields["Location"])
        page = int(found[1]) if found else None
    elif found := re.search(r"#page:(-?\d+|-)$", url):
        page = int(found[1]) if found[1] != "-" else None
        url = url[: found.start()]
    stamp, digest = fields["Archive-date"], hashlib.sha1(payload)
    kind = "response" if "http" in fields["Content-type"] or fields["Content-type"].startswith("text/") else "resource"
    return page, url, _urn(url, stamp, page, digest.hexdigest()), _warc_date(stamp), kind, "sha1:" + base64.b32encode(digest.digest()).decode(), payload


def archive_info(data: bytes) -> tuple:
    """The version block of an ARC file as the values of a warcinfo record; its uri is the archive's file name."""
    head, version, names, _ = _version_block(data)
    name = head[0].removeprefix("filedesc:").lstrip("/")
    number, _, origin = version.split(" ", 2)
    block = f"format: WARC File Format 1.1\r\nconverted-from: ARC version {number}\r\npublisher: {origin}\r\narc-fields: {' '.join(names)}\r\n".encode("utf-8", "surrogateescape")
    return None, name, _urn("warcinfo", *head, version), _warc_date(head[2]), "warcinfo", None, block


def convert_arc(spark, path: str) -> DataFrame:
    """The records of ARC archives as WARC values, CONVERTED: a warcinfo row for each archive, then a row for each of its records."""
    types = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.string(), pa.string()]
    names = [x.split()[0] for x in CONVERTED.split(", ")]

    def convert(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = _unzip(content.as_py())
                if not data:
                    continue
                info = archive_info(data)
                rows, size = [(*info, None, None)], 0
                for fields, payload in arc_records(data):
                    rows.append((*converted(fields, payload), fields["IP-address"], info[2]))
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return _files(spark, path, "*.gz").mapInArrow(tidy(convert), CONVERTED)


def with_revisits(records: DataFrame, scratch: Scratch, least: int = REVISIT_FROM) -> DataFrame:
    """records with warc_type `revisit` and `head` (page_id, record_id, uri, date) where an equal payload of `least` bytes or more has a later page."""
    head = F.max(F.struct("page_id", "record_id", "uri", "date")).alias("head")
    heads = records.where("digest is not null").where(F.octet_length("payload") >= least).groupBy("digest").agg(head, F.count("*").alias("n")).where("n > 1").drop("n")
    heads = scratch.write(heads, "heads")  # its size is known when the join is planned: payloads move only if it is large
    rows = records.join(heads.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= least), "left").drop("_digest")
    again = F.col("head.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    return rows.withColumns({"warc_type": F.when(again, "revisit").otherwise(F.col("warc_type")), "head": F.when(again, F.col("head"))})


def write_warc(records: DataFrame, path: str, most: int) -> None:
    """WARC 1.1 archives under path, a gzip member a record. A revisit has no block; its digest and payload length are header fields."""
    again, info = F.col("head").isNotNull(), F.col("warc_type") == "warcinfo"
    block = F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Filename", F.when(info, F.col("uri"))), line("WARC-Target-URI", F.when(~info, F.col("uri"))), line("WARC-IP-Address", F.col("ip")), line("WARC-Warcinfo-ID", F.col("info_id")),
        line("WARC-Payload-Digest", F.col("digest")), line("X-Page-ID", F.when(~info, F.coalesce(F.col("page_id").cast("string"), F.lit("-")))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE))), line("WARC-Refers-To", F.col("head.record_id")), line("WARC-Refers-To-Target-URI", F.col("head.uri")), line("WARC-Refers-To-Date", F.col("head.date")),
        line("X-Refers-To-Page", F.col("head.page_id").cast("string")), line("X-Payload-Length", F.when(again, F.octet_length("payload").cast("string"))),
        line("Content-Type", F.when(info, F.lit("application/warc-fields")).otherwise(F.lit("text/html"))), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )

    def zipped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_member(r.as_py())[:-1] for r in batch.column(0)], pa.binary())], ["record"])

    members = records.select(F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary")).alias("record")).mapInArrow(tidy(zipped), "record binary")
    members.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", most).mode("overwrite").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex SHA-1 of the bytes read), record_type, refers_to of the pages in WARC archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for member in _members(content.as_py()):
                    for fields, block in warc_records(member):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                        page, refers = fields["x-page-id"], fields.get("x-refers-to-page")
                        if refers is None and digest != hashlib.sha1(block).digest():
                            raise ArchiveError("a payload that breaks its digest")
                        size = len(block) if refers is None else int(fields["x-payload-length"])
                        rows.append((None if page == "-" else int(page), size, digest.hex(), fields["warc-type"], int(refers) if refers else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return _files(spark, path, "*.txt").mapInArrow(tidy(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """pages -> ARC archives -> converted WARC archives with revisits -> what these read back as."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", "html")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    most = records_an_archive(pages)
    write_arc(pages, arc, most)
    records = convert_arc(spark, f"{arc}/v1").unionByName(convert_arc(spark, f"{arc}/v2"))
    write_warc(with_revisits(records, scratch), warc, most)
    scratch.drop("arc")
    return read_warc(spark, warc)
