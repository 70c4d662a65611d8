"""Legacy web archives: write and parse ARC files, convert them to WARC, and read WARC files back.

An ARC file starts with a version block that names the fields of its record lines; version 1 has five, version 2 ten.
Each record line ends in the declared length of what follows. From these the converter synthesises WARC identifiers,
timestamps, types and digests. Of records with equal payloads one is a response, the others are revisits of it.

An archive file is one row of Spark's text sink, written as it is: each record a gzip member of its own, some ``FILE_BYTES``
of records or one larger record in a file, whatever the input's splits are. Files are read as binary rows, so any store
that Spark can reach will do; files of other makers can be as large as a row, under 2 GB. A record's identifier comes from
its place in the archive it was read from, so no two are equal.

Defined cases: a null html is an empty payload, a null url ``about:blank``. Null page ids count as the smallest. Rows
that repeat a page id are records of their own. White space in urls is percent-encoded. An empty table gives archives
with no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_groups, remove, scratch_path, settle

#: The record line's fields in each version of the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_DATE = "20240101000000"
_NO_PAGE = -(1 << 63)
_CHUNK_BYTES, _WINDOW = 4 << 20, 8 << 10
#: Records of one archive file before compression, about.
FILE_BYTES = 8 << 20
#: Compressed files of one task, about, and the number of tasks up to which they stay so small.
TASK_BYTES, MANY_TASKS = 4 << 20, 10_000


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url) if url else "about:blank"


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def inflate(data: bytes) -> bytes:
    """The content of a file of one or many gzip members, or the data itself."""
    view, at, out = memoryview(data), 0, []
    while data[at : at + 2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof and at < len(view):  # in parts, as what a member leaves over is copied
            part = view[at : at + _WINDOW]
            out.append(unpacker.decompress(part))
            at += len(part) - len(unpacker.unused_data)
    return b"".join(out) + data[at:].lstrip(b"\0")


# ARC


def arc_head(version: int, name: str) -> str:
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n"
    line = f"filedesc://{name} 0.0.0.0 {_DATE} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ")
    return f"{line}{len(body)}\n{body}"


def arc_record(version: int, page_id: int | None, url: str | None, html: str, name: str) -> bytes:
    body = html.encode("utf-8", "surrogatepass")
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(body)}\r\n\r\n".encode()
    line = f"{safe_url(url)} 0.0.0.0 {_DATE} text/html " + ("" if version == 1 else f"200 - - 0 {name} ")
    return f"{line}{len(head) + len(body)}\n".encode("utf-8", "surrogatepass") + head + body


def _files_of(records: Iterator[bytes], head: Callable[[int], bytes], end: bytes) -> Iterator[pd.DataFrame]:
    """Rows of one archive file each: the file's head, then records up to ``FILE_BYTES``. There is one file at least."""
    number, held, parts = 0, 0, [member(head(0) + end)]
    for r in records:
        if held and held + len(r) > FILE_BYTES:
            yield pd.DataFrame({"value": [b"".join(parts)]})
            number, held = number + 1, 0
            parts = [member(head(number) + end)]
        parts.append(member(r + end))
        held += len(r)
    yield pd.DataFrame({"value": [b"".join(parts)]})


def _write(files: DataFrame, path: str) -> None:
    """One file for each row, followed by a zero byte, which readers of gzip take for padding."""
    rows = files.select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Gzipped ARC files of bounded size; partitions write version 1 and 2 in turn."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        version, name = number % 2 + 1, f"part-{number:05d}.arc"

        def records() -> Iterator[bytes]:
            for b in batches:
                for i, u, h in zip(b["i"], b["u"], b["h"]):
                    yield arc_record(version, None if pd.isna(i) else int(i), u, h or "", name)

        yield from _files_of(records(), lambda k: arc_head(version, f"{k}-{name}").encode(), b"\n")

    # Ids as text: with a null among them pandas would make them floats.
    some = pages.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    _write(some.mapInPandas(files, "value binary"), path)


@dataclass
class ArcRecord:
    offset: int
    url: str
    date: str
    mime: str
    version: int
    content: bytes


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file: the version block's field names decide how a record line is read."""
    at, names, version = 0, ARC_FIELDS[1].split(), 1
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if at >= len(data) or end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc:"):
            length = int(line.rsplit(" ", 1)[1])
            block = data[end + 1 : end + 1 + length].decode("utf-8", "replace").split("\n")
            version, names = int(block[0].split(" ")[0]), block[1].strip().split(" ")
            at = end + 1 + length
            continue
        field = dict(zip(names, line.rsplit(" ", len(names) - 1)))
        length = int(field["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes, more than the file has")
        yield ArcRecord(at, field["URL"], field["Archive-date"], field["Content-type"], version, data[end + 1 : end + 1 + length])
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes, int | None]:
    """HTTP header, payload and the page id that the header may carry."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or not gap:
        return b"", content, None
    found = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", head)
    return head + gap, payload, int(found.group(1)) if found else None


def _files(spark: SparkSession, path: str, what: str = "content") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", what)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of a folder of ARC files: (file, spot, url, date, page_id, payload_bytes, payload_digest[, head, payload])."""
    columns = ["file", "spot", "url", "date", "page_id", "payload_bytes", "payload_digest", *(["head", "payload"] if with_payload else [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for r in parse_arc(inflate(content)):
                    head, payload, page = split_http(r.content)
                    rows.append((name, r.offset, r.url, r.date, page, len(payload), sha1_base32(payload), *([head, payload] if with_payload else [])))
                    held += len(r.content)
                    if held > _CHUNK_BYTES:
                        yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    schema = "file string, spot long, url string, date string, page_id long, payload_bytes long, payload_digest string"
    return _files(spark, path).mapInPandas(parse, schema + (", head binary, payload binary" if with_payload else ""))


# WARC


def iso_date(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date."""
    d = (date + "00010101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: bytes) -> str:
    """An identifier from 16 bytes of a digest."""
    return f"<urn:uuid:{uuid.UUID(bytes=key, version=5)}>"


def place_key(file: str, spot: int) -> bytes:
    """What makes a record's identifier: its place in the archive it comes from; ``_place_key`` is the same in Spark."""
    return hashlib.sha256(f"{file} {spot}".encode()).digest()[:16]


def _place_key(file: str, spot: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat_ws(" ", F.col(file), F.col(spot).cast("string")), 256)), 1, 16)


@dataclass
class Revisited:
    """The response that a revisit refers to."""

    page_id: int | None
    key: bytes


def warc_record(r: ArcRecord, key: bytes, refers_to: Revisited | None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit that has the HTTP header alone."""
    head, payload, page_id = split_http(r.content)
    digest, block = sha1_base32(payload), head if refers_to else r.content
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {iso_date(r.date)}", f"WARC-Target-URI: {r.url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to.key)}")
        if refers_to.page_id is not None:
            lines.append(f"X-Refers-To-Page: {refers_to.page_id}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block


def warc_info(name: str) -> bytes:
    info = "software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(place_key(name, -1))}", f"WARC-Date: {iso_date(_DATE)}", f"WARC-Filename: {name}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + info).encode()


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the WARC equivalent of a folder of ARC files.

    Only keys and digests are grouped; a group's response is the record with the largest page id, and a group of any
    size is joined safely. What was decided on a file's records, a list no longer than the file, then meets the file
    itself: the shuffle carries compressed files, not payloads, in as many tasks as their bytes ask for. Payloads are
    bytes of any encoding.
    """
    keys = settle(read_arc(spark, arc_path, with_payload=False).select("file", "spot", "page_id", "payload_digest", "payload_bytes"), "records")
    groups = keys.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "file", "spot")).alias("top"), F.count("*").alias("n"))
    groups = groups.select("payload_digest", F.col("top.page_id").alias("refers_to"), F.col("top.file").alias("top_file"), F.col("top.spot").alias("top_spot"), "n")
    groups = settle(groups.filter("n > 1").withColumn("top_key", _place_key("top_file", "top_spot")), "groups")
    typed = join_groups(keys.select("file", "spot", "payload_digest"), groups, "payload_digest", "n")
    # Records not listed are responses.
    revisits = typed.filter((F.col("file") != F.col("top_file")) | (F.col("spot") != F.col("top_spot")))
    entry = F.struct("spot", F.coalesce("refers_to", F.lit(_NO_PAGE)).alias("refers_to"), "top_key")
    size = _files(spark, arc_path, "length").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_tasks = max(1, min(-(-size // TASK_BYTES), max(MANY_TASKS, -(-size // (16 * TASK_BYTES)))))
    listed = revisits.groupBy("file").agg(F.collect_list(entry).alias("found"))
    listed = listed.select("file", "found.spot", "found.refers_to", "found.top_key").repartition(n_tasks, "file")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for path, content, spots, refers, keys in zip(batch["path"], batch["content"], batch["spot"], batch["refers_to"], batch["top_key"]):
                    at = {} if spots is None else dict(zip(spots.tolist(), zip(refers.tolist(), keys)))
                    for r in parse_arc(inflate(content)):
                        page, key = at.get(r.offset, (None, None))
                        yield warc_record(r, place_key(path, r.offset), None if key is None else Revisited(None if page == _NO_PAGE else page, bytes(key)))

        yield from _files_of(records(), lambda k: warc_info(f"part-{task:05d}-{k}.warc.gz"), b"\r\n\r\n")

    whole = _files(spark, arc_path).repartition(n_tasks, "path").join(listed, F.col("path") == F.col("file"), "left")
    _write(whole.select("path", "content", "spot", "refers_to", "top_key").mapInPandas(files, "value binary"), warc_path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one WARC file."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if at >= len(data) or end < 0:
            return
        first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits: (page_id, url, date, record_id, record_type, payload_bytes, payload_digest, refers_to,
    refers_to_id, intact). ``refers_to`` is a page id, ``refers_to_id`` the identifier of the response.

    ``intact``: the block has its declared length and digest, and so has a response's payload.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in parse_warc(inflate(content)):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    digest, number = head["warc-payload-digest"].removeprefix("sha1:"), lambda k: int(head[k]) if k in head else None  # noqa: B023
                    intact = head["warc-block-digest"] == f"sha1:{sha1_base32(block)}"
                    if head["warc-type"] == "response":
                        payload = split_http(block)[1]
                        intact &= sha1_base32(payload) == digest and len(payload) == number("x-payload-length")
                    rows.append(
                        (number("x-page-id"), head["warc-target-uri"], head["warc-date"], head["warc-record-id"], head["warc-type"], number("x-payload-length"),
                         digest, number("x-refers-to-page"), head.get("warc-refers-to"), intact)
                    )
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    schema = (
        "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, refers_to_id string, intact boolean"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return _files(spark, path).mapInPandas(parse, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as ARC files, convert them to WARC files, and read those back."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc)
