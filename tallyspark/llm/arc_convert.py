"""Legacy archive converter: ARC records, versions 1 and 2, become WARC records.

An ARC file starts with a ``filedesc://`` record whose second line gives the version and whose
third line names the fields of every record's header line. Version 1 has five fields (URL, IP,
date, type, length), version 2 ten (with result code, checksum, location, offset and file
name). A record is its header line, as many bytes as the line declares, and a line break.

The converter walks the declared lengths, never searches for the next header, and makes of
each record a WARC/1.1 record: the identifier is a UUID computed from URL, date and digest,
the timestamp is the 14-digit date in ISO form, digests are SHA-1 in base 32. Of records with
equal payloads the one with the largest page id is the ``response``; the others become
``revisit`` records without payload that name it. Identifier, timestamps and types depend on
the record alone, so a task that runs again writes the same bytes.

An archive is one row of ``archives(id, bytes)``: parts of about ``PART`` bytes, each readable by
itself, gzipped record by record. The table is written below the shared folder.

Defined results: a null payload is an empty one; empty payloads take part like others; a null
URL is written as ``urn:page:<id>``; a null date as 1996-01-01 00:00:00; rows with the same
page id are separate records, and of those with equal payload one is the response if the id is
the largest (by URL, date, and place in the archives); a null page id ranks below every other. A
payload longer than a part is a part by itself; an empty table gives no archives; columns that
are not named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

from .common import column, map_batches

#: Fixed values of the ARC format.
VERSION_1 = b"URL IP-address Archive-date Content-type Archive-length"
VERSION_2 = (b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             b"Filename Archive-length")
NO_DATE = "19960101000000"
PART = 8_000_000
NAMESPACE = uuid.NAMESPACE_URL


def arc_header(version: int, name: str, date: str) -> bytes:
    """The file's own record: name, version block and the names of the fields."""
    fields = VERSION_1 if version == 1 else VERSION_2
    body = b"%d 0 InternetArchive\n%s\n\n" % (version, fields)
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        line += f" 200 - - 0 {name}"
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str = "-",
               offset: int = 0, ip: str = "0.0.0.0") -> bytes:
    line = f"{url} {ip} {date} {kind}"
    if version == 2:
        line += f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{line} {len(body)}\n".encode() + body + b"\n"


class BadArchive(ValueError):
    """The bytes are not a readable ARC file; the message says where."""


def read_arc(data: bytes) -> Iterator[dict[str, object]]:
    """The records after the file's own, each with the fields its version names and ``body``."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode(errors="replace")
        names = fields or (VERSION_2 if line.count(" ") == 9 else VERSION_1)
        # Spaces in a URL are the only ones that a header line can have too many of.
        values = line.rsplit(" ", names.count(b" "))
        if end < 0 or len(values) != names.count(b" ") + 1 or not values[-1].isdigit():
            raise BadArchive(f"no header line at byte {at}: {line[:80]!r}")
        size = int(values[-1])
        body = data[end + 1:end + 1 + size]
        if len(body) != size:
            raise BadArchive(f"the record at byte {at} declares {size} bytes, {len(body)} follow")
        if fields is None:
            lines = body.split(b"\n")
            if not line.startswith("filedesc://") or len(lines) < 2:
                raise BadArchive("the file does not start with its filedesc record")
            fields = lines[1].strip()
        else:
            record = dict(zip(names.decode().split(" "), values, strict=True))
            yield {**record, "body": body}
        at = end + 1 + size


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def warc_date(date: str) -> str:
    """A 14-digit (or shorter) ARC date in ISO form; missing digits are those of 1996-01-01."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + NO_DATE[len(digits):]
    return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(url: str, date: str, kind: str, body: bytes, sha1: str, size: int,
                original: dict[str, str] | None = None, page: str = "") -> bytes:
    """A gzipped WARC record; with ``original`` a revisit of it."""
    when = warc_date(date)
    head = [
        ("WARC-Type", "revisit" if original else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page} {url} {when} {sha1}')}>"),
        ("WARC-Date", when),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Source-Length", str(size)),
        ("WARC-Source-ID", page),
        ("Content-Type", kind),
    ]
    if original:
        body = b""
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To-Source-ID", original["page"]),
                 ("WARC-Refers-To-Target-URI", original["url"]),
                 ("WARC-Refers-To-Date", warc_date(original["date"]))]
    else:
        head.append(("WARC-Block-Digest", f"sha1:{sha1}"))
    head.append(("Content-Length", str(len(body))))
    text = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + text + b"\r\n" + body + b"\r\n\r\n") + pack.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped archive."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data) + member.flush()
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        if not lines[0].startswith("WARC/"):
            raise BadArchive(f"no WARC record: {lines[0][:80]!r}")
        size = int(fields["Content-Length"])
        if len(rest) != size + 4:
            raise BadArchive(f"{fields['WARC-Record-ID']} declares {size} bytes")
        yield fields, rest[:size]


def _one_line(url: str | None, page: int | None) -> str:
    """A URL without line breaks; the page's own name where there is none."""
    return re.sub(r"[\r\n]+", "%0A", url) if url else f"urn:page:{page}"


def _to_arc(version_of, part: int):
    def work(ids, urls, dates, bodies):
        held, size, pages, names = [], 0, [], []
        parts: list[list] = [[], [], []]

        def close(version):
            parts[0].append(arc_header(version, "part", NO_DATE) + b"".join(held))
            parts[1].append(list(pages))
            parts[2].append(version)

        for version in (1, 2):
            for page, url, date, body in zip(ids, urls, dates, bodies, strict=True):
                if version_of(page) == version:
                    record = arc_record(version, _one_line(url, page), date or NO_DATE,
                                        "text/html", body or b"", "part", size)
                    if held and size + len(record) > part:
                        close(version)
                        held, size, pages = [], 0, []
                    held.append(record)
                    pages.append(page)
                    size += len(record)
            if held:
                close(version)
            held, size, pages = [], 0, []
        yield parts
    return work


def to_arc(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html",
           date: str = "fetch_date", part: int = PART) -> DataFrame:
    """Archives in the legacy format, one row per part: its bytes, page ids and version.

    Even pages go into version 1 archives, odd pages into version 2.
    """
    base = pages.select(column(pages, id, "long"), column(pages, url, "string"),
                        column(pages, date, "string"), column(pages, body, "binary"))
    return map_batches(base, _to_arc(lambda page: 1 + (page or 0) % 2, part),
                       "archive binary, pages array<long>, version int")


def records(archives: DataFrame) -> DataFrame:
    """The records of ARC archives: page, URL, date, type, payload, its length and digest."""
    def work(data, pages, _versions):
        for archive, ids in zip(data, pages, strict=True):
            rows = [(page, r["URL"], r["Archive-date"], r["Content-type"], r["body"],
                     len(r["body"]), digest(r["body"]))
                    for page, r in zip(ids, read_arc(archive), strict=True)]
            if rows:
                yield [list(x) for x in zip(*rows, strict=True)]
    return map_batches(archives, work, "page_id long, url string, date string, kind string, "
                       "body binary, payload_bytes long, payload_digest string")


def convert(archives: DataFrame, part: int = PART) -> DataFrame:
    """WARC archives of ARC archives, written below the shared folder: one row per part.

    Who answers for a payload is decided on (digest, length, page, URL, date) alone; payloads
    are not shuffled unless Spark sorts them beside that table of repeated payloads.
    """
    # Archives are read in their order, so a record has the same number whenever it is read.
    found = records(archives).withColumn("row", F.monotonically_increasing_id())
    first = (found.groupBy("payload_digest", "payload_bytes")
             .agg(F.max(F.struct(F.coalesce("page_id", F.lit(-2**63)).alias("rank"), "page_id",
                                 "url", "date", "row")).alias("o"), F.count("*").alias("n"))
             .where("n > 1").select("payload_digest", "payload_bytes", "o.*")
             .withColumnsRenamed({"page_id": "o_page", "url": "o_url", "date": "o_date",
                                  "row": "o_row"}))
    joined = found.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "date", "kind",
        F.when(F.col("rank").isNull() | (F.col("row") == F.col("o_row")),
               F.col("body")).alias("body"),
        "payload_bytes", "payload_digest", "o_page", "o_url", "o_date",
        F.coalesce(F.col("row") != F.col("o_row"), F.lit(False)).alias("again"))

    def work(ids, urls, dates, kinds, bodies, sizes, digests, o_pages, o_urls, o_dates, agains):
        held, total, done = [], 0, []
        for page, url, date, kind, body, size, sha1, op, ou, od, again in zip(
                ids, urls, dates, kinds, bodies, sizes, digests, o_pages, o_urls, o_dates,
                agains, strict=True):
            original = {"page": str(op), "url": ou, "date": od} if again else None
            held.append(warc_record(url, date, kind, body or b"", sha1, size, original,
                                    "" if page is None else str(page)))
            total += len(held[-1])
            if total > part:
                done.append(b"".join(held))
                held, total = [], 0
        if held:
            done.append(b"".join(held))
        yield [done]

    return stage(map_batches(joined, work, "archive binary"), "warc")


def read_back(archives: DataFrame) -> DataFrame:
    """A row per WARC record; a response's digest and length are checked against its block."""
    def work(data):
        for archive in data:
            rows = []
            for head, body in read_warc(archive):
                sha1, size = head["WARC-Payload-Digest"][5:], int(head["WARC-Source-Length"])
                if head["WARC-Type"] == "response" and (digest(body), len(body)) != (sha1, size):
                    raise BadArchive(f"{head['WARC-Record-ID']} does not have its digest")
                page, to = head["WARC-Source-ID"], head.get("WARC-Refers-To-Source-ID")
                rows.append((int(page) if page else None, size, sha1, head["WARC-Type"],
                             int(to) if to and to != "None" else None, head["WARC-Target-URI"],
                             head["WARC-Date"], head["WARC-Record-ID"], body))
            if rows:
                yield [list(x) for x in zip(*rows, strict=True)]
    return map_batches(archives, work, "page_id long, payload_bytes long, payload_digest string, "
                       "record_type string, refers_to long, url string, warc_date string, "
                       "record_id string, body binary")
