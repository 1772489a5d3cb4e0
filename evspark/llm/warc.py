"""Legacy ARC archives made into WARC.

An ARC archive begins with a version block whose field line says what its records' header lines hold:
version 1 has URL, IP address, date, type and length; version 2 adds result code, checksum, location,
offset and file name. The converter reads that line, splits each header line by it from the right (a
URL may hold spaces), takes as many bytes as the line declares, and synthesises the WARC record: an
identifier (a name-based UUID of archive, place, URL, date and digest, so reruns agree), a timestamp
from the 14 or 12 digits, a type and content type from scheme and first bytes, and SHA-1 digests of
block and payload in base 32. Records of payloads that another record has too become revisits.

Archives are rows (archive, data): `data` is a whole archive, each record a gzip member of its own, as
such files are. They are kept as a table, which any file system that Spark writes can hold. Equal
payloads are found by digest and length alone; a payload that a third of all records share is no task's burden
(partial maxima, then a join that broadcasts hot digests). Nothing but the small index is shuffled but
the archives themselves, once, to meet their list of revisits.

Defined cases. A null page is an empty payload, a null URL is written "-", white space and control
characters of URLs are escaped. Pages with equal page_id are records of their own; of equal payloads
with equal greatest ids the record with the greatest identifier is the response. A page without an id
has none when read back. Bytes that no header line starts, what follows a damaged gzip member, and a WARC record
without a length are reported as one record of type "malformed", without page, digest or reference. A version block
of no known version is read as its field line says, or as version 1. Empty tables give empty ones. Record identifiers
hang on the archive and so on how the pages are dealt; equal pages dealt alike get equal ones.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import drop_written, join_groups, slices, written

#: Field lines by version. Fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in an archive, about, and how hard records are compressed.
ARCHIVE_BYTES, LEVEL = 4 << 20, 4
NAMESPACE = uuid.NAMESPACE_URL
KEY_HEADER = b"X-Page-Id: "


def digest(data: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _gz(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file one after the other, or the bytes as they are. Of a damaged member what can be
    had is taken, and bytes after the members stand as they are, so that nothing is lost silently."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            d = zlib.decompressobj(31)
            for at in range(0, len(data), 1024):
                try:
                    out.append(d.decompress(data[at : at + 1024]))
                except zlib.error:
                    return b"".join([*out, data[at:]])
        data = d.unused_data
    return b"".join([*out, data])


def _size(text: str) -> int | None:
    """A declared length, or None if it is none."""
    return int(text) if re.fullmatch(r"[0-9]{1,18}", text) else None


# -- ARC


def arc_header(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 evspark\n{FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    head = [url, "0.0.0.0", date, kind]
    if version == 2:
        head += ["200", "-", "-", str(offset), name]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body + b"\n"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    offset: int
    body: bytes
    malformed: bool = False


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its version block left out; version-specific header lines and
    declared lengths are all that is trusted. What can't be read is one last malformed record."""
    data, at, fields = unpacked(data), 0, FIELDS[1].split()
    first = True
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.rsplit(" ", len(fields) - 1) if not first else line.rsplit(" ", 4)
        names = FIELDS[1].split() if first else fields
        size = _size(parts[-1])
        if end < 0 or len(parts) != len(names) or size is None or end + 1 + size > len(data):
            yield ArcRecord("", "", "", "", at, data[at:], True)
            return
        row, body = dict(zip(names, parts, strict=True)), data[end + 1 : end + 1 + size]
        if first:
            if not row["URL"].startswith("filedesc:"):
                yield ArcRecord("", "", "", "", at, data[at:], True)
                return
            fields = _fields(body.decode("utf-8", "replace").splitlines())
        else:
            yield ArcRecord(row["URL"], row.get("IP-address", "0.0.0.0"), row.get("Archive-date", ""), row.get("Content-type", ""), at, body)
        first, at = False, end + 1 + size


def _fields(lines: list[str]) -> list[str]:
    """What a version block says that header lines hold: its field line, or that of its version."""
    told = lines[1].split() if len(lines) > 1 else []
    if told and told[0] == "URL" and told[-1] == "Archive-length":
        return told
    version = lines[0].split()[:1] if lines else []
    return FIELDS[2 if version == ["2"] else 1].split()


# -- WARC


class Synthesised(NamedTuple):
    record_id: str
    date: str
    kind: str
    content_type: str
    http: bytes
    payload: bytes
    block_digest: str
    payload_digest: str


def warc_date(digits: str) -> str:
    """The timestamp of 14 or 12 digits; the epoch for any other."""
    d = digits if re.fullmatch(r"\d{14}", digits) else digits + "00" if re.fullmatch(r"\d{12}", digits) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthesise(archive: str, r: ArcRecord) -> Synthesised:
    if r.body.startswith(b"HTTP/"):
        end = r.body.find(b"\r\n\r\n")
        http, payload = (r.body[: end + 4], r.body[end + 4 :]) if end >= 0 else (r.body, b"")
        kind, content = "response", "application/http; msgtype=response"
    else:
        http, payload, kind, content = b"", r.body, "resource", "text/dns" if r.url.startswith("dns:") else r.kind or "application/octet-stream"
    block = digest(r.body)
    name = uuid.uuid5(NAMESPACE, f"{archive}\n{r.offset}\n{r.url}\n{r.date}\n{block}")
    return Synthesised(f"<urn:uuid:{name}>", warc_date(r.date), kind, content, http, payload, block, digest(payload))


def http_field(http: bytes, name: bytes) -> str | None:
    at = http.find(b"\r\n" + name)
    return None if at < 0 else http[at + 2 + len(name) : http.find(b"\r\n", at + 2)].decode("utf-8", "replace")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{a}: {b}\r\n" for a, b in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(archive: str, data: bytes, revisits: dict[int, dict]) -> bytes:
    """An ARC file as a WARC file. `revisits` has, by the record's number, the record that it repeats."""
    out = [_gz(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, archive)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", f"{archive}.warc.gz"), ("Content-Type", "application/warc-fields")], b"software: evspark\r\nformat: WARC File Format 1.1\r\n"))]
    for n, r in enumerate(arc_records(data)):
        if r.malformed:
            out.append(_gz(warc_record([("WARC-Type", "malformed"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {r.offset}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/octet-stream")], r.body)))
            continue
        s = synthesise(archive, r)
        head = [("WARC-Record-ID", s.record_id), ("WARC-Date", s.date), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{s.payload_digest}"), ("Content-Type", s.content_type)]
        if to := revisits.get(n):
            head = [("WARC-Type", "revisit"), *head, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to["record_id"]), ("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", to["date"]), ("WARC-Block-Digest", f"sha1:{digest(s.http)}"), ("X-Payload-Length", str(len(s.payload)))]
            head += [("X-Refers-To-Key", str(to["key"]))] if to["key"] is not None else []
            out.append(_gz(warc_record(head, s.http)))
        else:
            out.append(_gz(warc_record([("WARC-Type", s.kind), *head, ("WARC-Block-Digest", f"sha1:{s.block_digest}")], r.body)))
    return b"".join(out)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file; what can't be read is one last malformed record."""
    data, at = unpacked(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        headers = {a.strip().title(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
        size = _size(headers.get("Content-Length", ""))
        if not lines[0].startswith("WARC/") or "Warc-Type" not in headers or size is None or end + 4 + size > len(data):
            yield {"Warc-Type": "malformed"}, data[at:]
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


# -- tables


def write_arc(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """Archives (archive, data) with a record for each row of pages(page_id, url, html), whose key is
    a header of its response. Versions 1 and 2 take turns by page_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", ARCHIVE_BYTES):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
            version = 1 + (rows[0][0] or 0) % 2
            seed = hashlib.sha1(repr([(r[0], r[1], len(r[2] or "")) for r in rows]).encode()).hexdigest()
            name = f"legacy-{seed[:20]}"
            parts, offset = [arc_header(version, f"{name}.arc.gz", date)], 0
            offset = len(parts[0])
            for page_id, url, html in rows:
                payload = (html or "").encode()
                key = KEY_HEADER + str(page_id).encode() + b"\r\n" if page_id is not None else b""
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + key + b"Content-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
                parts.append(arc_record(version, url or "-", date, "text/html", body, f"{name}.arc.gz", offset))
                offset += len(parts[-1])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(map(_gz, parts))], pa.binary())], names=["archive", "data"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Rows of one partition may make equal archives of equal rows: the task and its count tell them apart.
    made = rows.mapInArrow(work, "archive string, data binary")
    return made.withColumn("archive", F.concat("archive", F.lit("-"), F.monotonically_increasing_id().cast("string")))


_INDEX = "archive string, n int, key long, digest string, length long, record_id string, date string, url string"


def index(arcs: DataFrame) -> DataFrame:
    """What the converter makes of each record, but for its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                rows = []
                for n, r in enumerate(arc_records(data.as_py())):
                    if not r.malformed:
                        s = synthesise(archive, r)
                        rows.append((archive, n, _whole(http_field(s.http, KEY_HEADER)), s.payload_digest, len(s.payload), s.record_id, s.date, r.url))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    return arcs.mapInArrow(work, _INDEX)


def to_warc(arcs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """ARC archives (archive, data), a written table, as WARC archives (archive, data). Of records with
    equal payloads of `least_bytes` or more, that with the largest key is a response, the others revisits."""
    listed = written(index(arcs), "arc-index")
    total = listed.count()
    able = listed.filter(F.col("length") >= least_bytes).withColumn("same", F.concat_ws(":", "digest", "length"))
    groups = able.groupBy("same").agg(F.max(F.struct("key", "record_id", "date", "url")).alias("first"), F.count("*").alias("records")).filter("records > 1")
    groups = written(groups, "groups")
    repeats = join_groups(able.select("archive", "n", "record_id", "same"), groups, "same", "records", total).filter(F.col("record_id") != F.col("first.record_id"))
    # As many as an archive has records at most.
    plan = written(repeats.groupBy("archive").agg(F.collect_list(F.struct("n", F.col("first.key").alias("key"), F.col("first.record_id").alias("record_id"), F.col("first.date").alias("date"), F.col("first.url").alias("url"))).alias("revisits")), "revisits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive, data, revisits = (batch.column(c)[i].as_py() for c in ("archive", "data", "revisits"))
                out = convert(archive, data, {r["n"]: r for r in revisits or []})
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([out], pa.binary())], names=["archive", "data"])

    out = written(arcs.join(plan, "archive", "left").mapInArrow(work, "archive string, data binary"), "warc", "none")
    drop_written(listed, groups, plan)
    return out


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, digest_ok boolean"


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record and digest_ok of
    each record that isn't about the archive. digest_ok says whether the digests of block and payload are those of
    the bytes; a revisit's payload digest and length must be those of the record that it refers to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("data"):
                for h, block in warc_records(data.as_py()):
                    if h["Warc-Type"] == "malformed":
                        rows.append((None, len(block), None, "malformed", None, h.get("Warc-Record-Id"), None, False))
                    elif h["Warc-Type"] != "warcinfo":
                        rows.append(_read(h, block))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    rows = written(archives.select("data").mapInArrow(work, _READ), "warc-rows")
    referring = rows.filter("record_type = 'revisit'")
    told = referring.groupBy("refers_to_record").agg(F.count("*").alias("_records"))
    first = rows.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_record"), F.struct("payload_digest", "payload_bytes").alias("_first"))
    told = written(told.join(first, "refers_to_record", "left"), "referred")
    checked = join_groups(referring.withColumn("refers_to_record", F.coalesce("refers_to_record", F.lit(""))), told.fillna("", ["refers_to_record"]), "refers_to_record", "_records", rows.count())
    same = F.coalesce(F.col("_first") == F.struct("payload_digest", "payload_bytes"), F.lit(False))
    checked = checked.withColumn("digest_ok", F.col("digest_ok") & same).select(*rows.columns)
    return rows.filter("record_type <> 'revisit'").unionByName(checked)


def _read(h: dict[str, str], block: bytes) -> tuple:
    """A row of read_warc() but for what it takes another record to know."""
    revisit = h["Warc-Type"] == "revisit"
    end = block.find(b"\r\n\r\n") if h.get("Content-Type", "").startswith("application/http") else -4
    http, payload = (block[: end + 4], block[end + 4 :]) if end != -1 else (block, b"")
    key, told = _whole(http_field(http, KEY_HEADER)), h.get("Warc-Payload-Digest", "").removeprefix("sha1:")
    ok = h.get("Warc-Block-Digest") == f"sha1:{digest(block)}" and (revisit or told == digest(payload))
    length = _size(h.get("X-Payload-Length", "")) if revisit else len(payload)
    return key, length, told or None, h["Warc-Type"], _whole(h.get("X-Refers-To-Key")), h.get("Warc-Record-Id"), h.get("Warc-Refers-To"), ok


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages written as ARC, converted to WARC and read back."""
    arcs = written(write_arc(pages), "arc", "none")
    warcs = to_warc(arcs, least_bytes)
    out = read_warc(warcs)
    drop_written(arcs, warcs)
    return out
