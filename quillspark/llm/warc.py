"""Legacy archive converter: ARC files, versions 1 and 2, become WARC 1.1 files, which are read back.

An ARC file starts with a filedesc record whose body names the version and the fields of the header lines that follow;
each record is its header line, as many bytes as the line's last field declares, and a newline. Version 1 lines have five
fields, version 2 lines ten. The converter reads lines by the file's own version, from the fields of a fixed form (address, date,
length), so URLs and content types may hold spaces; it takes bodies by declared length only, and makes of each record a WARC record with
a record id (a UUID from the row or place, URL, date and digest), an ISO timestamp, a type and SHA-1 digests; of the filedesc record it makes
the warcinfo record. Records that are not HTTP, such as dns, become resources. Of records with equal payloads of at least `min_bytes`
bytes one is a response; the others are revisits that name its id, URL and date and carry their own HTTP headers, with the payload's
length, but no payload.

`convert_arc` reads a folder of ARC files, plain or gzipped. What follows a broken header line or ends too early comes back as a row
with an error, beside the sound records of the file. `convert` packs a table of pages as ARC first.

WARC records are gzip members of their own. Spark's text writer puts some `segment_bytes` of them in a file, ended by a zero
byte, which gzip readers skip, in the folder that all executors share, and its binary reader reads them; nothing is written by
tasks themselves. Copies are found by digest: only (digest, place) pairs are grouped, and a digest of a third of all rows is
counted before the shuffle.

Defined results: a null payload is empty; empty and small payloads are always responses; a null or odd URL is
percent-encoded or replaced by urn:row:N; rows of one page_id are separate records; if they are copies and the id is the
largest, all rows of that id are responses. A null page_id never is the largest; a group of copies without an id refers to nothing
and is all responses. Other columns are not read. An empty table or folder gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, table, written

MIN_BYTES = 1000
SEGMENT_BYTES = 64 << 20
DATE = "20240101000000"
#: Fields of a header line in each version of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: The same lines by the form of their fields.
LINES = {
    1: re.compile(r"(.*) ([0-9a-fA-F.:]+) (\d{4,17}) (.*) (\d+)"),
    2: re.compile(r"(.*) ([0-9a-fA-F.:]+) (\d{4,17}) (.*?) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)"),
}
ROW, REFERS = "X-Row", "X-Refers-To-Row"
SOFTWARE = "quillspark"


def arc_record(version: int, url: str, body: bytes, offset: int, name: str, date: str = DATE) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", "-", "-", str(offset), name]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_start(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 quillspark\n{FIELDS[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_file(rows: list[tuple[int | None, str | None, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (row, url, payload); HTTP headers carry the row."""
    out = [arc_start(version, name)]
    offset = len(out[0])
    for row, url, payload in rows:
        url = page_url(row, url)
        mark = f"{ROW}: {row}\r\n" if row is not None else ""
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode() + payload
        out.append(arc_record(version, url, body, offset, name))
        offset += len(out[-1])
    return b"".join(out)


class Reader:
    """Bytes that come in pieces, read in order: what was read is let go, at a cost in proportion to the bytes."""

    def __init__(self, pieces: bytes | Iterable[bytes]):
        self.pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
        self.held, self.at, self.before = bytearray(), 0, 0

    @property
    def offset(self) -> int:
        return self.before + self.at

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > len(self.held) // 2:
            del self.held[: self.at]
            self.before, self.at = self.before + self.at, 0
        self.held += piece
        return True

    def peek(self) -> bytes:
        while self.at >= len(self.held):
            if not self.more():
                return b""
        return bytes(self.held[self.at : self.at + 1])

    def line(self) -> bytes | None:
        """The next line without its end; None if there is none. Nothing is read yet."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self.more():
                return None
        return bytes(self.held[self.at : end])

    def has(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        self.at += n
        return bytes(self.held[self.at - n : self.at])

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.take(len(self.held) - self.at)


def arc_records(data: bytes | Iterable[bytes]) -> Iterator[dict]:
    """Offset, header fields and body of each record, the filedesc record included, as the pieces of a file come. What can't be read is a last record with an error and the bytes."""
    read, version = Reader(data), None

    def broken(why: str) -> dict:
        return {"offset": read.offset, "error": why, "body": read.rest()}

    while first := read.peek():
        if first in b"\r\n":
            read.take(1)
            continue
        raw = read.line()
        line = (raw or b"").decode("utf-8", "replace").rstrip("\r")
        # the first line may be of either version; its body tells
        got = LINES[version].fullmatch(line) if version else LINES[2].fullmatch(line) or LINES[1].fullmatch(line)
        if raw is None or not got:
            yield broken("no header line of the file's version")
            return
        at, length, head = read.offset, int(got[got.lastindex]), len(raw) + 1
        if not read.has(head + length):
            yield broken("the file ends inside a record")
            return
        body = read.take(head + length)[head:]
        if version is None:
            named = body.split(b" ", 1)[0]
            if not named.isdigit() or int(named) not in FIELDS:
                yield {"offset": at, "error": "the first record names no known version", "body": raw + b"\n" + body + read.rest()}
                return
            version = int(named)
            got = LINES[1].fullmatch(line) if version == 1 else got
        fields = dict(zip(FIELDS[version].split(), got.groups(), strict=False))
        yield fields | {"offset": at, "version": version, "body": body, "error": None}


def read_arc(data: bytes) -> Iterator[dict]:
    """The records after the first; a file with a fault is an error."""
    for i, x in enumerate(arc_records(data)):
        if x["error"]:
            raise ValueError(x["error"])
        if i:
            yield x


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso(date: str) -> str:
    d = date[:14] + "20000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(place: object, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((str(place), url, date, digest)))}>"


def written_record(kind: str, place: object, url: str, date: str, block: bytes, lines: list[str]) -> bytes:
    """A WARC record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {iso(date)}", *([f"WARC-Target-URI: {url}"] if kind != "warcinfo" else []), *lines]
    head += [f"WARC-Block-Digest: {sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def warc_info(name: str, version: int, date: str = DATE) -> bytes:
    """Of a filedesc record, or of the start of a file."""
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {version}\r\n".encode()
    return written_record("warcinfo", name, "", date, block, [f"WARC-Record-ID: {record_id(name, 'warcinfo', date, '')}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"])


def warc_record(arc: dict, place: object, refers: dict | None = None) -> bytes:
    """The WARC record for an ARC record; refers has the place, row, url and date of the response that a revisit refers to."""
    url, date = arc["URL"], arc["Archive-date"]
    lines = [f"WARC-IP-Address: {arc['IP-address']}"]
    if not arc["body"].startswith(b"HTTP/"):
        digest = sha1(arc["body"])
        return written_record("resource", place, url, date, arc["body"], [f"WARC-Record-ID: {record_id(place, url, date, digest)}", *lines, f"WARC-Payload-Digest: {digest}", f"Content-Type: {arc['Content-type']}"])
    head, _, payload = arc["body"].partition(b"\r\n\r\n")
    digest = sha1(payload)
    lines = [f"WARC-Record-ID: {record_id(place, url, date, digest)}", *lines, f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers['place'], refers['url'], refers['date'], digest)}",
            f"WARC-Refers-To-Target-URI: {refers['url']}", f"WARC-Refers-To-Date: {iso(refers['date'])}", *([f"{REFERS}: {refers['row']}"] if refers.get("row") is not None else []),
        ]
    return written_record("response" if refers is None else "revisit", place, url, date, head + b"\r\n\r\n" + (payload if refers is None else b""), lines)


class Fault(ValueError):
    """A gzip member that can't be unpacked, and the packed bytes from its start."""

    def __init__(self, why: str, rest: bytes):
        super().__init__(why)
        self.rest = rest


def members(data: bytes) -> Iterator[bytes]:
    """What each gzip member holds, one at a time; a plain file is one member. Packed bytes are handed on in slices that grow from a few KB, so what is left of
    a slice after a member ends is no more than the member and the time is linear in the file."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at] == 0:  # zero bytes between members
            at += 1
            continue
        one, start, size, out = zlib.decompressobj(31), at, 1 << 11, []
        try:
            while not one.eof and at < len(data):
                out.append(one.decompress(view[at : at + size]))
                at, size = min(len(data), at + size), min(2 * size, 1 << 20)
        except zlib.error as fault:
            raise Fault(str(fault), bytes(view[start:])) from fault
        if not one.eof:
            raise Fault("the gzip member is not whole", bytes(view[start:]))
        at -= len(one.unused_data)
        yield b"".join(out)


HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        warc = {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(data[at:end])}
        length = int(warc["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if sha1(block) != warc["WARC-Block-Digest"]:
            raise ValueError(f"record {warc['WARC-Record-ID']} does not match its digest")
        head, _, payload = block.partition(b"\r\n\r\n")
        yield warc, {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(head)}, payload
        at = end + 4 + length


def page_url(row: int | None, url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url and url.strip() else f"urn:row:{row}"


def references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers, refers_url): the copies that become revisits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes).drop("n")
    copies = rows.where("page_id is not null").groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.min("page_id").alias("low")).where("low < last.page_id")
    copies = copies.select("digest", F.col("last.page_id").alias("refers"), F.col("last.url").alias("refers_url"))
    return rows.drop("url").join(copies, "digest").where("page_id < refers").distinct()


def save(segments: DataFrame, name: str) -> str:
    """Rows (records: a file's gzip members) as files in a new shared folder; returns the folder."""
    folder = new_path(segments.sparkSession, name)
    segments.select(F.col("records").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)
    return folder


def convert(pages: DataFrame, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> str:
    """Pages as ARC files, by turns of both versions, converted to WARC files in a new shared folder; returns the folder. Of copies the
    one with the largest page_id is the response."""
    refs = references(pages, min_bytes).withColumnsRenamed({"page_id": "r_page", "digest": "r_digest"})
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(refs, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn, some = [], 0, 0, False
        for batch in batches:
            for row, url, payload, refers, refers_url in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not held:
                    held.append(warc_info("pages.arc", 1 + turn % 2))
                arc = next(read_arc(arc_file([(row, url, payload)], 1 + turn % 2, "pages.arc")))
                to = {"place": refers, "row": refers, "url": page_url(refers, refers_url), "date": DATE} if refers is not None else None
                held.append(warc_record(arc, row if row is not None else (arc["body"][:200], arc["offset"]), to))
                size, some = size + len(payload), True
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["records"])
                    held, size, turn, some = [], 0, turn + 1, False
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["records"])

    return save(rows.select("page_id", "url", "payload", "refers", "refers_url").mapInArrow(run, "records binary"), "warc")


_ARC = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), *[(c, pa.string()) for c in ("url", "ip", "date", "kind")], ("body", pa.binary()), ("digest", pa.string()), ("n_payload", pa.int64()), ("error", pa.string())])


def sound_records(content: bytes) -> Iterator[dict]:
    """The records of a file, plain or gzipped, up to a member that can't be unpacked, which is a last record with an error and its packed bytes."""
    fault = []

    def pieces() -> Iterator[bytes]:
        try:
            yield from members(content)
        except Fault as found:
            fault.append(found)

    end = 0
    for x in arc_records(pieces()):
        if fault and x["error"]:
            end = x["offset"]
            break
        yield x
        end = x["offset"]
    if fault:
        yield {"offset": end, "error": str(fault[0]), "body": fault[0].rest}


def read_arcs(spark, folder: str) -> DataFrame:
    """(file, offset, version, url, ip, date, kind, body, digest, n_payload, error): the records of a folder of ARC files, plain or gzipped; rows with an error hold what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows, size = [], 0
                for x in sound_records(content):
                    payload = x["body"].partition(b"\r\n\r\n")[2] if x["body"].startswith(b"HTTP/") else x["body"]
                    rows.append((name, x["offset"], x.get("version"), x.get("URL"), x.get("IP-address"), x.get("Archive-date"), x.get("Content-type"), x["body"], hashlib.sha1(payload).hexdigest(), len(payload), x["error"]))
                    size += len(x["body"])
                    if size >= 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARC.types, strict=True)], schema=_ARC)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARC.types, strict=True)], schema=_ARC)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, offset bigint, version int, url string, ip string, date string, kind string, body binary, digest string, n_payload bigint, error string")


def convert_arc(spark, folder: str, min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES) -> tuple[str, DataFrame]:
    """A folder of ARC files as WARC files in a new shared folder: (the folder, rows with an error). Of copies the first by date, file and
    offset is the response."""
    found = written(read_arcs(spark, folder), "arcs")
    sound = found.where("error is null")
    first = sound.where((F.col("n_payload") >= min_bytes) & F.col("body").startswith(F.lit(b"HTTP/"))).groupBy("digest").agg(F.min(F.struct("date", "file", "offset", "url")).alias("r"))
    refs = first.select(F.col("digest").alias("r_digest"), F.col("r.date").alias("r_date"), F.col("r.file").alias("r_file"), F.col("r.offset").alias("r_offset"), F.col("r.url").alias("r_url"))
    rows = sound.join(refs, F.col("digest") == F.col("r_digest"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                arc = {"URL": x["url"], "IP-address": x["ip"], "Archive-date": x["date"], "Content-type": x["kind"], "body": x["body"]}
                if x["url"].startswith("filedesc:"):
                    held.append(warc_info(x["url"].removeprefix("filedesc://"), x["version"], x["date"]))
                else:
                    own = x["r_digest"] is None or (x["r_file"], x["r_offset"]) == (x["file"], x["offset"])
                    to = None if own else {"place": (x["r_file"], x["r_offset"]), "url": x["r_url"], "date": x["r_date"]}
                    held.append(warc_record(arc, (x["file"], x["offset"]), to))
                size += len(x["body"])
                if size >= segment_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["records"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["records"])

    return save(rows.drop("error", "digest", "n_payload").mapInArrow(run, "records binary"), "warc"), found.where("error is not null")


def read_archives(spark, folder: str) -> DataFrame:
    """(row, url, record_type, record_id, payload_bytes, payload_digest, refers_to) of every response and revisit in a folder of WARC files."""
    schema = pa.schema(
        [("row", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for warc, http, payload in (x for member in members(data.as_py()) for x in read_warc(member)):
                    if warc["WARC-Type"] not in ("response", "revisit"):
                        continue
                    n = int(http.get("Content-Length", len(payload)))
                    digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if warc["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {warc['WARC-Record-ID']} is not whole")
                    row, refers = http.get(ROW), warc.get(REFERS)
                    rows.append((row and int(row), warc["WARC-Target-URI"], warc["WARC-Type"], warc["WARC-Record-ID"], n, digest, refers and int(refers)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "row bigint, url string, record_type string, record_id string, payload_bytes bigint, payload_digest string, refers_to bigint")


def op4(spark, sf_dir: str) -> DataFrame:
    found = read_archives(spark, convert(table(spark, sf_dir, "pages")))
    return found.select(F.col("row").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
