"""Legacy archives: ARC files (versions 1 and 2) become WARC files, and WARC files become rows.

An ARC file starts with a version block, a record of its own ("filedesc://...") whose body
names the version and the fields of the header lines that follow:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

A header line is followed by exactly Archive-length bytes and a line feed. The converter
reads lines by the declared version and content by the declared length, then makes up what
WARC wants and ARC lacks: a record id (a UUID from URL, date and payload digest, so reruns
agree), an ISO date, the record type (warcinfo, response, resource, revisit) and SHA-256
digests of block and payload. Records are gzip members of their own.

Archives live in a folder that all executors share. A task gives its files names of its own
and reports them as rows; only the reported files of tasks that succeeded are read, so a
lost executor leaves unused files but no wrong ones.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, settle

#: Uncompressed bytes after which the next archive file starts; payloads of fewer bytes are never revisits.
ROLL, SAME_FROM = 16 << 20, 100
#: A payload of more records is met by each task and not by key.
HEAVY = 100_000
#: Header fields by ARC version.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_STAMP = re.compile(r"(\d{4})(\d\d)(\d\d)(\d\d)?(\d\d)?(\d\d)?\d*")


class ArcError(ValueError):
    """Bytes that aren't the ARC record their header line declares."""


def arc_header(version: int, url: str, length: int, when: str = "19970101000000", kind: str = "text/html", name: str = "-", offset: int = 0, status: int = 200) -> bytes:
    """A header line of this version."""
    shown = quote(url or "urn:none", safe=":/?#[]@!$&'()*+,;=%~-._")
    middle = [] if version == 1 else [str(status), "-", "-", str(offset), name]
    return (" ".join([shown, "0.0.0.0", when, kind, *middle, str(length)]) + "\n").encode("ascii")


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 legacy\n{FIELDS[version]}\n".encode("ascii")
    return arc_header(1 if version == 1 else 2, f"filedesc://{name}", len(body), kind="text/plain", name=name) + body + b"\n"


def parse_arc(data: bytes):
    """(header dict, content, offset) of each record after the version block. ArcError where a header line or length is wrong."""
    version, fields, at = None, None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no header line at {at}")
        line = data[at:end].decode("latin-1").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ArcError("no version block")
        elif len(line) < len(fields):
            raise ArcError(f"{len(line)} fields at {at}, not {len(fields)}")
        try:
            length = int(line[-1])
        except ValueError:
            raise ArcError(f"no length at {at}") from None
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ArcError(f"{len(content)} of {length} bytes at {at}")
        if fields is None:
            first, named = content.split(b"\n")[:2]
            version, fields = int(first.split()[0]), named.decode("ascii").split(" ")
            if version not in FIELDS or fields != FIELDS[version].split(" "):
                raise ArcError(f"unknown version or fields: {version} {fields}")
        else:
            # A URL of version 1 may hold spaces; the other fields can't.
            extra = len(line) - len(fields)
            yield dict(zip(fields, [" ".join(line[: extra + 1]), *line[extra + 1 :]], strict=True)) | {"version": version}, content, at
        at = end + 1 + length
        while data[at : at + 1] == b"\n":
            at += 1


def iso_date(stamp: str) -> str:
    """An ARC date (8 to 14 digits or more) as a WARC date; the epoch where it isn't one."""
    m = _STAMP.fullmatch(stamp)
    return "{}-{}-{}T{}:{}:{}Z".format(*(x or "00" for x in m.groups())) if m else "1970-01-01T00:00:00Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block with its blank line, and payload; no header block if it isn't a response."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def http_field(block: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", block)
    return m[1].decode("latin-1") if m else None


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def convert(header: dict, content: bytes, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit with the HTTP headers alone where refers_to names an earlier page."""
    http, payload = split_http(content)
    url, when, digest = header["URL"], iso_date(header["Archive-date"]), hashlib.sha256(payload).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {when} {digest} {http_field(http, 'X-Page-Id')}")
    fields = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-IP-Address", header["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http;msgtype=response")]
        return warc_record("revisit", fields, http)
    if http:
        return warc_record("response", [*fields, ("Content-Type", "application/http;msgtype=response")], content)
    return warc_record("resource", [*fields, ("Content-Type", header["Content-type"])], content)


def parse_warc(data: bytes):
    """(header dict with lower-case names, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at {at}")
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(header["content-length"])
        yield header, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Writer:
    """Archive files of a task: gzip members, a new file after ROLL bytes."""

    def __init__(self, folder: str, suffix: str, opening):
        self.fs, self.top = _filesystem(folder)
        self.fs.create_dir(self.top, recursive=True)
        self.suffix, self.opening, self.done, self.name = suffix, opening, [], None

    def add(self, record: bytes) -> None:
        if self.name is None:
            self.name, self.out, self.size, self.records = f"{uuid.uuid4().hex}{self.suffix}", io.BytesIO(), 0, 0
            self.put(self.opening(self.name))
        self.put(record)
        self.records += 1
        if self.size >= ROLL:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(gzip.compress(data, 1, mtime=0))
        self.size += len(data)

    def close(self) -> None:
        if self.name is not None:
            with self.fs.open_output_stream(f"{self.top}/{self.name}", compression=None) as f:
                f.write(self.out.getbuffer())
            self.done.append((self.name, self.records, self.size))
            self.name = None


_FILES = "file string, records long, size long"


def _reported(writer: _Writer):
    names, counts, sizes = zip(*writer.done, strict=True) if writer.done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "size"])


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as ARC files, version 1 or 2 by file; returns the files. Null html is an empty payload."""

    def written(batches):
        version = {}

        def opening(name):
            version[0] = 1 + zlib.crc32(name.encode()) % 2
            return arc_version_block(version[0], name)

        writer = _Writer(folder, ".arc.gz", opening)
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
                if writer.name is None:
                    writer.add(b"")
                    writer.records -= 1
                content = http + payload
                writer.add(arc_header(version[0], url, len(content), name=writer.name, offset=writer.size) + content + b"\n")
        writer.close()
        yield _reported(writer)

    return settle(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(written, _FILES), "arc-files")


def _read(folder: str, name: str) -> bytes:
    fs, top = _filesystem(folder)
    # One reader over all members: decompress() would copy what is left of the file for each of them.
    with fs.open_input_stream(f"{top}/{name}", compression=None) as f, gzip.GzipFile(fileobj=io.BytesIO(f.read())) as members:
        return members.read()


def read_arc(files: DataFrame, folder: str) -> DataFrame:
    """Records of ARC files: their file, place in it (from 0), page_id, and digest and size of the payload."""
    names = ["file", "nth", "page_id", "digest", "payload_bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def parsed(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for nth, (_, content, _) in enumerate(parse_arc(_read(folder, name))):
                    http, payload = split_http(content)
                    page = http_field(http, "X-Page-Id")
                    rows.append((name, nth, int(page) if page else None, hashlib.sha256(payload).hexdigest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return _spread(files.select("file")).mapInArrow(parsed, "file string, nth long, page_id long, digest string, payload_bytes long")


def _spread(files: DataFrame) -> DataFrame:
    """One file or a few for each task, dealt in turn and not by hash."""
    return files.repartition(max(1, min(files.count(), 100_000)))


def revisits(index: DataFrame) -> DataFrame:
    """(file, nth, refers_to) of the records of read_arc() that repeat the payload of another of at least SAME_FROM bytes.

    Digests of more than HEAVY records, of which there are few, are sent to the tasks, so no digest gathers its records in
    one of them.
    """
    index = index.where(F.col("payload_bytes") >= SAME_FROM)
    same = settle(index.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null"), "same")
    heavy = F.broadcast(same.where(F.col("n") > HEAVY).select("digest", F.col("keeper").alias("heavy")))
    first = index.join(heavy, "digest", "left")
    light = first.where("heavy is null").join(same.where(F.col("n") <= HEAVY), "digest").select("file", "nth", "page_id", "keeper")
    every = light.unionByName(first.where("heavy is not null").select("file", "nth", "page_id", F.col("heavy").alias("keeper")))
    return every.where("page_id is null or page_id <> keeper").select("file", "nth", F.col("keeper").alias("refers_to"))


def write_warc(files: DataFrame, legacy: str, repeats: DataFrame, folder: str) -> DataFrame:
    """Convert the ARC files in the folder legacy to WARC files; returns the files. A task takes its files with their own part of
    repeats (of revisits()), and contents stay in it."""

    def opening(name):
        body = f"software: phrasewright\r\nformat: WARC File Format 1.1\r\nconformsTo: {name}\r\n".encode()
        return warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)

    def written(batches):
        writer = _Writer(folder, ".warc.gz", opening)
        for batch in batches:
            for name, known in zip(batch.column("file").to_pylist(), batch.column("known").to_pylist(), strict=True):
                refers = {x["nth"]: x["refers_to"] for x in known or ()}
                for nth, (header, content, _) in enumerate(parse_arc(_read(legacy, name))):
                    writer.add(convert(header, content, refers.get(nth)))
        writer.close()
        yield _reported(writer)

    own = repeats.groupBy("file").agg(F.collect_list(F.struct("nth", "refers_to")).alias("known"))
    dealt = _spread(settle(files.select("file").join(own, "file", "left"), "dealt"))
    return settle(dealt.mapInArrow(written, _FILES), "warc-files")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """Rows of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date, url. Digests
    of responses are taken from the payload read; a revisit has those of its headers."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def parsed(batches):
        for batch in batches:
            rows = []
            for name in batch.column("file").to_pylist():
                for header, block in parse_warc(_read(folder, name)):
                    if header["warc-type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    page, revisit = http_field(http, "X-Page-Id"), header["warc-type"] == "revisit"
                    size, digest = (int(http_field(http, "Content-Length")), header["warc-payload-digest"].partition(":")[2]) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
                    rows.append((int(page) if page else None, size, digest, header["warc-type"], int(header["x-refers-to-page"]) if revisit else None, header["warc-record-id"], header["warc-date"], header["warc-target-uri"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return _spread(files.select("file")).mapInArrow(parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, url string")


def archive(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, ARC to WARC files, and the WARC records read back, one row per page.

    Of equal payloads of SAME_FROM bytes or more the record with the smallest page_id is the response (each, if several rows
    have it), the others revisit it; without any page_id all are responses. Null html is an empty payload; a null url becomes
    urn:none. Repeated rows are records of their own. An empty table gives no files and no rows.
    """
    spark = pages.sparkSession
    legacy, modern = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    files = write_arc(pages, legacy)
    repeats = revisits(settle(read_arc(files, legacy), "index"))
    return read_warc(write_warc(files, legacy, repeats, modern), modern)
