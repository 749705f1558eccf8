"""WARC archives: pages written as records, one gzip member each, and archives read back in sequence.

Writing: of pages with equal payloads (the html in UTF-8) of at least ``least`` bytes that with the smallest
page_id is a response, and the others revisit it: their records hold headers only, the payload's length among them.
Digests of payloads are grouped; a bitmap of those that occur twice tells which pages have to meet them, so most
pages are written where they are read. Each task writes archives under names of its own; the table of archives that
``write`` returns is settled, so what a lost or repeated task has left is in no table and never read.

Reading: bytes come in chunks, zlib inflates them a bounded piece at a time, a member's end is where the next record begins,
Content-Length says where its block ends, and SHA-1 digests of block and payload are compared with the headers. A record
is never held whole unless its payload is asked for. ``problem`` tells what is wrong with a record: ``header``, ``length``,
``block digest``, ``payload digest``; reading goes on with the next member. ``gzip`` and ``truncated`` end an archive.

A null html is an empty payload, a null url leaves its field out. Control characters and spaces of a url are percent-encoded.
Of equal payloads, all rows that share the smallest page_id are responses; a null page_id counts as the largest, and
if all are null, all are responses. An empty table gives no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .kernel import blocks

CHUNK = 1 << 16  # bytes read, and bytes inflated, at a time
ARCHIVE_BYTES = 1 << 30  # an archive is closed once it has so many
MOST_HEADER = 1 << 16
BITS_EACH, MOST_BITS = 16, 1 << 29  # of the bitmap of repeated digests: 64 MB at most
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, records bigint, bytes bigint"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record, uncompressed."""
    rows = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": "sha1:" + base32(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in rows.items()], "\r\n"]).encode() + block + b"\r\n\r\n"


def page_urn(page_id: object, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_record(page_id: object, url: str | None, digest: str, size: int, payload: bytes | None, first: object, date: str = DATE) -> bytes:
    """A response, or without a payload a revisit of the page ``first``."""
    fields = {"WARC-Record-ID": page_urn(page_id, digest), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if payload is None:
        fields |= {"WARC-Refers-To": page_urn(first, digest), "WARC-Profile": REVISIT}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("response" if payload is not None else "revisit", fields, head + (payload or b""))


class Archives:
    """The archives of one task: the next is begun where one has ``most`` bytes."""

    def __init__(self, folder: str, most: int, date: str):
        self.store, self.top = pyarrow.fs.FileSystem.from_uri(folder)
        self.scheme = folder[: folder.index(self.top)] if self.top in folder else ""
        self.most, self.date, self.out, self.done = most, date, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.store.create_dir(self.top, recursive=True)
            self.name, self.n, self.size = f"{self.top}/{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(self.name, compression=None)
            self._put(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._put(raw)
        self.n += 1
        if self.size >= self.most:
            self.close()

    def _put(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.scheme + self.name, self.n, self.size))
            self.out = None


def archiver(folder: str, most: int, date: str):
    """For mapInArrow over (page_id, url, payload, digest, first, revisit): writes archives, gives a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(folder, most, date)
        for b in blocks(batches, 2):
            page_ids, urls, payloads, digests, firsts, revisits = (b.column(k) for k in range(6))
            for i in range(b.num_rows):
                payload = payloads[i].as_py()
                digest = base32(bytes.fromhex(digests[i].as_py()))
                out.add(page_record(page_ids[i].as_py(), urls[i].as_py(), digest, len(payload), None if revisits[i].as_py() else payload, firsts[i].as_py(), date))
        out.close()
        names, n, size = zip(*out.done) if out.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return run


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, payload, digest) with the smallest page_id of those with the same payload, null where none other has it."""
    same = pages.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = settle(same.where("n > 1").select("digest", "first"), "same")
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * same.count()).bit_length()))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    maps = settle(same.groupBy(F.bitmap_bucket_number(place).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_m")), "bitmap")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_m", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & (F.octet_length("payload") >= least)
    # at most MOST_BITS / 8 bytes are broadcast
    marked = pages.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_b"), "left").withColumn("_maybe", maybe).drop("_b", "_m")
    met = marked.where("_maybe").drop("_maybe").join(same, "digest", "left").select(*pages.columns, "first")
    alone = marked.where("not _maybe").select(*pages.columns, F.lit(None).cast(pages.schema["page_id"].dataType).alias("first"))
    return alone.union(met)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page to archives in the folder; path, records and bytes of each archive. The folder is one that all executors see, in a store that pyarrow.fs knows."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    found = with_first(rows, least)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return settle(found.select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit")).mapInArrow(archiver(folder, archive_bytes, date), ARCHIVES), "archives")


class Damaged(Exception):
    pass


class Source:
    """Compressed bytes, a chunk at a time; what a member leaves over is given back."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.at = read, b"", 0

    def take(self) -> bytes:
        data, self.held = self.held or self.read(CHUNK), b""
        self.at += len(data)
        return data

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


class Member:
    """One gzip member, inflated as it is read."""

    def __init__(self, source: Source):
        self.source, self.z, self.buffer = source, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Adds some bytes to the buffer; False at the member's end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.source.take()
            if not data:
                raise Damaged("truncated")
            try:
                new = self.z.decompress(data, CHUNK)
            except zlib.error as e:
                raise Damaged("gzip") from e
            if self.z.eof:
                self.source.back(self.z.unused_data)
            if new:
                self.buffer += new
                return True
        return False

    def head(self) -> bytes:
        """All up to the first empty line; empty where there is none."""
        while b"\r\n\r\n" not in self.buffer:
            if len(self.buffer) > MOST_HEADER or not self._more():
                return b""
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, or as many as there are."""
        while n and (self.buffer or self._more()):
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> int:
        """How many bytes are left; they are passed over."""
        n = len(self.buffer)
        self.buffer = b""
        while self._more():
            n += len(self.buffer)
            self.buffer = b""
        return n


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    rows = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def one_record(member: Member, keep: bool) -> dict:
    """A member's record and what is wrong with it."""
    head = member.head()
    fields = fields_of(head)
    size = fields.get("content-length", "")
    if not head.startswith(b"WARC/1.") or not size.isdigit():
        member.rest()
        return {"problem": "header"}
    out = {"type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "problem": None}
    block, payload, kept, http, got, n = hashlib.sha1(), hashlib.sha1(), [], b"", 0, 0
    is_http = fields.get("content-type", "").startswith("application/http")
    inside = not is_http  # in the payload, behind the HTTP headers
    for piece in member.pieces(int(size)):
        block.update(piece)
        got += len(piece)
        if not inside:
            http += piece
            inside = b"\r\n\r\n" in http
            if not inside:
                continue
            http, _, piece = http.partition(b"\r\n\r\n")
        payload.update(piece)
        n += len(piece)
        if keep:
            kept.append(piece)
    tail = b"".join(member.pieces(4))
    if got != int(size) or tail != b"\r\n\r\n" or member.rest():
        return out | {"problem": "length"}
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + base32(block.digest()):
        out["problem"] = "block digest"
    elif out["type"] == "revisit":  # the payload stands elsewhere
        n, kept = int(fields_of(http).get("content-length", "0")), None
    elif told and told != base32(payload.digest()):
        out["problem"] = "payload digest"
    return out | {"payload_bytes": n, "payload_digest": told or base32(payload.digest()), "payload": b"".join(kept) if keep and kept is not None else None}


def records(read: Callable[[int], bytes], keep: bool = False) -> Iterator[dict]:
    """All records of an archive in turn, each with the offset of its member."""
    source = Source(read)
    while True:
        start = source.take()
        if not start:
            return
        source.back(start)
        at = source.at
        try:
            found = one_record(Member(source), keep)
        except Damaged as e:
            yield {"offset": at, "problem": str(e)}
            return
        yield {"offset": at} | found


RECORDS = "path string, offset bigint, type string, record_id string, url string, date string, refers_to string, payload_bytes bigint, payload_digest string, problem string, payload binary"
SENT = 4 << 20


def reader(keep: bool):
    """For mapInArrow over paths of archives: their records, some SENT bytes of payload at a time."""
    kinds = pa.schema([(k, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for k, t in (c.split() for c in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = pyarrow.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as f:
                    for x in records(f.read, keep):
                        rows.append({"path": path} | x)
                        size += len(x.get("payload") or b"")
                        if len(rows) == 4096 or size >= SENT:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def read(archives: DataFrame, keep: bool = False) -> DataFrame:
    """RECORDS of the archives at column ``path``, each read by one task from its first to its last byte; payloads only if ``keep``."""
    paths = archives.select("path")
    return paths.repartition(min(50_000, max(1, paths.count()))).mapInArrow(reader(keep), RECORDS)


def report(found: DataFrame, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages; a damaged record is an error."""
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*):[A-Z2-7]{32}>$", 1), F.lit("")).cast(kind)
    sound = F.when(F.col("problem").isNull(), F.col("type")).otherwise(F.raise_error(F.concat_ws(" ", "path", F.col("offset").cast("string"), "problem")).cast("string"))
    rows = found.withColumn("record_type", sound).where("record_type <> 'warcinfo'")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
