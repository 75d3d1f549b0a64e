"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Writing: digests are grouped with a partial minimum of the page id; only digests
that repeat are looked up. While their table is small by measure it is broadcast
and no page moves. Beyond that, rows meet it without their payloads, so that a
page copied very often costs a digest each; payloads move by (digest, page id)
and only those of responses go on. Each task writes archives of bounded size to
the shared folder. A dictionary is built from records of the archive and put in
front as a skippable frame; every record is one frame compressed with it, which
can be read alone from its offset. Names hold the task attempt; the manifest that
Spark commits lists the archives of the attempts that counted, so a lost task
leaves at most an unlisted file.

Reading: one task per archive streams the records and recomputes every digest.

Edge cases: a null payload is empty; a null url gives no target URI; rows of a
null page id are written, and never are what others refer to unless nothing else
could be; rows that repeat the first page's id and payload are each a response;
payloads under ``min_bytes`` are always responses; an archive of too few records
for the library's trainer takes the records themselves as its dictionary; columns
other than ``page_id, url, html`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, utf8

#: Payloads at least so long are looked up for equal ones.
MIN_BYTES = 0
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Records at the head of an archive that the dictionary is built from, in bytes, and the dictionary's size.
TRAIN_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
LEVEL = 3
#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of repeated digests that are broadcast; more are joined by shuffle.
BROADCAST_BYTES, DIGEST_BYTES = 32 << 20, 64
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "archive string, records long, dictionary_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """Dictionary of some records: trained by the library, or their own beginnings where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:65_536] for r in records], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:4_096] for r in records)[-DICTIONARY_BYTES:]


class ArchiveWriter:
    """One archive: buffers its first records, builds the dictionary from them and streams the rest."""

    def __init__(self, stream):
        self.stream, self.waiting, self.bytes, self.records, self.dictionary_bytes = stream, [], 0, 0, 0
        self.press: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.bytes += len(data)
        self.records += 1
        if self.press:
            self.stream.write(self.press.compress(data))
            return
        self.waiting.append(data)
        if self.bytes >= TRAIN_BYTES:
            self.start()

    def start(self) -> None:
        content = dictionary_of(self.waiting)
        self.dictionary_bytes = len(content)
        self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for data in self.waiting:
            self.stream.write(self.press.compress(data))
        self.waiting = []

    def close(self) -> None:
        if not self.press:
            self.start()
        self.stream.close()


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pyarrow.fs.FileSystem.from_uri(folder)
        task, writer, name, done = TaskContext.get(), None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    where.create_dir(path, recursive=True)
                    name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    # The name would make the file system wrap everything in one more frame.
                    writer = ArchiveWriter(where.open_output_stream(name, compression=None))
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                writer.add(record(row["page_id"], row["url"], row["payload"], row["size"], digest, row["first"], row["revisit"]))
                if writer.bytes >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((name, writer.records, writer.dictionary_bytes))
                    writer = None
        if writer:
            writer.close()
            done.append((name, writer.records, writer.dictionary_bytes))
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MANIFEST.split(", ")])

    return write


def with_first_page(rows: DataFrame, min_bytes: int = MIN_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, url, payload, size, digest, first, revisit``: revisits have no payload and name the first page with theirs."""
    long_enough = F.col("size") >= min_bytes
    repeated = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialise(repeated, "repeated-digests")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & long_enough, F.lit(False))
    columns = ["page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit")]
    if repeated.count() * DIGEST_BYTES <= broadcast_bytes:
        return rows.join(F.broadcast(repeated), "digest", "left").select(*columns)
    # Rows of one digest, however many, meet its first page in one partition; AQE splits such a partition, and the rows are slim.
    slim = rows.drop("payload").join(repeated, "digest", "left").withColumn("payload", F.lit(None).cast("binary")).select(*columns)
    slim = materialise(slim, "page-kinds")
    keys = slim.where("NOT revisit").select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest")).distinct()
    responses = rows.join(keys, (F.col("digest") == F.col("own_digest")) & F.col("page_id").eqNullSafe(F.col("own_id")), "left_semi")
    responses = responses.select("page_id", "url", "payload", "size", "digest", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
    return responses.unionByName(slim.where("revisit"))


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, str]:
    """Archives of ``pages(page_id, url, html)``: the manifest ``archive, records, dictionary_bytes`` and the folder."""
    folder = shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    return materialise(with_first_page(rows, min_bytes, broadcast_bytes).mapInArrow(_write(folder), MANIFEST), "warc-manifest"), folder


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        dictionary, rest = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    plain = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    text = io.BufferedReader(plain.stream_reader(_Chained(rest, stream), read_across_frames=True), 1 << 20)
    while line := text.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while line := text.readline().rstrip(b"\r\n"):
            key, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[key] = value
        block = text.read(int(headers["Content-Length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} does not end where its length says")
        yield headers, block


class _Chained(io.RawIOBase):
    """Some bytes that were already read, then the stream."""

    def __init__(self, head: bytes, stream):
        self.head, self.stream = head, stream

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.stream.read(n)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pyarrow.fs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in _READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with where.open_input_stream(archive, compression=None) as stream:
                    for headers, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{archive}: the payload of {headers['WARC-Record-ID']} does not match its digest")
                        page, refers = (int(v) if (v := headers.get(k)) is not None else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page, size, digest, kind, refers, archive.rpartition("/")[2]))
                        if len(rows) == 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return read


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in the manifest."""
    return manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(_read(folder), _READ)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, archive``."""
    return read_archives(*write_archives(pages, min_bytes))
