"""Web archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

Writing: every partition writes archives of its own, closed at ``ARCHIVE_BYTES``. The dictionary of an archive is trained
on the first records it gets. A task writes under a name of its own attempt and hands back one row per closed archive;
that table of archives, which Spark commits, says which files count, so a lost or repeated task leaves at most files that
nobody lists. Files go through Arrow's file systems, so the folder may be on any of them.

Reading: archives are dealt out to tasks; each reads its file as a stream, a frame at a time, and checks the frame's
stated size, the version line, header fields, the block's length, the end of the record, and the digest of the payload.
Anything that does not hold ends the job with the file and the place.

Equal payloads of at least ``REVISIT_BYTES``: the record with the smallest id is the response, the others are revisits
of it, with the HTTP header but without the payload.

Defined cases. Null html is an empty payload, null url an empty address. Rows that repeat the smallest id are responses
each. A row without an id gets an empty id field, which reads as null; it is a response unless an equal payload has an
id. Extra columns are not written. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.llm.common import prepare, written
from seqcast.session import new_table_folder

#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Payload bytes from which equal payloads are stored once.
REVISIT_BYTES = 100
#: Records and bytes that an archive's dictionary is trained on, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 32 << 10
LEVEL = 3
#: Fixed values of the format.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


class ArchiveError(ValueError):
    """An archive that is not what its headers say."""


def file_system(uri: str):
    """Arrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    address = re.sub(r"[\r\n]", " ", url or "").strip(" \t")
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {digest} {address}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Page-ID", name),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[5:5] = [("WARC-Profile", PROFILE.decode()), ("Refers-To-Page-ID", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields, block and payload of a record, checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ArchiveError("no version line or no end of the header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.lower() in fields:
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    try:
        length = int(fields[b"content-length"])
        kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode()
        page = fields[b"page-id"].decode()
    except (KeyError, ValueError) as e:
        raise ArchiveError(f"missing or bad field: {e}") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, stated {length}")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", http)
    if not found or not http.startswith(b"HTTP/1.1 ") or not stated:
        raise ArchiveError("no HTTP header")
    size = int(stated[1])
    if not digest.startswith("sha256:") or kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown digest or type: {digest[:20]}, {kind}")
    digest = digest.removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError("payload differs from its length or digest")
    if kind == "revisit" and (payload or b"refers-to-page-id" not in fields):
        raise ArchiveError("a revisit with a payload or without the record it refers to")
    refers = fields[b"refers-to-page-id"].decode() if kind == "revisit" else None
    return {"page_id": page or None, "url": fields.get(b"warc-target-uri", b"").decode(), "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": refers, "payload": payload if kind == "response" else None}


class _Archive:
    """One archive that is being written. Its first records wait until there are enough to train on."""

    def __init__(self, folder: str, name: str):
        system, path = file_system(f"{folder}/{name}")
        self.name, self.stream = name, system.open_output_stream(path, compression=None)
        self.waiting: list[bytes] = []
        self.packer, self.records, self.payload, self.size = None, 0, 0, 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _start(self) -> None:
        dictionary = None
        if len(self.waiting) >= 16:  # fewer records give the trainer too little
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
            except zstandard.ZstdError:
                dictionary = None  # records too small or too alike to learn from
        plain = dictionary.as_bytes() if dictionary else b""
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(plain)) + plain)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for raw in self.waiting:
            self._put(self.packer.compress(raw))
        self.waiting = []

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.payload += len(raw)
        if self.packer:
            self._put(self.packer.compress(raw))
            return
        self.waiting.append(raw)
        if len(self.waiting) >= SAMPLE_RECORDS or self.payload >= SAMPLE_BYTES:
            self._start()

    def close(self) -> tuple[str, int, int]:
        if not self.packer:
            self._start()
        self.stream.close()
        return self.name, self.records, self.size


def _writer(folder: str, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        closed, archive = [], None
        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(folder, f"pages-{task}-{len(closed):05d}.warc.zst")
                archive.add(record(page, url, (html or "").encode(), digest, refers, date))
                if archive.payload >= archive_bytes:
                    closed.append(archive.close())
                    archive = None
        if archive:
            closed.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed, strict=True) if closed else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row and returns the table of archives: path, records, bytes."""
    prepare(pages.sparkSession)
    folder = folder or new_table_folder(pages.sparkSession, "archives")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    large = F.octet_length("html") >= REVISIT_BYTES
    first = rows.where(large).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    # Rows that share no payload meet under a key of their own, not under one that all of them have.
    met = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.xxhash64("url").cast("string")))
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    linked = rows.join(first, met == F.col("same"), "left").select("page", "url", "html", "digest", refers.alias("refers"))
    return written(linked.mapInArrow(_writer(folder, archive_bytes, date), "archive string, records long, bytes long").withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive")), "archives")


def frames(stream, name: str) -> Iterator[bytes]:
    """The content of every frame of an archive, in order, with the dictionary of its leading frame."""

    def fail(why: str):
        raise ArchiveError(f"{name}, before byte {stream.tell()}: {why}")

    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        fail("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    plain = stream.read(size)
    if len(plain) != size:
        fail("the dictionary is cut off")
    if plain[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be packed itself
        plain = zstandard.ZstdDecompressor().decompressobj().decompress(plain)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain) if plain else None)
    data = stream.read(_READ)
    while data:
        unpacker, out = opener.decompressobj(), []
        while len(data) < 18 and (more := stream.read(_READ)):
            data += more
        if data[:4] != struct.pack("<I", FRAME_MAGIC):
            fail("something else than a frame")
        stated = zstandard.get_frame_parameters(data).content_size
        while True:
            try:
                out.append(unpacker.decompress(data))
            except zstandard.ZstdError as e:
                fail(f"a frame that doesn't unpack ({e})")
            if unpacker.eof:
                break
            data = stream.read(_READ)
            if not data:
                fail("the last frame is cut off")
        content = b"".join(out)
        if stated not in (zstandard.CONTENTSIZE_UNKNOWN, len(content)):
            fail(f"a frame of {len(content)} bytes, stated {stated}")
        yield content
        data = unpacker.unused_data or stream.read(_READ)


def _reader(with_payload: bool):
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] if with_payload or n != "payload" else None for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(uri)
                found, held, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream, uri):
                        try:
                            found.append(parsed(raw))
                        except ArchiveError as e:
                            raise ArchiveError(f"{uri}, record {n}: {e}") from e
                        n += 1
                        held += len(raw)
                        if held > 4 << 20 or len(found) >= 4096:
                            yield rows(found)
                            found, held = [], 0
                if expected is not None and n != expected:
                    raise ArchiveError(f"{uri}: {n} records, {expected} were written")
                if found:
                    yield rows(found)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, key_type: str = "long", with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives (columns archive and, where known, records): page_id, url, record_type,
    payload_digest, payload_bytes, refers_to and, for responses if asked for, payload."""
    prepare(spark)
    listed = archives.select("archive", F.col("records") if "records" in archives.columns else F.lit(None).cast("long").alias("records"))
    dealt = listed.repartition(max(1, listed.count()))
    found = dealt.mapInArrow(_reader(with_payload), "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})
