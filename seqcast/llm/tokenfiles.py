"""Token-id files: canonical length-limited Huffman coding, decoded by table in independent blocks.

The ids of all documents are counted, and one code of at most ``LIMIT`` bits is built from the counts (package-merge; a
vocabulary bounds its size). A document is a block of its own that begins at a byte; within it the bit offset of every
``CHECKPOINT`` th id is stored, so decoding can begin there. A task decodes all checkpoints of a segment side by side,
one id of each at a time, through a table of 2 ** LIMIT entries.

File (numbers little-endian): magic, LIMIT, CHECKPOINT, and the code lengths of all ids, from which the code follows.
Then segments: counts of documents, checkpoints and payload bytes; ids of documents with a mark for null; counts of
their ids; bit offsets of the checkpoints from the beginning of the document; payload. A segment of no documents ends
the file. Files lie in ascending order of document id, one or more for each range of ids; each task names its files
after its own attempt, and the table of files, committed by Spark, says which ones count and in which order.

Defined cases. Null and empty text: only the end id. Rows that repeat an id are all stored, ordered by their content. A
null id comes first. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqcast.llm.common import prepare, written
from seqcast.llm.tokens import vocabulary_path, worker_encoder
from seqcast.llm.warc import ArchiveError, file_system
from seqcast.session import new_table_folder

MAGIC = b"IDHUFF01"
#: Bits of the longest code, so that the decoding table has 65,536 entries.
LIMIT = 16
#: Ids between two stored bit offsets.
CHECKPOINT = 256
#: Ids of a segment, about, and payload bytes after which a file is closed.
SEGMENT, FILE_BYTES = 1 << 20, 128 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code in an optimal prefix code with at most ``limit`` bits; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        is_leaf.append(at < n)
    needed, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for flags in reversed(is_leaf):
        taken = int(flags[:needed].sum())
        depth[:taken] += 1
        needed = 2 * (needed - taken)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    value, before = 0, 0
    by_length = np.bincount(lengths[order], minlength=1)
    at = 0
    for bits, n in enumerate(by_length.tolist()):
        if n:
            value <<= bits - before
            codes[order[at : at + n]] = value + np.arange(n)
            value, before, at = value + n, bits, at + n
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of the code that begins any ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (limit - lengths[order].astype(np.int64))
    symbols, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    filled = int(span.sum())
    symbols[:filled], bits[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, bits


def encode_block(ids: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of several documents, each begun at a byte: payload, first byte of each (and the end), and bits before
    each id from the beginning of its document. ``firsts``: number of each one's first id, and of all ids at the end."""
    bits = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    sizes = ends[firsts[1:]] - ends[firsts[:-1]]
    begin = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])
    counts = np.diff(firsts)
    inside = ends[:-1] - np.repeat(ends[firsts[:-1]], counts)
    place = inside + np.repeat(begin[:-1] * 8, counts)
    # Codes lie in order and do not overlap, so those that begin in one 32-bit word add up to its bits and the next one's.
    word = place >> 5
    value = codes[ids].astype(np.uint64) << (64 - bits - (place & 31)).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    sums = np.add.reduceat(value, first) if len(word) else value
    at = word[first]
    words = np.zeros(int(begin[-1]) // 4 + 3, np.uint64)
    words[at] = sums >> np.uint64(32)
    words[at + 1] += sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: int(begin[-1])], begin, inside


def decode_lanes(payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ids of all lanes, one after another; a lane begins at a bit of the payload and has a count of ids."""
    wide = np.concatenate([payload, np.zeros(3, np.uint8)]).astype(np.uint32)
    wide = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    order = np.argsort(-counts, kind="stable")
    place, left = starts[order].astype(np.int64), counts[order]
    out = np.zeros((int(left[0]) if len(left) else 0, len(left)), np.uint32)
    limit = 8 * len(payload)
    for k in range(len(out)):
        n = int(np.searchsorted(-left, -k, side="left"))  # lanes with more than k ids
        p = place[:n]
        if n and int(p.max()) >= limit:
            raise ArchiveError("a code beyond the end of its segment")
        window = (wide[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[k, :n] = symbols[window]
        step = bits[window]
        if n and not step.all():
            raise ArchiveError("bits that are no code")
        place[:n] += step
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return out.T[back][np.arange(len(out)) < counts[:, None]]


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        if max(encoder.library.get_vocab_size() - 1, end_id) >> 16:
            raise ValueError("the file format holds ids of 16 bits")
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found, first = encoder.encode_column(batch.column(1))
            raw = np.insert(found, first[1:], end_id).astype("<u2").tobytes()
            first = 2 * (first + np.arange(len(first)))
            ids = [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            counts += np.bincount(np.frombuffer(raw, "<u2"), minlength=1 << 16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc", "ids", "counts"])
        some = np.flatnonzero(counts)
        if len(some):  # one row for the counts of the whole task, beside those of documents
            packed = np.stack([some, counts[some]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names=["doc", "ids", "counts"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["id", "n"])


def _coded(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ids = np.frombuffer(b"".join(raw), "<u2")
            firsts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int64)
            payload, begin, inside = encode_block(ids, firsts, lengths, codes)
            data, n = payload.tobytes(), np.diff(firsts)
            bits = [data[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            marks = [inside[a:b:CHECKPOINT].astype("<u4").tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())], names=["doc", "n", "marks", "bits"])

    return run


def _writer(folder: str, lengths: np.ndarray):
    head = MAGIC + struct.pack("<III", LIMIT, CHECKPOINT, len(lengths)) + lengths.tobytes()

    def segment(docs: list, counts: list[int], marks: list[bytes], bits: list[bytes]) -> bytes:
        known = np.array([d is not None for d in docs], np.uint8)
        ids = np.array([0 if d is None else d for d in docs], "<i8")
        offsets, payload = b"".join(marks), b"".join(bits)
        sizes = np.array([len(b) for b in bits], "<u8")
        return struct.pack("<QQQ", len(docs), len(offsets) // 4, len(payload)) + known.tobytes() + ids.tobytes() + np.array(counts, "<u8").tobytes() + sizes.tobytes() + offsets + payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        done, stream = [], None
        held: tuple[list, list, list, list] = ([], [], [], [])
        tokens = 0

        def flush() -> None:
            nonlocal stream, held, tokens
            if not held[0]:
                return
            if stream is None:
                name = f"ids-{part:06d}-{len(done):05d}-{attempt}.huff"
                system, path = file_system(f"{folder}/{name}")
                stream = system.open_output_stream(path, compression=None)
                stream.write(head)
                done.append([f"{folder}/{name}", part, len(done), 0, 0, len(head)])
            data = segment(*held)
            stream.write(data)
            file = done[-1]
            file[3], file[4], file[5] = file[3] + len(held[0]), file[4] + sum(held[1]), file[5] + len(data)
            held, tokens = ([], [], [], []), 0
            if file[5] >= FILE_BYTES:
                close()

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.write(struct.pack("<QQQ", 0, 0, 0))
                stream.close()
                stream = None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                tokens += row[1]
                if tokens >= SEGMENT:
                    flush()
        flush()
        close()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in done], k) for i, k in enumerate(kinds)], names=["file", "part", "nth", "documents", "ids", "bytes"])

    return run


def write_ids(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes all texts, writes the files, and returns their table: file, part and nth (their order), documents, ids,
    bytes. The key must be integral, ids of the vocabulary below 65,536."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_table_folder(spark, "ids")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    tokens = written(slim.mapInArrow(_tokenized(vocabulary or vocabulary_path(), end_id), "doc long, ids binary, counts binary"), "tokens")
    of_tasks = tokens.where("counts is not null").select("counts").mapInArrow(_unpacked, "id long, n long")
    totals = of_tasks.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(1 + max((r["id"] for r in totals), default=0), np.int64)
    for r in totals:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    coded = tokens.where("ids is not null").select("doc", "ids").mapInArrow(_coded(lengths), "doc long, n long, marks binary, bits binary")
    ordered = coded.repartitionByRange("doc").sortWithinPartitions("doc", "n", "bits")
    return written(ordered.mapInArrow(_writer(folder, lengths), "file string, part long, nth long, documents long, ids long, bytes long"), "files")


def segments(stream, name: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, counts of ids, and all ids of every segment of a file, checked on the way."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ArchiveError(f"{name}: cut off")
        return data

    if take(len(MAGIC)) != MAGIC:
        raise ArchiveError(f"{name}: not a file of ids")
    limit, checkpoint, n = struct.unpack("<III", take(12))
    if limit != LIMIT or not checkpoint:
        raise ArchiveError(f"{name}: codes of {limit} bits")
    symbols, bits = decoding_table(np.frombuffer(take(n), np.uint8), limit)
    while True:
        documents, marks, payload = struct.unpack("<QQQ", take(24))
        if not documents:
            break
        known = np.frombuffer(take(documents), np.uint8)
        ids = np.frombuffer(take(8 * documents), "<i8").tolist()
        counts = np.frombuffer(take(8 * documents), "<u8").astype(np.int64)
        sizes = np.frombuffer(take(8 * documents), "<u8").astype(np.int64)
        offsets = np.frombuffer(take(4 * marks), "<u4").astype(np.int64)
        data = np.frombuffer(take(payload), np.uint8)
        lanes = -(-counts // checkpoint)
        if lanes.sum() != marks or sizes.sum() != payload:
            raise ArchiveError(f"{name}: a segment whose sizes differ")
        starts = offsets + np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
        each = np.full(marks, checkpoint, np.int64)
        last = np.cumsum(lanes) - 1
        some = lanes > 0
        each[last[some]] = (counts - (lanes - 1) * checkpoint)[some]
        yield [d if k else None for d, k in zip(ids, known.tolist(), strict=True)], counts, decode_lanes(data, starts, each, symbols, bits)
    if stream.read(1):
        raise ArchiveError(f"{name}: bytes behind its end")


def _reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    for docs, counts, ids in segments(stream, uri):
                        ends = np.cumsum(counts)
                        raw = ids.astype("<u4").tobytes()
                        each = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each if with_ids else [None] * len(each), pa.binary())],
                            names=["doc", "start", "n_tokens", "ids_crc32", "ids"],
                        )
                        before += int(counts.sum())

    return run


def read_ids(spark: SparkSession, files: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per stored document: key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit numbers) and, if asked for, these ids."""
    prepare(spark)
    order = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    dealt = listed.repartition(max(1, files.count()))
    found = dealt.mapInArrow(_reader(with_ids), "doc long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found.withColumnRenamed("doc", key)
