"""Harmonic packing of tokenized documents into sequences of fixed length.

Pieces are put into reciprocal-capacity classes: a piece of length n is of class k when n lies in (capacity / (k + 1),
capacity / k], and a bin of class k is closed after exactly k pieces of any lengths of that class. The last class takes
all that is shorter than ``SMALLEST``: its one open bin is closed when a piece does not fit, and so wastes less than one
of them. Every task fills the bins of its own partition, so no rows move. Documents may be cut, so longer lengths are made
to be the upper ends of their classes: a document gives whole sequences first, then the binary digits of the rest down to
``SMALLEST``, which fill their bins without a gap, and a tail of the last class. The few pieces in bins that are still
open at the end of the partition are packed together, longest first, so that a partition has about one half-empty
sequence.

Defined cases. Null text is an empty one; it still has the end id. Repeated documents are packed each. Order of pieces in
sequences follows the order of rows in the partition. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import prepare
from seqcast.llm.tokens import vocabulary_path, worker_encoder

#: Tokens of a full sequence, a power of two.
CAPACITY = 2048
#: The shortest length that documents are cut to; what is left is a tail.
SMALLEST = 64
#: Sequence numbers of a partition: its number times this, and up.
PER_PARTITION = 1 << 40

_PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    size = capacity // 2
    while size >= smallest:
        if n & size:
            out.append(size)
        size //= 2
    return out + [n % smallest] * (n % smallest > 0)


class Bins:
    """Open bins by class of piece; a closed one becomes rows with sequence and offset."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[tuple[int, bool], list[tuple]] = defaultdict(list)
        self.tails: list[tuple] = []
        self.filled = 0

    def _closed(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1
        return rows

    def put(self, piece: tuple) -> list[tuple]:
        """Adds a piece (key, start, length, ...); the rows of the bin that this closes."""
        if piece[2] < SMALLEST:
            closed = []
            if self.filled + piece[2] > self.capacity:
                closed, self.tails, self.filled = self._closed(self.tails), [], 0
            self.tails.append(piece)
            self.filled += piece[2]
            return closed
        own = (self.capacity // piece[2], self.capacity % piece[2] == 0)
        pieces = self.open[own]
        pieces.append(piece)
        if len(pieces) < own[0]:
            return []
        return self._closed(self.open.pop(own))

    def rest(self) -> Iterator[list[tuple]]:
        """What is left, longest first into the first sequence with room."""
        sequences: list[tuple[int, list[tuple]]] = []
        for piece in sorted((p for pieces in [*self.open.values(), self.tails] for p in pieces), key=lambda p: -p[2]):
            for i, (filled, pieces) in enumerate(sequences):
                if filled + piece[2] <= self.capacity:
                    pieces.append(piece)
                    sequences[i] = (filled + piece[2], pieces)
                    break
            else:
                sequences.append((piece[2], [piece]))
        self.open.clear()
        self.tails, self.filled = [], 0
        for _, pieces in sequences:
            yield self._closed(pieces)


def _packer(path: str, end_id: int, capacity: int, key_type: pa.DataType):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema([pa.field("key", key_type), *_PIECES])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId() * PER_PARTITION)
        out: list[tuple] = []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids_of_all, first = encoder.encode_column(batch.column(1))
            for key, a, b in zip(keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids = ids_of_all[a:b].astype("<u4").tobytes() + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    out += bins.put((key, start, length, ids[4 * start : 4 * (start + length)], n))
                    start += length
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
        for last in bins.rest():
            out += last
        if out:
            yield rows(out)

    return pack


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the key, start (ids of the document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id, and offset in that sequence. Columns of docs beside key and text are not
    read. Sequence numbers are unique, not dense."""
    if capacity < SMALLEST or capacity & (capacity - 1):
        raise ValueError(f"capacity must be a power of two of at least {SMALLEST}")
    prepare(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = slim.schema["key"].dataType
    packed = slim.mapInArrow(
        _packer(vocabulary or vocabulary_path(), end_id, capacity, to_arrow_type(kind)),
        f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("key", key)
