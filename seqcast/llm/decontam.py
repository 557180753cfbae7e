"""Benchmark decontamination: a prefix-filtered join of documents with the word windows of benchmark items.

A window is the sequence of ``size`` consecutive item words; an item with fewer words is one window. Both sides are
sequences of shingles (``SHINGLE`` words). To contain a window, a document must hold all of its shingles, so a prefix of
one shingle suffices as the join key when shingles are ordered by rarity: each window is looked up only by the one of
its shingles that is rarest in the documents. A meeting fixes where the window would begin; the bounds of the text
(position and length) and then every word are compared before it counts.

The benchmark is a stated query set. It is cut into blocks of bounded size, and the blocks' indexes, not the documents,
are sent to the tasks; documents are never shuffled. Up to ``GROUP_BLOCKS`` blocks share two passes over the documents,
one that counts shingles and one that matches, each of which parses a text once. A larger benchmark takes two more passes
for every further group, so that no task ever holds more than one group.

Defined cases. Null or empty text, or text without words: no words, nothing hit. Null item text: no window. An item
without an id marks words but isn't listed. Items repeated under one id count once; repeated documents are each judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, pieces, prepare, written
from seqcast.llm.words import NOT_ALNUM, Words

#: Words of a benchmark window.
WINDOW = 10
#: Words of a shingle, the unit of the rarity order.
SHINGLE = 3
#: Bytes of benchmark text in one block, about; its index takes some 15 times as much in each task.
BLOCK_BYTES = 1 << 20
#: Blocks that a task holds together.
GROUP_BLOCKS = 16
_SIEVE_BITS = 20


class Index:
    """The windows of one block of items, looked up by a shingle."""

    def __init__(self, rows: list[tuple[str | None, str]], size: int):
        words = Words(pa.array([text for _, text in rows], pa.string()), NOT_ALNUM, lower=True)
        seen: dict[tuple[bytes, ...], set[str]] = {}
        begun: dict[tuple[bytes, ...], int] = {}
        text = [words.text(i) for i in range(len(words))]
        for row, (item, _) in enumerate(rows):
            a, b = int(words.first[row]), int(words.first[row + 1])
            for at in range(a, max(a + 1, b - size + 1)) if b > a else ():
                window = tuple(text[at : min(at + size, b)])
                begun.setdefault(window, at)
                seen.setdefault(window, set()).update(() if item is None else (item,))
        self.size = size
        self.length = np.array([len(w) for w in seen], np.int64)
        # The words of the block as hashes and as one text; a window is a place in them.
        self.begin = np.array(list(begun.values()), np.int64)
        self.hash = np.append(words.hash, np.uint64(0))
        self.flat = b" ".join(text)
        self.start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in text])]).astype(np.int64)
        # The items of a window are numbers into their sorted names.
        self.names = sorted(set().union(*seen.values()))
        number = {n: i for i, n in enumerate(self.names)}
        self.item = np.array([number[n] for x in seen.values() for n in x], np.int64)
        self.item_first = np.concatenate([[0], np.cumsum([len(x) for x in seen.values()])]).astype(np.int64)
        # All shingles of all windows: which window, at which of its words, and the hash.
        self.window_of, self.offset, self.shingle = [], [], []
        for i, (window, at) in enumerate(begun.items()):
            wide = min(SHINGLE, len(window))
            offsets = np.arange(len(window) - wide + 1)
            self.window_of.append(np.full(len(offsets), i))
            self.offset.append(offsets)
            self.shingle.append(words.window_hash(at + offsets, wide))
        self.window_of, self.offset, self.shingle = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.window_of, self.offset, self.shingle))
        self.widths = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        self.shingle = self.shingle.astype(np.uint64)
        self.keys = np.unique(self.shingle)
        self._sieve()

    def _sieve(self) -> None:
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.keys >> np.uint64(64 - _SIEVE_BITS)] = True

    def met(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where shingles of the text are keys of the index: number of the first word, and number of the key."""
        for wide in self.widths:
            found, at = words.windows(wide)
            some = np.flatnonzero(self.sieve[found >> np.uint64(64 - _SIEVE_BITS)])
            key = np.searchsorted(self.keys, found[some])
            same = self.keys[np.minimum(key, len(self.keys) - 1)] == found[some]
            yield at[some[same]], key[same]

    def by_rarest(self, counts: np.ndarray) -> Index:
        """Keeps one key for each window: its rarest shingle by these counts of the keys; ties go to the first."""
        seen = counts[np.searchsorted(self.keys, self.shingle)]
        order = np.lexsort((self.offset, seen, self.window_of))
        first = order[np.unique(self.window_of[order], return_index=True)[1]]
        shingle, offset = self.shingle[first], self.offset[first]
        by_key = np.argsort(shingle, kind="stable")
        self.keys, begins = np.unique(shingle[by_key], return_index=True)
        self.begins = np.append(begins, len(by_key))
        self.listed, self.at = by_key, offset[by_key]
        del self.window_of, self.offset, self.shingle
        self._sieve()
        return self

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of the block's windows: number of the first word, number of the window."""
        places, windows = [], []
        for at, key in self.met(words):
            n = self.begins[key + 1] - self.begins[key]
            entry = np.repeat(self.begins[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, begin = np.repeat(words.doc[at], n), np.repeat(at, n) - self.at[entry]
            window = self.listed[entry]
            fits = (begin >= words.first[row]) & (begin + self.length[window] <= words.first[row + 1])
            begin, window = begin[fits], window[fits]
            for k in range(self.size):
                short = self.length[window] <= k
                same = short | (words.hash[np.where(short, 0, begin + k)] == self.hash[np.where(short, 0, self.begin[window] + k)])
                begin, window = begin[same], window[same]
            places.append(begin)
            windows.append(window)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(windows)

    def true(self, words: Words, begin: int, window: int) -> bool:
        """Word by word in bytes, as the last check of a meeting."""
        at, n = int(self.begin[window]), int(self.length[window])
        return b" ".join([words.text(begin + k) for k in range(n)]) == self.flat[self.start[at] : self.start[at + n] - 1]

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.item[self.item_first[window] : self.item_first[window + 1]]]


def _counted(blocks: list[Index]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(block.keys), np.int64) for block in blocks]
        for batch in batches:
            for part in pieces(batch.column(0)):
                words = Words(part, NOT_ALNUM, lower=True)
                for block, held in zip(blocks, counts, strict=True):
                    for _, key in block.met(words):
                        held += np.bincount(key, minlength=len(held))
        for b, held in enumerate(counts):
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b)), pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["block", "key", "n"])

    return count


def _matched(blocks: list[Index]):
    def match(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            begins, lengths, items, counts = [], [], [], []
            for part in pieces(column):
                words = Words(part, NOT_ALNUM, lower=True)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
                ids: list[set[str]] = [set() for _ in range(len(part))]
                for block in blocks:
                    for begin, window in zip(*(x.tolist() for x in block.occurrences(words)), strict=True):
                        if block.true(words, begin, window):
                            row = int(words.doc[begin])
                            spans[row].append((begin - int(words.first[row]), int(block.length[window])))
                            ids[row].update(block.items(window))
                begins += [[a for a, _ in s] for s in spans]
                lengths += [[n for _, n in s] for s in spans]
                items += [list(x) for x in ids]
                counts += words.counts.tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "begins", "lengths", "items"],
            )

    return F.arrow_udf(match, "n_words long, begins array<long>, lengths array<long>, items array<string>")


def _by_rarest(texts: DataFrame, group: list[Index]) -> list[Index]:
    """The blocks with the windows by their rarest shingle; one pass counts the shingles of all of them."""
    if not group:
        return []
    counts = [np.zeros(len(block.keys), np.int64) for block in group]
    met = texts.mapInArrow(_counted(group), "block long, key long, n long").groupBy("block", "key").agg(F.sum("n").alias("n")).toArrow()
    block, key, n = (met.column(c).to_numpy() for c in ("block", "key", "n"))  # at most the group's shingles
    for b, held in enumerate(counts):
        held[key[block == b]] = n[block == b]
    return [block.by_rarest(n) for block, n in zip(group, counts, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with a column ``contamination``: struct of ``n_words``, ``begins`` and ``lengths`` of the spans of
    words (from 0) in which a benchmark window occurs, and ``items`` that these windows are of.

    Spans may overlap and touch. The name of the new column gets underscores if the documents have it already; it is
    the last column.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(1.5 * held / block_bytes) if held > block_bytes else 1
    block_of = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    name = fresh(docs, "contamination")
    many, names = docs, []
    for low in range(0, blocks, GROUP_BLOCKS):
        group = []
        for b in range(low, min(low + GROUP_BLOCKS, blocks)):
            rows = [(r["item"], r["text"]) for r in items.where(block_of == b).distinct().collect()]  # bounded by block_bytes
            index = Index(sorted(rows, key=lambda r: (r[1], r[0] or "")), size)
            if len(index.keys):
                group.append(index)
        if not group and (names or low + GROUP_BLOCKS < blocks):
            continue
        found = _by_rarest(docs.select(F.col(f"`{text}`").cast("string")), group)
        names.append(fresh(docs, f"contamination_{low}") if blocks > GROUP_BLOCKS else name)
        many = many.select("*", _matched(found)(F.col(f"`{text}`")).alias(names[-1]))
        if blocks > GROUP_BLOCKS:  # the next group has the tasks for itself
            many = written(many, "contamination")
    if names == [name]:
        return many
    merged = F.struct(
        F.col(names[0])["n_words"].alias("n_words"),
        *(F.flatten(F.array(*(F.col(n)[c] for n in names))).alias(c) for c in ("begins", "lengths")),
        F.array_distinct(F.flatten(F.array(*(F.col(n)["items"] for n in names)))).alias("items"),
    )
    return many.select(*(F.col(f"`{c}`") for c in docs.columns), merged.alias(name))


def _digest(column: pa.Array) -> pa.Array:
    hit, number, digest = [], [], []
    for row in column.to_pylist():
        marks = np.zeros(row["n_words"] + 1, np.int64)
        begins = np.array(row["begins"], np.int64)
        np.add.at(marks, begins, 1)
        np.add.at(marks, begins + np.array(row["lengths"], np.int64), -1)
        hit.append(int((np.cumsum(marks) > 0).sum()))
        number.append(len(row["items"]))
        digest.append(hashlib.sha256(",".join(sorted(row["items"])).encode()).hexdigest())
    return pa.StructArray.from_arrays([pa.array(hit, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())], ["n_hit", "n_items", "items_sha256"])


def contamination_digest(column: str) -> Column:
    """From a contamination struct: n_hit (words hit), n_items, and the digest of the items, sorted and joined by commas."""
    return F.arrow_udf(_digest, "n_hit long, n_items long, items_sha256 string")(F.col(column))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW) -> DataFrame:
    """The documents, with the columns they have, in which no benchmark window occurs."""
    marked = contamination(docs, benchmark, text, item, size)
    return marked.where(F.size(F.col(marked.columns[-1])["begins"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
