"""Repeated passages by relative Lempel-Ziv parsing of documents against the index of all documents before them.

The reference is every document with a smaller id. Its index holds *phrases*: the windows of ``WINDOW`` words that
follow one another and have the same least shingle (of ``ANCHOR`` words), taken with all their words. Where two texts
have a passage in common, they have its phrases in common, whatever stands around it; so one row for about five words is
enough to index. Index blocks are the shuffle partitions of the phrases by their anchor: there each phrase meets the
first document, and the place in it, where it stands whole.

A document is then parsed greedily from left to right: a factor begins at the first phrase with a place in the reference,
and goes on as long as the next phrase's place follows in the same document; it ends at a mismatch or where an earlier
reference takes over. At factor boundaries, where a phrase has no place but its anchor also stands elsewhere, the
windows inside it are looked up one by one in the same way, and lengthen the factors. All factors have at least
``WINDOW`` words: they are the duplicate spans, given with the document and the place that they copy.

A text is hashed into phrases once, and moved once, into a table of buckets by document, which meets the lists of places
without moving again. In an index block rows are sorted and passed over (with room on disk), so that no group is held.
The rows of an anchor that a sample of documents often has (``HOT_ROWS`` in ``SAMPLE_DOCS``, for how rows are dealt out
alone) are dealt out by ``SHARES`` shares of the documents first, and only the first of each share meet.

Defined cases. Null text, text without words or with fewer than a window: nothing is removed. A null id: the row is
never a reference and loses nothing. Rows with one id are one document with several texts, none earlier than the other;
spans are matched to rows by the text too. Repeats inside one document stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.common import pieces, prepare, written
from seqcast.llm.words import Words
from seqcast.operators.skew import hot_keys
from seqcast.session import bucketed_table

#: Words of a window, the least length of a duplicate span.
WINDOW = 13
#: Words of an anchor shingle.
ANCHOR = 6
#: An anchor is hot if it stands at least so often in a sample of so many documents.
HOT_ROWS, SAMPLE_DOCS = 64, 4096
#: Shares of the documents that the rows of a hot anchor are dealt out by.
SHARES = 256
#: Rows of windows that are sampled to find hot ones.
SAMPLE_WINDOWS = 1 << 18


def phrases(words: Words, size: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, phrase hash, row, first word (from 0 in the text) and number of windows of every phrase."""
    n = len(words) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    shingles = words.window_hash(np.arange(len(words) - anchor + 1), anchor)
    least = shingles[:n].copy()
    for k in range(1, size - anchor + 1):
        np.minimum(least, shingles[k : k + n], out=least)
    place = np.zeros(n, np.int64)
    for k in range(size - anchor, -1, -1):  # the first of equal ones, so that the choice depends on the window alone
        place[shingles[k : k + n] == least] = k
    place += np.arange(n)
    inside = words.doc[:n] == words.doc[size - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (words.doc[1:n] != words.doc[: n - 1])
    first = np.flatnonzero(begins)
    if not len(first):
        return none, none, none, none, none
    group = np.cumsum(begins) - 1
    many = np.bincount(group[inside], minlength=len(first))
    row = words.doc[first]
    length = many + size - 1
    whole = np.zeros(len(first), np.uint64)
    for k in np.unique(length).tolist():
        at = np.flatnonzero(length == k)
        whole[at] = words.window_hash(first[at], k, seed=7)
    return least[first].view(np.int64), whole.view(np.int64), row, first - words.first[row], many


def _first_word(place):
    """The first word of a phrase or window, from its place."""
    return place >> 5 & 0x3FFFFFFFF


def _phrase_rows(size: int, anchor: int):
    """Rows (anchor, phrase, doc, place) of all phrases of (doc, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            for part in pieces(batch.column(2)):
                a, p, row, start, many = phrases(Words(part), size, anchor)
                # In one number: 24 bits of the text's hash, 34 of the first word, 5 of the number of windows.
                place = marks[at + row] << 39 | start << 5 | many
                for i in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (a, p, ids[at + row], place)], names=["anchor", "phrase", "doc", "place"])
                at += len(part)

    return run


def _window_rows(size: int):
    """Rows (w1, w2, doc, place) of the single windows of the phrases listed beside a text, in (doc, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (places, offsets) = batch.column(0).to_numpy(zero_copy_only=False), _lists(batch.column(2))
            at = 0
            for part in pieces(batch.column(1)):
                words = Words(part)
                listed = places.to_numpy(zero_copy_only=False)[offsets[at] : offsets[at + len(part)]]
                row = np.repeat(np.arange(len(part)), np.diff(offsets[at : at + len(part) + 1]))
                many = listed & 31
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                listed, row = np.repeat(listed, many), np.repeat(row, many)
                begin = words.first[row] + _first_word(listed) + nth
                place = (listed >> 5 << 5 | 1) + (nth << 5)
                for i in range(0, len(begin), 50_000):
                    to = begin[i : i + 50_000]
                    columns = (words.window_hash(to, size, 1).view(np.int64), words.window_hash(to, size, 2).view(np.int64), ids[at + row[i : i + 50_000]], place[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["w1", "w2", "doc", "place"])
                at += len(part)

    return run


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a column of lists (null: empty), and where each list begins, with the end."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def factors(begin: np.ndarray, many: np.ndarray, row: np.ndarray, reference: np.ndarray, position: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Row, first word, length, reference and position of the factors, from phrases and windows with their places in
    the reference: one goes on as long as the next place follows in the same text, without a window between."""
    order = np.lexsort((begin, row))
    begin, many, row, reference, position = (x[order] for x in (begin, many, row, reference, position))
    same = (row[1:] == row[:-1]) & (reference[1:] == reference[:-1]) & (position[1:] >> 39 == position[:-1] >> 39)
    follows = (begin[1:] == begin[:-1] + many[:-1]) & (_first_word(position[1:]) == _first_word(position[:-1]) + many[:-1])
    starts = np.flatnonzero(np.append(True, ~(same & follows)))
    length = np.add.reduceat(many, starts) + size - 1
    return row[starts], begin[starts], length, reference[starts], _first_word(position[starts])


def _parsed(size: int, with_text: bool):
    def nested(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)

    def run(table: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in table:
            found: list[pa.Array] = []
            (all_spans, offsets), at = _lists(spans), 0
            place, reference, position = (all_spans.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for part in pieces(texts):
                words, n = Words(part), len(part)
                here = slice(offsets[at], offsets[at + n])
                row = np.repeat(np.arange(n), np.diff(offsets[at : at + n + 1]))
                begin, many = _first_word(place[here]), place[here] & 31
                gone = words.covered(words.first[row] + begin, many + size - 1) if len(row) else np.zeros(len(words), bool)
                # Runs of words that go; one of two texts that follow each other is two.
                change = np.zeros(len(words) + 1, bool)
                change[1:-1], change[words.first] = gone[1:] != gone[:-1], True
                edges = np.flatnonzero(change) if len(words) else np.zeros(0, np.int64)
                runs = edges[:-1][gone[edges[:-1]]] if len(words) else edges
                ends = edges[1:][gone[edges[:-1]]] if len(words) else edges
                owner = words.doc[runs]
                cut = factors(begin, many, row, reference[here], position[here], size) if len(row) else [np.zeros(0, np.int64)] * 5
                left = words.joined(~gone)
                copied = pa.StructArray.from_arrays([pa.array(x) for x in cut[1:]], ["begin", "length", "reference", "position"])
                columns = [
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(words.per_text(gone)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                    nested(owner, n, pa.array(runs - words.first[owner])),
                    nested(owner, n, pa.array(ends - runs)),
                    nested(cut[0], n, copied),
                    pa.array([x.decode() if with_text else None for x in left], pa.string()),
                ]
                found.append(pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "kept_sha256", "begins", "lengths", "factors", "kept_text"]))
                at += n
            yield pa.concat_arrays(found)

    kind = "n_words long, n_removed long, kept_sha256 string, begins array<long>, lengths array<long>, factors array<struct<begin long, length long, reference long, position long>>, kept_text string"
    return F.arrow_udf(run, kind)


def _looked_up(rows: DataFrame, group: str, exact: str, hot: DataFrame, with_new: bool) -> DataFrame:
    """Rows (doc, place, reference, position) of the rows (group, exact, doc, place) that equal one of an earlier
    document, with the first of these (in a hot group, the first of a share of them). ``with_new`` adds, without a
    reference, the rows that don't, of groups that have several documents and are not all equal, and of hot groups.

    Hot groups are dealt out by shares of the documents; only what is first in its share meets once more.
    """
    place = F.struct("doc", "place")

    def first(*by: str) -> Column:
        return F.first(place).over(Window.partitionBy(*by).orderBy("doc", "place"))

    copies = F.col("first.doc") < F.col("doc")
    reference, position = (F.when(copies, F.col(f"first.{c}")).alias(n) for c, n in (("doc", "reference"), ("place", "position")))
    flagged = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), group, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SHARES))).otherwise(F.lit(-1))
    dealt = flagged.withColumn("share", share).repartition(group, "share")
    together = Window.partitionBy(group, "share")
    several = (F.min(exact).over(together) != F.max(exact).over(together)) & (F.min("doc").over(together) != F.max("doc").over(together))
    met = dealt.select(group, exact, "doc", "place", "hot", first(group, exact, "share").alias("first"), several.alias("several"))
    again = (F.col("hot") & ~copies).alias("again")
    kept = met.where(copies | F.col("hot") | (F.col("several") & F.lit(with_new)))
    kept = written(kept.select("doc", "place", reference, position, again, *(F.when(again, F.col(c)).alias(c) for c in (group, exact))), "looked-up")
    # All places of a document are one row here, so that a passage that a document repeats weighs no more than another.
    once = kept.where("again").groupBy(group, exact, "doc").agg(F.collect_list("place").alias("places"), F.min("place").alias("place"))
    new = once.select("doc", "places", first(group, exact).alias("first")).where(copies | F.lit(with_new))
    new = written(new.select("doc", F.explode("places").alias("place"), reference, position), "looked-up")
    return kept.where("not again").select(*new.columns).unionByName(new)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, begins, lengths, factors, kept_text) for every row: the duplicate spans as
    first word and length, the factors that make them (begin, length, reference document and position of the first word
    there), and the words that stay, joined by one space. The key must be integral; sizes must leave an anchor room in a
    window, and a phrase at most 31 windows."""
    if not 1 <= anchor <= size or size - anchor >= 31:
        raise ValueError("an anchor must fit into a window, with at most 30 places to stand")
    prepare(docs.sparkSession)
    whole = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.hash(whole).bitwiseAND(F.lit(0xFFFFFF)).alias("mark"), whole.alias("text"))
    mark = F.shiftright("place", 39).cast("int").alias("mark")
    is_referenced = F.col("doc").isNotNull() & F.col("text").isNotNull()
    texts = bucketed_table(rows.where(is_referenced), "texts", "doc", "mark")

    def phrases_of(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_phrase_rows(size, anchor), "anchor long, phrase long, doc long, place long")

    drawn = phrases_of(texts.sample(min(1.0, SAMPLE_DOCS / max(1, texts.count())), seed=1))
    hot = written(drawn.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS).select("anchor"), "hot")
    marked = _looked_up(phrases_of(texts), "anchor", "phrase", hot, True)
    edges = marked.where("reference is null").groupBy("doc", mark).agg(F.collect_list("place").alias("places"))
    beside = texts.join(edges, ["doc", "mark"]).select("doc", "text", "places")
    windows = written(beside.mapInArrow(_window_rows(size), "w1 long, w2 long, doc long, place long"), "windows")
    sampled = windows.sample(min(1.0, SAMPLE_WINDOWS / max(1, windows.count())), seed=1).groupBy("w1").agg(F.count("*").alias("n"))
    hot = written(hot_keys(sampled, ["w1"]).where(F.col("n") >= HOT_ROWS).select("w1"), "hot")
    single = _looked_up(windows, "w1", "w2", hot, False)
    spans = marked.where("reference is not null").unionByName(single)
    spans = spans.groupBy("doc", mark).agg(F.collect_list(F.struct("place", "reference", "position")).alias("spans"))
    spans = written(spans, "spans")
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    judged = texts.join(spans, ["doc", "mark"], "left").select("doc", "text", "spans")
    judged = judged.unionByName(rows.where(~is_referenced).select("doc", "text", none.alias("spans")))
    parsed = judged.select("doc", _parsed(size, with_text)("text", "spans").alias("p"))
    return parsed.select(F.col("doc").alias(key), "p.*")
