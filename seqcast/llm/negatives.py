"""Hard negatives by an inverted multi-index over the two halves of a vector.

Each half of the vector space has a codebook, and a row's cell is the pair of its nearest codes. All rows are dealt out
to shards by a hash of their id; inside a shard they lie in the order of their cells, with the radius of every half-cell
(the farthest row from its code). For an anchor, a half-cell has a bound on its share of the score, the product with the
code plus that with the radius; a cell is bounded by the sum of both. A heap over both sorted lists of half-scores (the
multi-sequence walk) visits cells by falling bound, and stops once no cell left can change the result: for positives when
the bound is below the last one kept, for negatives when every window of scores is certified, that is, holds all the rows
asked for above the bound, or lies above the bound altogether. Cells whose rows all score above the windows are passed.
The search is exact; the codebooks decide only how soon it stops.

Anchors meet shards in blocks: a task gets one shard and one block of anchors, both of bounded bytes, and hands on a few
rows per anchor. So work grows with rows times anchors, as an exact search for a share of all rows as anchors must where
bounds don't stop it, and no task holds more than a block of either.

Codebooks are fitted by k-means on at most ``SAMPLE_ROWS`` rows, those with the least hash of their id (a bounded sample,
on the driver); every row is indexed.

Components are multiplied by ``scale`` and rounded down; scores are integer products. Defined cases: rows with a null
id, a null label, a null vector, or a null or non-finite component take no part. Vectors may differ in length, missing components count as 0. Rows that
share an id are rows of their own, but never each other's positives; an anchor that is repeated as it is counts once.
Ties go to the smaller id. Scores beyond 64 bits end the job. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.common import prepare, written

#: Codes of each half.
CODES = 16
#: Rows that the codebooks are fitted on, at most.
SAMPLE_ROWS = 8192
ROUNDS = 8
#: Bytes of the vectors of a shard, and anchors of a block, at most.
SHARD_BYTES, ANCHORS = 4 << 20, 4096
#: Rows that are scored before bounds are looked at again; doubled each time.
STEP_ROWS = 512
#: Sums of products up to this size are exact in floating point.
_EXACT = 2**53

Books = tuple[np.ndarray, np.ndarray]


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part: ``q`` are the whole numbers that the vector is searched by."""
    x = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    found = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & sound)
    return found.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("q"))


def _table(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows of one table, filled up with zeros."""
    if all(len(v) == dims for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nearest(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes**2).sum(axis=1)[None, :] - 2.0 * rows @ codes.T, axis=1)


def codebook(rows: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Codes of one half by k-means, from evenly spread rows of the sample."""
    rows = rows.astype(np.float64) if len(rows) else np.zeros((1, rows.shape[1]))
    now = rows[np.linspace(0, len(rows) - 1, min(codes, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        mine = _nearest(rows, now)
        for k in np.unique(mine).tolist():
            now[k] = rows[mine == k].mean(axis=0)
    return now


class Shard:
    """The inverted multi-index of the rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, books: Books):
        half = books[0].shape[1]
        self.half = half
        parts = [q[:, :half].astype(np.float64), q[:, half:].astype(np.float64)]
        codes = [_nearest(x, book) for x, book in zip(parts, books, strict=True)]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, labels, cell))
        self.ids, self.labels, self.cell = ids[order], labels[order], cell[order]
        largest = float(np.abs(q).max(initial=0))
        self.largest = largest
        self.q = q[order]
        self.fast = self.q.astype(np.float64)
        self.cells = np.arange(len(books[0]) * len(books[1]) + 1)
        self.first = np.searchsorted(self.cell, self.cells)
        # Distance of the farthest row from each code; less than nothing where there is none.
        self.radii = []
        for x, book, code in zip(parts, books, codes, strict=True):
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, code, np.sqrt(((x - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        self.books = books

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """What rows of each half-cell score with an anchor at most, and at least."""
        high, low = [], []
        for x, book, radius in zip((q[: self.half], q[self.half :]), self.books, self.radii, strict=True):
            x = x.astype(np.float64)
            middle, reach = book @ x, np.sqrt((x**2).sum()) * np.maximum(radius, 0)
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # for rounding; scores are whole numbers
            high.append(np.where(radius >= 0, middle + reach + slack, -np.inf))
            low.append(middle - reach - slack)
        return high, low

    def walk(self, high: list[np.ndarray]) -> Iterator[tuple[float, int, int]]:
        """Cells (bound, first code, second code) by falling bound."""
        one, two = (np.argsort(-h, kind="stable")[: int((h > -np.inf).sum())].tolist() for h in high)
        a, b = (h.tolist() for h in high)
        if not one or not two:
            return
        heap, seen = [(-(a[one[0]] + b[two[0]]), 0, 0)], set()
        while heap:
            bound, i, j = heapq.heappop(heap)
            seen.add((i, j))
            yield -bound, one[i], two[j]
            # A cell joins the heap when both cells that come before it have left.
            if i + 1 < len(one) and (j == 0 or (i + 1, j - 1) in seen):
                heapq.heappush(heap, (-(a[one[i + 1]] + b[two[j]]), i + 1, j))
            if j + 1 < len(two) and (i == 0 or (i - 1, j + 1) in seen):
                heapq.heappush(heap, (-(a[one[i]] + b[two[j + 1]]), i, j + 1))

    def scores(self, q: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Exact products with the rows from ``begin`` to ``end``."""
        if self.largest * float(np.abs(q).max(initial=0)) * len(q) < _EXACT:
            return (self.fast[begin:end] @ q.astype(np.float64)).astype(np.int64)
        exact = [sum(int(x) * int(y) for x, y in zip(row, q, strict=True)) for row in self.q[begin:end]]
        return np.array(exact, np.int64)

    def steps(self, q: np.ndarray, least, most: float = np.inf, label: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores, ids and labels of the rows of visited cells, a step at a time, until bounds are below ``least()``.

        Cells that can't score ``most`` or less are passed. With a label, only its rows are looked at."""
        high, low = self.bounds(q)
        found: list[tuple[int, int]] = []
        count, step = 0, STEP_ROWS
        for bound, i, j in self.walk(high):
            if bound < least():
                break
            cell = i * len(self.books[1]) + j
            begin, end = int(self.first[cell]), int(self.first[cell + 1])
            if begin == end or low[0][i] + low[1][j] > most:
                continue
            if label is not None:
                begin, end = (begin + int(x) for x in (np.searchsorted(self.labels[begin:end], label, "left"), np.searchsorted(self.labels[begin:end], label, "right")))
            if begin < end:
                found.append((begin, end))
                count += end - begin
            if count >= step:
                yield self._scored(q, found)
                found, count, step = [], 0, 2 * step
        if found:
            yield self._scored(q, found)

    def _scored(self, q: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.concatenate([self.scores(q, a, b) for a, b in spans]),
            np.concatenate([self.ids[a:b] for a, b in spans]),
            np.concatenate([self.labels[a:b] for a, b in spans]),
        )


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the rows by falling score, then by id."""
    if len(scores) > 4 * count:  # those that tie with the last one kept stay in
        near = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:count]
    return scores[order], ids[order]


def nearest_of_label(shard: Shard, anchor: int, label: int, q: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first rows of the anchor's label, but for the anchor."""
    scores = ids = np.zeros(0, np.int64)

    def least() -> float:
        return scores[-1] if len(scores) == count else -np.inf

    for s, i, _ in shard.steps(q, least, label=label):
        other = i != anchor
        scores, ids = _best(np.append(scores, s[other]), np.append(ids, i[other]), count)
    return scores, ids


def best_in_windows(shard: Shard, label: int, q: np.ndarray, windows: list[tuple[int, int]], count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least score, greatest score) the first rows of other labels in it."""
    none = np.zeros(0, np.int64)
    found = [(none, none)] * len(windows)
    real = [k for k, (low, high) in enumerate(windows) if low <= high]
    if not real:
        return found
    floor, most = min(windows[k][0] for k in real), max(windows[k][1] for k in real)

    def least() -> float:
        return min(max(windows[k][0], found[k][0][-1]) if len(found[k][0]) == count else windows[k][0] for k in real)

    for scores, ids, labels in shard.steps(q, least, most):
        near = (labels != label) & (scores >= floor) & (scores <= most)
        scores, ids = scores[near], ids[near]
        for k in real:
            low, high = windows[k]
            inside = (scores >= low) & (scores <= high)
            if len(found[k][0]) == count:
                inside &= scores >= found[k][0][-1]
            if inside.any():
                found[k] = _best(np.append(found[k][0], scores[inside]), np.append(found[k][1], ids[inside]), count)
    return found


def _shard_of(rows: pa.Table, books: Books) -> Shard:
    dims = books[0].shape[1] + books[1].shape[1]
    q = _table(rows.column("q").to_pylist(), dims)
    return Shard(rows.column("id").to_numpy(), rows.column("label").to_numpy(), q, books)


def _searching(books: Books, work, names: list[str]):
    """The function for one shard and one block of anchors; ``work`` gives rows for an anchor."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if rows.num_rows and anchors.num_rows:
            shard = _shard_of(rows, books)
            table = _table(anchors.column("q").to_pylist(), books[0].shape[1] + books[1].shape[1])
            columns = [anchors.column(c).to_pylist() for c in anchors.column_names if c not in ("q", "shard", "block")]
            for q, *values in zip(table, *columns, strict=True):
                for found in work(shard, q, *values):
                    for column, value in zip(out, found, strict=True):
                        column.append(value)
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, out, strict=True)})

    return run


def _positives(count: int):
    def work(shard: Shard, q: np.ndarray, anchor: int, label: int, mark: int) -> Iterator[tuple]:
        scores, ids = nearest_of_label(shard, anchor, label, q, count)
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            yield anchor, mark, i, s

    return work


def _negatives(count: int, low: int, high: int):
    def work(shard: Shard, q: np.ndarray, anchor: int, label: int, mark: int, scores: list[int]) -> Iterator[tuple]:
        windows = [(-(-low * p // 100), high * p // 100) for p in scores]
        for p, (found, ids) in zip(scores, best_in_windows(shard, label, q, windows, count), strict=True):
            for s, i in zip(found.tolist(), ids.tolist(), strict=True):
                yield anchor, mark, p, i, s

    return work


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    codes: int = CODES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's. ``rows`` are as :func:`usable` gives them; ``is_anchor`` is a condition on them."""
    spark = rows.sparkSession
    prepare(spark)
    rows = written(rows.select("id", "label", "q"), "vectors")
    marked = rows.where(is_anchor).select("id", "label", F.xxhash64("label", "q").alias("mark"), "q").dropDuplicates(["id", "mark"])
    marked = written(marked, "anchors")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims")).first()
    dims = max(2, facts["dims"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("q").collect()
    drawn = _table([r["q"] for r in sample], dims)
    half = dims // 2
    books = (codebook(drawn[:, :half], codes), codebook(drawn[:, half:], codes))
    shards = max(1, -(-facts["n"] * dims * 8 // SHARD_BYTES))
    blocks = max(1, -(-marked.count() // ANCHORS))
    # A row meets every block of anchors, an anchor every shard.
    dealt = rows.select(F.pmod(F.xxhash64("id", "q"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "label", "q")

    def search(anchors: DataFrame, work, names: list[str]) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
        asked = anchors.select(each, block, *[c for c in anchors.columns if c != "q"], "q")
        meeting = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
        return meeting.applyInArrow(_searching(books, work, names), ", ".join(f"{n} long" for n in names))

    near = search(marked, _positives(positives), ["anchor", "mark", "positive", "score"])
    by_score = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "positive")
    near = written(near.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives), "positives")
    wanted = near.groupBy(F.col("anchor").alias("id"), "mark").agg(F.sort_array(F.collect_set("score"), False).alias("scores"))
    asked = marked.join(wanted, ["id", "mark"]).select("id", "label", "mark", "scores", "q")
    hard = search(asked, _negatives(negatives, low, high), ["anchor", "mark", "score", "negative", "found"])
    by_found = Window.partitionBy("anchor", "mark", "score").orderBy(F.desc("found"), "negative")
    hard = hard.withColumn("rank", F.row_number().over(by_found)).where(F.col("rank") <= negatives)
    met = near.join(hard, ["anchor", "mark", "score"])
    return met.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"),
        F.col("found").alias("negative_score"),
    )
