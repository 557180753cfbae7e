"""Near-duplicate documents by HyperMinHash sketches, with links confirmed on the full shingle sets.

A document is its set of distinct word shingles. Sets that are equal are one class, so copies cost one sketch. The
sketch of a class has ``REGISTERS`` buckets; each keeps the least hash of its bucket in two bytes, as the count of
leading zeros and the ``MANTISSA`` bits behind the leading one. Runs of registers are band keys, and classes that meet
in a band are tied to the lowest one there: linear in the members, whatever the size of the bucket. What is tied forms
rough groups, which are compared inside tasks: the Jaccard index is estimated from registers, corrected for registers
that agree by chance, and pairs that may reach the threshold are confirmed on the full sets. Confirmed links give the
components; a pair that is connected already is not compared.

A rough group beyond ``BLOCK`` classes is cut into blocks, so no task holds a whole group, and blocks are compared in
pairs. In a group of more than ``PIVOT_BLOCKS`` blocks each member is first
compared with ``PIVOTS`` members of the group: those linked with one are tied to it, and pivots that share a member to each
other. What is tied together needs no further comparison with each other; only members outside the largest such cluster
of the group are compared with all the group, block by block, and there only where the distances to the pivots allow a
link (Jaccard distance is a metric). So near copies of one text cost a few comparisons each, however many they are; the
rest is the members outside the largest cluster times the group. Only links that connect something leave a task.

Small sets get every shingle hashed several times (``fold``), so that buckets are filled. Sets whose sizes lie on either
side of changes of fold are sketched with those of all sizes in reach.

Chance: bands are as long as leaves two sets at the threshold without a common one with a probability below one in a
million (``banding``: 25 of 5 registers at 85 percent, 32 of 4 at 80); a link well above never gets lost. A set that no different set can reach the threshold with (up to five shingles at 85 percent) has no band
keys: such sets link only when equal, and equal sets are one class.

Defined cases. Null text and text without words: empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. A null id is linked with nothing. Rows that share an id are one document with several
texts; each row gets its own count of shingles and the component of the id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, pieces, prepare, written
from seqcast.llm.components import components
from seqcast.llm.words import Words, mixed
from seqcast.operators.skew import join_on_key

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union; documents are dropped from a corpus from STAGE_PERCENT on.
PERCENT, STAGE_PERCENT = 85, 80
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
#: Chance that two sets at the threshold share no band, at most.
MISSED = 1e-6
#: Classes of one block of a rough group, about, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Members that all others are compared with first, in rough groups of more than so many blocks.
PIVOTS, PIVOT_BLOCKS = 8, 16
#: How far below a threshold of 85 percent an estimate may lie (five standard deviations of an estimate near it).
MARGIN = 0.16
_EMPTY = 0xFFFF
#: Expected share of agreeing registers by chance, for equal sizes (published constant of the sketch).
_CHANCE = 0.169919487159739093975315012348


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found, at = words.windows(size)
    first = np.searchsorted(words.doc[at], np.arange(len(words.counts) + 1))
    out = [np.unique(found[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    for row in np.flatnonzero((words.counts > 0) & (words.counts < size)).tolist():
        out[row] = words.window_hash(words.first[row : row + 1], int(words.counts[row]))
    return out


def fold(n: int) -> int:
    """How often each shingle of a set of this size is hashed."""
    return 1 if n >= 512 else 4 if n >= 128 else 16 if n >= 32 else 64


def links_others(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of this size can be linked with a different one; the likeliest is itself with one shingle more."""
    return 100 * n >= percent * (n + 1)


def folds(n: int, percent: int = PERCENT) -> list[int]:
    """The folds of a set: its own, and those of larger sets that it can be linked with."""
    least = fold(n * 100 // percent)
    return [times for times in (1, 4, 16, 64) if least <= times <= fold(n)]


_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def sketch(shingles: np.ndarray, times: int) -> np.ndarray:
    """The registers of a set of shingle hashes."""
    if times > 1:
        steps = np.arange(times, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shingles = np.sort(mixed((shingles[:, None] + steps[None, :]).ravel()))
    place = np.searchsorted(shingles, _STARTS)
    least = np.append(shingles, np.uint64(0))[place]
    empty = (place == len(shingles)) | (least >> np.uint64(64 - BUCKET_BITS) != np.arange(REGISTERS, dtype=np.uint64))
    rest = (least << np.uint64(BUCKET_BITS)) | np.uint64(1)  # without the bits of the bucket
    high = rest
    for shift in (1, 2, 4, 8, 16, 32):  # all bits below the leading one
        high = high | (high >> np.uint64(shift))
    zeros = (64 - np.bitwise_count(high)).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA) | mantissa
    out[empty] = _EMPTY
    return out.astype(np.uint16)


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and registers in each: the longest bands of which two sets at the threshold share one, up to ``MISSED``."""
    rows = max((r for r in range(1, REGISTERS + 1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) < MISSED), default=1)
    return REGISTERS // rows, rows


def margin(percent: int = PERCENT) -> float:
    """How far below the threshold an estimate may lie: five standard deviations of an estimate near it."""
    return max(MARGIN, 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5)


def band_keys(registers: np.ndarray, times: int, bands: int, length: int) -> np.ndarray:
    """One key for each band of a sketch; sketches of different folds never meet."""
    rows = registers[: bands * length].reshape(bands, length).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(64) + np.uint64(times)
    for k in range(length):
        key = mixed(key * np.uint64(0x100000001B3) + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def estimate(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray) -> np.ndarray:
    """Jaccard indexes of one sketch with others, less what agrees by chance."""
    filled = (one != _EMPTY) | (others != _EMPTY)
    same = ((one == others) & filled).sum(axis=1)
    ratio = n_others / n_one
    chance = _CHANCE * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    used = np.maximum(filled.sum(axis=1), 1)
    return np.clip((same - chance) / used, 0, 1)


def _sketched(size: int, percent: int):
    bands, length = banding(percent)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            counts, digests, keys = [], [], []
            for part in pieces(column):
                for shingles in shingle_sets(Words(part, lower=True), size):
                    counts.append(len(shingles))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    found = [band_keys(sketch(shingles, t), t, bands, length) for t in folds(len(shingles), percent)] if links_others(len(shingles), percent) else []
                    keys.append(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["n", "digest", "keys"])

    return F.arrow_udf(run, "n long, digest binary, keys array<long>")


def _sets(size: int):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([s.tobytes() for part in pieces(column) for s in shingle_sets(Words(part, lower=True), size)], pa.binary())

    return F.arrow_udf(run, "binary")


class _Forest:
    """Which of a few members are connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.top(i)] = self.top(j)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def is_link(both: int, one: int, other: int, percent: int) -> bool:
    return 100 * both >= percent * (one + other - both)


def pivot_links(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[list[list[int]], np.ndarray]:
    """For each set the pivots that it is linked with, and its Jaccard distances to all of them."""
    far = np.ones((len(sets), len(pivots)))
    found: list[list[int]] = []
    for i, s in enumerate(sets):
        linked = []
        for k, p in enumerate(pivots):
            both = common(s, p)
            far[i, k] = 1 - both / max(1, len(s) + len(p) - both)
            if is_link(both, len(s), len(p), percent):
                linked.append(k)
        found.append(linked)
    return found, far


def linked_pairs(sets: list[np.ndarray], side: list[int], percent: int = PERCENT, far: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between members: between the two sides if there are two, else between all.

    ``far`` are distances of the members to common pivots; members whose distances to one differ by more than a link is
    long have no link."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    n = np.array([len(sets[i]) for i in order])
    sides = np.array([side[i] for i in order])
    two = len(set(side)) > 1
    by_fold: dict[int, np.ndarray] = {}
    for times in {fold(int(x)) for x in n}:
        at = [k for k in range(len(order)) if times in folds(int(n[k]), percent)]
        table = np.full((len(order), REGISTERS), _EMPTY, np.uint16)
        for k in at:
            table[k] = sketch(sets[order[k]], times)
        by_fold[times] = table
    forest, out = _Forest(len(order)), []
    for k in range(len(order) - 1, 0, -1):
        low = int(np.searchsorted(n[:k], n[k] * percent / 100 - 1e-9))
        if low == k:
            continue
        near = np.arange(low, k)
        if two:
            near = near[sides[near] != sides[k]]
        if far is not None and len(near):
            near = near[np.abs(far[order][near] - far[order[k]]).max(axis=1) <= 1 - percent / 100 + 1e-9]
        if not len(near):
            continue
        table = by_fold[fold(int(n[k]))]
        close = estimate(table[k], table[near], int(n[k]), n[near])
        for c in np.argsort(-close, kind="stable").tolist():
            if close[c] < percent / 100 - margin(percent):
                break
            j = int(near[c])
            if forest.top(j) == forest.top(k):
                continue
            if is_link(common(sets[order[j]], sets[order[k]]), len(sets[order[j]]), len(sets[order[k]]), percent):
                forest.join(j, k)
                out.append((order[j], order[k]))
    return out


def _sets_of(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]


# What a row of a comparison with pivots tells: a link, a member's distances, or pivots that a member ties.
_LINK, _MEMBER, _PIVOTS = 0, 1, 2
_MET = "component long, kind int, u long, v long, mark long, far array<double>"


def _with_pivots(percent: int):
    """Rows of a block of members and the pivots of their group: links (pivot u, member v), the distances ``far`` of each
    member u to the pivots, v being the first one that it is linked with, and the pivots that it ties."""

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        group = members.column("component")[0].as_py()
        nodes, marks = members.column("node").to_pylist(), members.column("mark").to_pylist()
        tops, reference = pivots.column("node").to_pylist(), _sets_of(pivots)
        order = sorted(range(len(tops)), key=list(zip(tops, pivots.column("mark").to_pylist(), strict=True)).__getitem__)  # alike in every block
        tops = [tops[k] for k in order]
        found, far = pivot_links(_sets_of(members), [reference[k] for k in order], percent)
        rows = [(group, _LINK, tops[k], node, None, None) for i, node in enumerate(nodes) for k in found[i] if tops[k] != node]
        rows += [(group, _MEMBER, node, tops[found[i][0]] if found[i] else None, marks[i], far[i].tolist()) for i, node in enumerate(nodes)]
        rows += [(group, _PIVOTS, a, b, None, None) for a, b in {(tops[x[0]], tops[k]) for x in found for k in x[1:]} if a != b]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        names = [part.split(" ")[0] for part in _MET.split(", ")]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def _largest(group: pa.Table) -> pa.Table:
    """The pivots of a group's largest cluster, from rows (component, u, v, n): pivots that are tied (n = 0), and how
    many members each has first (u = v)."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("u", "v", "n")), strict=True))
    tops = sorted({x for u, v, _ in rows for x in (u, v)})
    forest, place = _Forest(len(tops)), {x: i for i, x in enumerate(tops)}
    for u, v, _ in rows:
        forest.join(place[u], place[v])
    held: dict[int, int] = {}
    for u, _, n in rows:
        held[forest.top(place[u])] = held.get(forest.top(place[u]), 0) + n
    best = max(sorted(held), key=held.__getitem__)
    main = [x for x in tops if forest.top(place[x]) == best]
    return pa.table({"component": pa.array([group.column("component")[0].as_py()] * len(main), pa.int64()), "v": pa.array(main, pa.int64())})


def _compared(percent: int):
    def run(group: pa.Table) -> pa.Table:
        nodes, sides = group.column("node").to_pylist(), group.column("side").to_pylist()
        far = group.column("far").to_pylist()
        distances = np.array(far) if far and all(x is not None for x in far) else None
        found = linked_pairs(_sets_of(group), sides, percent, distances)
        return pa.table({"u": pa.array([nodes[i] for i, _ in found], pa.int64()), "v": pa.array([nodes[j] for _, j in found], pa.int64())})

    return run


def _links(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect the members (component, node, shingles) of every rough group as all its links do."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    sizes = written(sizes.where("size > 1").select("component", blocks.alias("blocks"), F.col("size").alias("n")), "sizes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(sizes.select("component", "blocks"), "component").withColumn("block", own)
    # Blocks of a group in pairs; a group of one block is the pair of that block with itself.
    few = placed.where(F.col("blocks") <= PIVOT_BLOCKS)
    met = few.select("component", "node", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles", F.col("block").alias("side"))
    # Dealt out by block pair: left to itself, the grouping may be content with the partitions by component.
    met = met.withColumn("far", F.lit(None).cast("array<double>")).repartition("component", "i", "j")
    found = met.groupBy("component", "i", "j").applyInArrow(_compared(percent), "u long, v long")
    if sizes.where(F.col("blocks") > PIVOT_BLOCKS).isEmpty():
        return found
    # Pivots of large groups go to each of its blocks. An id may have several sets.
    large = written(placed.where(F.col("blocks") > PIVOT_BLOCKS).withColumn("mark", F.xxhash64("shingles")), "large")
    drawn = F.struct(F.xxhash64("node", "component").alias("draw"), "node")
    chosen = large.groupBy("component", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)).alias("nth")).agg(F.min(drawn).alias("least"), F.max("blocks").alias("blocks"))
    chosen = written(chosen.select("component", F.col("least.node").alias("node"), "blocks"), "chosen")
    pivots = large.select("component", "node", "mark", "shingles").join(chosen, ["component", "node"])
    pivots = written(pivots.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "mark", "shingles"), "pivot-sets")
    pairs = large.select("component", "block", "node", "mark", "shingles").groupBy("component", "block").cogroup(pivots.groupBy("component", "block"))
    met = written(pairs.applyInArrow(_with_pivots(percent), _MET), "pivots")
    tied = met.where(F.col("kind") != _MEMBER).select("u", "v")
    first = met.where((F.col("kind") == _MEMBER) & F.col("v").isNotNull()).groupBy("component", "v").agg(F.count("*").alias("n"))
    first = written(first, "first")
    ties = met.where(F.col("kind") == _PIVOTS).select("component", "u", "v", F.lit(0).cast("long").alias("n")).distinct()
    largest = ties.unionByName(first.withColumn("u", F.col("v"))).groupBy("component").applyInArrow(_largest, "component long, v long")
    largest = written(largest, "largest").withColumn("main", F.lit(True))
    # What is outside the largest cluster, in blocks, against all the blocks of its group.
    distances = met.where(F.col("kind") == _MEMBER).select("component", "u", "v", "mark", "far")
    distances = join_on_key(distances, largest, ["component", "v"], "left", first, ["u"])
    distances = distances.select(F.col("u").alias("node"), "mark", F.col("main").isNull().alias("alone"), "far").dropDuplicates(["node", "mark"])
    known = written(large.join(distances, ["node", "mark"]).select("component", "node", "shingles", "block", "blocks", "alone", "far"), "distances")
    lone = known.where("alone").groupBy("component").agg(F.count("*").alias("alones"), F.sum(F.octet_length("shingles")).alias("alone_bytes"))
    lone = lone.select("component", F.ceil(F.greatest(F.col("alones") / BLOCK, F.col("alone_bytes") / BLOCK_BYTES)).cast("int").alias("rows"))
    placed = known.join(lone, "component")
    alone = placed.where("alone").withColumn("i", F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows")).cast("int"))
    alone = alone.select("component", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "shingles", F.lit(0).alias("side"), "far")
    others = placed.select("component", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("block").alias("j"), "node", "shingles", F.lit(1).alias("side"), "far")
    beside = alone.unionByName(others).repartition("component", "i", "j")
    rest = beside.groupBy("component", "i", "j").applyInArrow(_compared(percent), "u long, v long")
    return found.unionByName(tied).unionByName(rest.where("u != v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs. The key must be integral."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    all_docs = written(slim.select("doc", _sketched(size, percent)("text").alias("s")).select("doc", "s.n", "s.digest", "s.keys"), "sketches")
    some = all_docs.where(F.col("doc").isNotNull() & F.col("digest").isNotNull())
    # Equal sets: the lowest id stands for them. Keys are equal where digests are, so any row's will do.
    classes = written(some.groupBy("digest").agg(F.min("doc").alias("node"), F.any_value("keys").alias("keys")), "classes")
    banded = classes.select("node", F.explode("keys").alias("band"))
    lowest = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("band", "hub")
    ties = banded.join(lowest, "band").where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    rough = written(components(ties, "rough"), "rough")
    members = written(
        slim.join(rough.hint("shuffle_hash"), slim["doc"] == rough["node"]).select("component", "node", _sets(size)("text").alias("shingles")),
        "members",
    ).where(F.octet_length("shingles") > 0)  # on the table, lest the sets of all documents be made for the filter
    links = written(_links(members, percent), "links")
    # Rows that share an id but not a set stand for one document: the id ties their classes.
    same_id = some.join(classes.select("digest", "node"), "digest").where("doc != node").select(F.col("doc").alias("u"), F.col("node").alias("v"))
    joined = written(components(links.union(same_id), "links"), "components")
    found = all_docs.join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.coalesce("component", "doc")
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """The documents, with their columns, of which each component keeps the one with the lowest id.

    Rows without an id stay. Rows that repeat a kept id stay together.
    """
    name = fresh(docs, "near_duplicate_of")
    gone = near_duplicates(docs, key, text, percent=percent).where(~F.col("kept")).select(F.col(key).alias(name)).distinct()
    return docs.join(gone, docs[f"`{key}`"] == gone[name], "left_anti")
