"""The prefix trie of all conversations, as burst tries.

Turns become ids of ``TURN`` bytes (a digest of role and text, and the length of the text), a conversation the string of
its turns' ids, and equal conversations one row with their number. All rows begin in one *container* under the root.
A container that holds more than ``CONTAINER_ROWS`` different conversations, or ``CONTAINER_TURNS`` turns, bursts: its
head is followed down to where its conversations part, and each next turn id there heads a new container. So a round of
bursts is a job over the oversized containers alone, and there are as many rounds as branchings on the way to the
deepest container, whatever the length of what conversations have in common. Containers that remain are dealt out to
the shards (shuffle partitions), sorted there, and swept into nodes a few at a time; their heads then add up, from the
lowest burst to the root, what lies below the nodes above them.

A conversation is one row of 24 bytes a turn, its texts never meet. A container is bounded, a node's children and
members are only counted, and the ids of the conversations that end at a node are gathered by stretches of
``ENDS_STRETCH`` numbers, whose texts pass through the digest one after another.

Defined cases. Turns are ordered by turn (null first), then role, then the digest of the text; repeated rows are turns
of their own. Null role or text is empty. Rows without a conversation id are left out. A conversation without turns (as
``conversations_of`` can give) ends at the root. An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import prepare, written
from seqcast.operators.skew import join_on_key

#: Bytes of a turn id: a digest of 16 and a length of 8.
TURN = 24
#: What a container may hold before it bursts.
CONTAINER_ROWS, CONTAINER_TURNS = 4096, 1 << 18
#: Rows that a task sweeps at a time, about; a container is never cut.
SWEEP_ROWS = 8192
#: Conversation ids that are written as one text before they are hashed.
ENDS_STRETCH = 4096
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ID = np.dtype([("digest", "V16"), ("bytes", ">i8")])

NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): every conversation as the ids of its turns in order, one after another."""
    prepare(turns.sparkSession)
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    by = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    size = F.octet_length(said)
    digest = F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), by.alias("role"), F.concat(digest, F.lpad(F.hex(size.cast("long")), 16, "0")).alias("id"))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), one.alias("one"))
    return rows.groupBy("conv").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("one"))["id"], "")).alias("turns"))


def turns_between(turns: Column, first: Column, count: Column | None = None) -> Column:
    """Turn ids from the one numbered ``first`` (from 0) on; ``count`` of them, or all."""
    at = (first * TURN + 1).cast("int")
    return F.substr(turns, at) if count is None else F.substr(turns, at, (count * TURN).cast("int"))


def _ends(rows: DataFrame) -> DataFrame:
    """(seq, ends): the digest of the ids of all conversations with these turns, ascending and joined by commas."""
    stretch = F.expr(f"conv div {ENDS_STRETCH} - if(conv % {ENDS_STRETCH} < 0, 1, 0)")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    texts = rows.select(F.md5("turns").alias("key"), "conv").groupBy("key", stretch.alias("stretch")).agg(listed.alias("listed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, keys, found = None, None, [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        found.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], names=["key", "ends"])
                keys, found = [], []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends"])

    dealt = texts.repartition("key").sortWithinPartitions("key", "stretch").select("key", "listed")
    return dealt.mapInArrow(run, "key string, ends string")


def _common():
    def run(low: pa.Array, high: pa.Array) -> pa.Array:
        return pa.array([_shared(a.as_buffer(), b.as_buffer()) for a, b in zip(low, high, strict=True)], pa.int32())

    return F.arrow_udf(run, "int")


def _ids(turns: pa.Buffer) -> np.ndarray:
    return np.frombuffer(turns, _ID)


def _shared(one: pa.Buffer, other: pa.Buffer) -> int:
    """How many turns two conversations begin with alike."""
    a, b = np.frombuffer(one, "V24"), np.frombuffer(other, "V24")
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _nodes(depth, low, up, n, children, leaves, saved, ends) -> list[pa.Array]:
    return [pa.array(depth, pa.int64()), pa.array(low, pa.int64()), up, pa.array(n, pa.int64()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array(ends, pa.string())]


_NODE_NAMES = [part.split(" ")[0] for part in NODE.split(", ")]


def _swept(table: pa.Table) -> pa.RecordBatch:
    """The nodes of whole containers, whose rows lie together and are sorted."""
    heads, turns = table.column("head").to_pylist(), table.column("turns")
    starts, sizes = table.column("depth").to_pylist(), table.column("n").to_numpy()
    lows, ups, trunks, ends = table.column("low").to_numpy(), table.column("up"), table.column("trunk"), table.column("ends").to_pylist()
    # New nodes of each row: from below what it has in common with the row before, down to its end.
    rows, depth, parent, bytes_, at_end, tops = [], [], [], [], [], []
    stack: list[tuple[int, int]] = []
    total, before = 0, None
    for i, value in enumerate(turns):
        buffer = value.as_buffer()
        ids = _ids(buffer)
        if i == 0 or heads[i] != heads[i - 1]:
            first, above, stack = starts[i], -1, []
            tops.append(total)
        else:
            same = _shared(before, buffer)
            while stack[-1][0] > same:
                stack.pop()
            first, above = same + 1, stack[-1][1] + same - stack[-1][0]
        made = len(ids) + 1 - first
        numbers = np.arange(total - 1, total + made - 1)
        numbers[0] = above
        parent.append(numbers)
        depth.append(np.arange(first, first + made))
        bytes_.append(ids["bytes"][max(first - 1, 0) :] if first else np.concatenate([[0], ids["bytes"]]))
        rows.append(np.full(made, i))
        stack.append((first, total))
        total += made
        at_end.append(total - 1)
        before = buffer
    depth, parent, bytes_, rows = (np.concatenate(x).astype(np.int64) for x in (depth, parent, bytes_, rows))
    n, low = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    n[at_end], low[at_end] = sizes, lows
    children = np.bincount(parent[parent >= 0], minlength=total)
    leaves, saved = (children == 0).astype(np.int64), np.zeros(total, np.int64)
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, edges):  # from the deepest nodes up
        saved[level] += (n[level] - 1) * bytes_[level]
        level = level[parent[level] >= 0]
        to = parent[level]
        np.add.at(n, to, n[level])
        np.add.at(leaves, to, leaves[level])
        np.add.at(saved, to, saved[level])
        np.minimum.at(low, to, low[level])
    told = np.full(total, _NO_ENDS, object)
    told[at_end] = ends
    up, unknown, trunk = low[np.maximum(parent, 0)], np.zeros(total, bool), np.full(total, None, object)
    for top in tops:  # heads of containers know what is above them
        over, trunk[top] = ups[int(rows[top])].as_py(), trunks[int(rows[top])].as_py()
        unknown[top], up[top] = over is None, over or 0
    columns = _nodes(depth, low, pa.array(up, mask=unknown), n, children, leaves, saved, told)
    return pa.RecordBatch.from_arrays([*columns, pa.array(trunk, pa.string())], names=[*_NODE_NAMES, "trunk"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < SWEEP_ROWS:
            continue
        table = pa.Table.from_batches(held)
        heads = table.column("head").to_pylist()
        cut = next((i for i in range(len(heads) - 1, 0, -1) if heads[i] != heads[i - 1]), 0)
        if cut:  # the last container may go on in the next batch
            yield _swept(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            count -= cut
    if count:
        yield _swept(pa.Table.from_batches(held))


def _trunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of burst containers: from their head down to where they part."""
    for batch in batches:
        for row in batch.to_pylist():
            first, fork = row["depth"], row["fork"]
            own = _ids(row["turns"])["bytes"].astype(np.int64)
            made = np.arange(first, fork + 1)
            each = (row["n"] - 1) * np.where(made > 0, own[np.maximum(made - 1, 0)] if len(own) else 0, 0)
            saved = np.cumsum(each[::-1])[::-1] + row["saved"]
            last = made == fork
            up = pa.array([row["up"]] + [row["low"]] * (len(made) - 1), pa.int64())
            columns = _nodes(made, np.full(len(made), row["low"]), up, np.full(len(made), row["n"]), np.where(last, row["children"], 1), np.full(len(made), row["leaves"]), saved, np.where(last, row["ends"] or _NO_ENDS, _NO_ENDS))
            trunk = pa.array([row["trunk"]] + [None] * (len(made) - 1), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, trunk], names=[*_NODE_NAMES, "trunk"])


def _head(turns: Column, depth: Column) -> Column:
    return F.md5(turns_between(turns, F.lit(0), depth))


def prefix_trie(conversations: DataFrame, most_rows: int | None = None, most_turns: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv, turns), as ``conversations_of`` gives them: ``depth``, ``conv_id`` (the
    smallest member), ``parent_conv_id`` (the parent's; root: null), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes below or at it), ``saved_tokens`` (bytes of texts that members of a node need not repeat, added up
    below it) and ``ends_sha256`` (digest of the ids of the conversations that end at it). Ids must be distinct."""
    most_rows, most_turns = most_rows or CONTAINER_ROWS, most_turns or CONTAINER_TURNS
    prepare(conversations.sparkSession)
    rows = written(conversations.select("conv", "turns"), "conversations")
    classes = rows.groupBy("turns").agg(F.count("*").alias("n"), F.min("conv").alias("low")).withColumn("key", F.md5("turns"))
    classes = classes.join(_ends(rows), "key").select("turns", "n", "low", "ends")
    none = F.lit(None)
    begun = classes.select(_head(F.col("turns"), F.lit(0)).alias("head"), none.cast("string").alias("trunk"), none.cast("long").alias("up"), F.lit(0).alias("depth"), "turns", "n", "low", "ends")
    now = written(begun, "containers")
    settled, bursts = [], []
    while True:
        held = now.groupBy("head").agg(F.count("*").alias("n"), F.sum(F.octet_length("turns") / TURN - F.col("depth")).alias("held"))
        held = written(held, "sizes")
        full = held.where((F.col("n") > 1) & ((F.col("n") > most_rows) | (F.col("held") > most_turns))).select("head")
        if full.isEmpty():
            settled.append(now)
            break
        counts = held.select("head", "n")
        settled.append(join_on_key(now, full, ["head"], "left_anti", counts, ["low"]))
        bursting = written(join_on_key(now, full, ["head"], "left_semi", counts, ["low"]), "bursting")
        spans = bursting.groupBy("head", "trunk", "up", "depth").agg(F.min("turns").alias("turns"), F.max("turns").alias("last"), F.sum("n").alias("n"), F.min("low").alias("low"))
        # The least conversation is the one that ends at the fork, if there is one.
        burst = written(spans.select("head", "trunk", "up", "depth", _common()("turns", "last").alias("fork"), "n", "low", "turns"), "bursts")
        forks = burst.select("head", "fork", F.col("low").alias("over"))
        beyond = join_on_key(bursting, forks, ["head"], "inner", counts, ["low"])
        ended = F.octet_length("turns") == F.col("fork") * TURN
        stopped = beyond.where(ended).select("head", "ends")
        bursts.append(written(burst.join(stopped, "head", "left"), "forks"))
        below = (F.col("fork") + 1).alias("depth")
        now = written(beyond.where(~ended).select(_head(F.col("turns"), F.col("fork") + 1).alias("head"), F.col("head").alias("trunk"), F.col("over").alias("up"), below, "turns", "n", "low", "ends"), "containers")
    dealt = settled[0]
    for more in settled[1:]:
        dealt = dealt.union(more)
    dealt = dealt.repartition("head").sortWithinPartitions("head", "turns")
    nodes = written(dealt.mapInArrow(_sweep, f"{NODE}, trunk string"), "nodes")
    # What hangs below the bursts, from the last round to the first.
    found = heads = nodes.where("trunk is not null")
    out = [nodes]
    for burst in reversed(bursts):
        below = found.groupBy(F.col("trunk").alias("head")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        trunks = written(burst.join(below, "head").mapInArrow(_trunks, f"{NODE}, trunk string"), "trunks")
        out.append(trunks)
        found = heads.union(trunks.where("trunk is not null"))
    for more in out[1:]:
        nodes = nodes.union(more)
    return nodes.drop("trunk")
