"""Prefix trie of conversations, screened by a count-min sketch.

Every prefix of a conversation's turns is a node; conversations that begin alike share it. A
prefix is known by a digest that is chained along the turns, so after the first step no text is
moved: a row is a conversation, a depth and two digests.

A count-min sketch of all prefix digests is summed over tasks. It never counts too few, so where
it says one, the prefix belongs to one conversation: such rows, the tails of conversations, are
finished where they are read. Only prefixes that may be shared are shuffled and grouped exactly,
with map-side sums. Wrong guesses of the sketch cost a shuffled row and change nothing; its size follows
the number of prefixes up to ``MOST_WIDTH`` counters a row, so what is broadcast is bounded.

Sums over a node's subtree need no walk over depths. A node's own number is put down at its least member; a
conversation holds the numbers of the nodes of which it is the least member, which lie on its own path, one below
the other. The sum over a node's members of all they hold is the sum over its subtree, and what
the node's least member holds above the node is taken off again. So a sum is one join by
conversation and one aggregation by node.

Defined cases: a null role or text is empty; turns are in order of ``turn``, null first, ties by the digest of
role and text, repeated rows are turns of their own; rows without a conv_id are no conversation and are left out;
a conversation that is rebuilt without turns ends at the root; an empty table has no root and gives no
rows. Other columns are ignored, whatever their names.

The chain of one conversation is read in order by one task, which holds one digest of it. The digest of
the members that end at a node is sequential too: ids are packed 1,024 to a row where they are
sorted, and the task that hashes a node holds one row of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import settled, ship

ROOT = bytes(16)
#: Count-min rows, and counters a row: a power of two, four for each prefix within these bounds.
SKETCH_ROWS = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 22
_SEGMENT = 1 << 16
#: Nodes (24 bytes each) that are broadcast to look up parents; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_CHUNK = 1024
NOTHING = hashlib.sha256(b"").hexdigest()

PREFIX = "conv_id long, depth long, node binary, up binary, size long, last boolean"


def prefixes(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, most_heads: int = 0) -> DataFrame:
    """(conv_id, depth, node, up, size, last) of every prefix of every conversation, the empty one included.

    ``node`` and ``up`` are the digests of the prefix and of the one without its last turn, ``size`` the code points of
    its last text, ``last`` tells that the conversation ends with it. With ``base`` and ``heads`` (columns over
    conv_id; at most ``most_heads``) a conversation is rebuilt: its first ``heads`` turns are those of
    conversation ``base`` in place of its own.
    """
    ship(conversations.sparkSession)
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = given.select(
        (F.col("conv_id") if base is None else base).alias("base"), "conv_id", (F.lit(0) if heads is None else heads).cast("int").alias("heads"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("size"),
    )
    ordered = (
        turns.withColumn("other", F.col("conv_id") != F.col("base")).repartition("base")
        .sortWithinPartitions("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        of, conv, lead, own = None, None, [], 0
        depth, node, pending = 0, ROOT, None

        def add(row: tuple) -> None:
            for values, v in zip(out, row, strict=True):
                values.append(v)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.bool_())],
                ["conv_id", "depth", "node", "up", "size", "last"],
            )
            for values in out:
                values.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("base", "conv_id", "heads", "digest", "size")]
            for b, c, h, digest, size in zip(*columns, strict=True):
                if b != of:
                    of, lead = b, []
                if c != conv:
                    if pending:
                        add((*pending, True))
                    conv, own, depth, node, pending = c, 0, 0, ROOT, (c, 0, ROOT, None, 0)
                    for turn, length in lead[:h] if c != b else ():
                        add((*pending, False))
                        up, node, depth = node, hashlib.sha256(node + turn).digest()[:16], depth + 1
                        pending = (c, depth, node, up, length)
                if c == b and len(lead) < most_heads:
                    lead.append((digest, size))
                if c == b or own >= h:
                    add((*pending, False))
                    up, node, depth = node, hashlib.sha256(node + digest).digest()[:16], depth + 1
                    pending = (c, depth, node, up, size)
                own += 1
            if len(out[0]) > 4000:
                yield flush()
        if pending:
            add((*pending, True))
        yield flush()

    return ordered.select("base", "conv_id", "heads", "digest", "size").mapInArrow(run, PREFIX)


def _slots(digests: pa.Array, width: int) -> np.ndarray:
    """The counters (rows, n) of each 16-byte digest."""
    raw = b"".join(digests.to_pylist())
    two = np.frombuffer(raw, "<u8").reshape(-1, 2)
    row = np.arange(SKETCH_ROWS, dtype=np.uint64)[:, None]
    at = (two[:, 0] + row * (two[:, 1] | np.uint64(1))) & np.uint64(width - 1)
    return (at + row * np.uint64(width)).astype(np.int64)


def sketch(nodes: DataFrame, width: int) -> np.ndarray:
    """Count-min counters of the digests ``node``, each 0, 1 or 2 (two or more); summed over tasks by segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SKETCH_ROWS * width, np.uint8)
        for batch in batches:
            slots, n = np.unique(_slots(batch.column("node"), width), return_counts=True)
            table[slots] = np.minimum(table[slots] + np.minimum(n, 2), 2)
        for k in range(0, len(table), _SEGMENT):
            part = table[k : k + _SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _SEGMENT]), pa.array([part.tobytes()], pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["segment", "counts"])

        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(counts, np.uint8)
                if segment != at:
                    if at is not None:
                        yield done()
                    at, total = segment, part
                else:
                    total = np.minimum(total + part, 2)
        if at is not None:
            yield done()

    schema = "segment long, counts binary"
    summed = nodes.select("node").mapInArrow(count, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(add, schema)
    table = np.zeros(SKETCH_ROWS * width, np.uint8)
    for r in summed.collect():  # at most SKETCH_ROWS * MOST_WIDTH bytes
        table[r.segment * _SEGMENT : (r.segment + 1) * _SEGMENT] = np.frombuffer(r.counts, np.uint8)
    return table


def screened(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The prefixes with ``alone`` and ``up_alone``: the sketch proves that the prefix, or the one above it, has one member."""
    width, shared = len(table) // SKETCH_ROWS, rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            up = batch.column("up")
            alone = counts[_slots(batch.column("node"), width)].min(axis=0) == 1
            above = counts[_slots(up.fill_null(ROOT), width)].min(axis=0) == 1
            above |= up.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above)], [*batch.schema.names, "alone", "up_alone"])

    return rows.mapInArrow(run, f"{PREFIX}, alone boolean, up_alone boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ascending ids, comma-joined, of the conversations that end at each node."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            cuts, begin = [], 0
            for k in range(1, len(nodes) + 1):
                if k == len(nodes) or nodes[k] != nodes[begin] or k - begin == _CHUNK:
                    cuts.append((nodes[begin], ids[begin], ",".join(map(str, ids[begin:k]))))
                    begin = k
            names = ["node", "first", "ids"]
            if cuts:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cuts, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ranged = rows.where("last").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    packed = ranged.mapInArrow(pack, "node binary, first long, ids string").repartition("node").sortWithinPartitions("node", "first")
    return packed.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame, most_width: int = MOST_WIDTH) -> DataFrame:
    """One row for each node of ``prefixes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the least member; saved_tokens is, over the subtree, what members beyond the first repeat of each node's text.
    """
    rows = settled(rows, "trie-prefixes")
    n = rows.count()
    width = min(most_width, max(LEAST_WIDTH, 1 << (4 * n - 1).bit_length() if n else 1))
    seen = settled(screened(rows, sketch(rows, width)), "trie-screened")
    tails, shared = seen.where("alone"), seen.where("not alone")
    nodes = settled(
        shared.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.count(F.lit(1)).alias("n_convs"),
            (F.min("size") * (F.count(F.lit(1)) - 1)).alias("saves"), F.count_if("last").alias("n_ends"),
        ), "trie-nodes")
    # what each conversation holds: a leaf, and the savings of the nodes of which it is the least member
    held = (
        tails.where("last").select("conv_id", F.lit(1).alias("leaf"), F.lit(0).cast("long").alias("saves"))
        .unionByName(nodes.select("conv_id", (F.col("n_ends") == F.col("n_convs")).cast("int").alias("leaf"), "saves"))
        .groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves")).where("leaf > 0 or saves > 0")
    )
    zero = F.lit(0).cast("long")
    below = shared.select("node", "conv_id").join(held, "conv_id").select("node", "leaf", "saves", zero.alias("child"))
    children = nodes.where("depth > 0").select("up").unionByName(tails.where("not up_alone").select("up"))
    sums = below.unionByName(children.select(F.col("up").alias("node"), zero.alias("leaf"), zero.alias("saves"), F.lit(1).cast("long").alias("child"))).groupBy("node").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("below"), F.sum("child").alias("n_children"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    known = nodes.withColumn("above", F.coalesce(F.sum("saves").over(above), zero))
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    names = F.broadcast(names) if few else names

    def own_end(last: str) -> Column:
        return F.when(F.col(last), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING)

    # a parent that is not among the nodes has one member, the node's own
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    exact = known.join(sums, "node", "left").join(_ends(shared), "node", "left").join(names, "up", "left").select(
        "conv_id", "depth", parent, "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("below", zero) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    alone = ["conv_id", "depth", parent, one.alias("n_convs"), F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own_end("last").alias("ends_sha256")]
    first = tails.where("not up_alone").join(names, "up", "left").select(*alone)
    rest = tails.where("up_alone").withColumn("parent_conv_id", F.col("conv_id")).select(*alone)
    return exact.unionByName(first).unionByName(rest)
