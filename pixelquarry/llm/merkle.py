"""Merkle manifest of a dataset: a tree of SHA-256 digests with retained midstates.

A row's leaf is the digest of its fields; the leaves of one group (a language) in order of their
ids are the bottom of a tree of fan-out ``FANOUT``, and the groups' roots in order of the groups are
the bottom of the tree above. A parent is the digest of its children's digests as hexadecimal text,
64 bytes each, which is one block of SHA-256: so the state of the hash between two children is eight
words. Parents retain a copy of that state before each of their child slots. To fold a
changed leaf up to the root, each level resumes the state before the leaf's slot, takes in
the replacement and the siblings to the right of it, and finishes; what lies to the left is never
read again.

Rows get their exact place in the group from a range-partitioned sort, written once: the place in
the file plus what earlier files hold of the group, so a group that holds most of the rows is
spread like all others. ``BLOCK`` consecutive nodes are hashed together, for all blocks of a slice
at once; the roots of blocks are the nodes of the next round, so there are log_4096(n) rounds of
shuffles of digests, never of texts, and no task or driver holds a tree. Going down, the records
(midstate and siblings) above a block travel with the block's rows, one row a block.

Defined cases: a null field is ``-``; null ids come first, as one group has it among its rows; rows of
equal id are ordered by their leaf, so repeated rows are neighbours; a null group is a group of its
own and comes first; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import settled, ship

FANOUT = 2
#: Nodes that are hashed together: a power of the fan-out; a block is one unit of the shuffle.
BLOCK_LEVELS = 12
#: Rows of small side tables that are broadcast (about 150 bytes each).
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _roots(power: int, n: int) -> list[int]:
    """The first 32 bits of the fractional parts of the square or cube roots of the first n primes."""
    primes, k = [], 2
    while len(primes) < n:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    out = []
    for p in primes:
        low, high = 0, p << 32
        while low + 1 < high:  # integer root of p * 2^(32 power)
            mid = (low + high) // 2
            low, high = (mid, high) if mid**power <= p << (32 * power) else (low, mid)
        out.append(low & 0xFFFFFFFF)
    return out


_START = np.array(_roots(2, 8), np.uint32)
_ROUND = [np.uint32(k) for k in _roots(3, 64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block of 16 words (n, 16) each."""
    w = [np.ascontiguousarray(block[:, t]) for t in range(16)]
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(state[:, t]) for t in range(8))
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def start(n: int) -> np.ndarray:
    return np.broadcast_to(_START, (n, 8))


def as_text(words: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the block (n, 16) of their hexadecimal text."""
    raw = words.astype(">u4").view(np.uint8).reshape(len(words), 32)
    return _HEX[np.stack([raw >> 4, raw & 15], axis=2).reshape(len(words), 64)].view(">u4").astype(np.uint32)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of states that have taken in so many whole blocks and nothing else."""
    pad = np.zeros((len(state), 16), np.uint32)
    pad[:, 0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[:, 14], pad[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, pad)


@dataclass
class Level:
    """Of every node of one level: its parent, and what the parent retains for it.

    ``count`` children has the parent, the node is the one at ``slot``; ``before`` is the parent's state before
    that slot, ``others`` the digests of all its children by slot.
    """

    parent: np.ndarray
    slot: np.ndarray
    count: np.ndarray
    before: np.ndarray
    others: np.ndarray

    def of(self, nodes: np.ndarray) -> Level:
        return Level(self.parent[nodes], self.slot[nodes], self.count[nodes], self.before[nodes], self.others[nodes])


def grow(words: np.ndarray, tree: np.ndarray, height: np.ndarray, fanout: int = FANOUT) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels of all trees of a slice, and the digests and numbers of their roots.

    ``words`` are the bottom nodes of trees 0, 1, ... one after the other; a tree has ``height`` levels above them.
    A root that waits for higher trees is its own parent with ``count`` 0.
    """
    levels = []
    for level in range(int(height.max(initial=0))):
        up = level < height[tree]
        first = np.ones(len(tree), bool)
        first[1:] = tree[1:] != tree[:-1]
        at = np.arange(len(tree)) - np.maximum.accumulate(np.where(first, np.arange(len(tree)), 0))
        slot = np.where(up, at % fanout, 0)
        head = slot == 0
        parent = np.cumsum(head) - 1
        size = np.bincount(parent)
        begins = np.flatnonzero(head)
        grows = up[begins]
        state, taken = start(len(begins)).copy(), words[begins].copy()
        before = np.empty((len(tree), 8), np.uint32)
        others = np.zeros((len(begins), fanout, 8), np.uint32)
        for s in range(fanout):
            some = np.flatnonzero(size > s)
            child = begins[some] + s
            before[child] = state[some]
            others[some, s] = words[child]
            state[some] = absorb(state[some], as_text(words[child]))
        taken[grows] = finish(state[grows], size[grows])
        levels.append(Level(parent, slot, np.where(up, size[parent], 0), before, others[parent]))
        words, tree = taken, tree[begins]
    return levels, words, tree


def fold(words: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Replacements (n, 8) of nodes carried up: resume before the slot, take in the replacement and what is right of it."""
    for level in levels:
        rows = np.flatnonzero(level.count > 0)
        at = level.of(rows)
        state = absorb(at.before, as_text(words[rows]))
        for s in range(1, level.others.shape[1]):
            right = np.flatnonzero((at.slot < s) & (at.count > s))
            state[right] = absorb(state[right], as_text(at.others[right, s]))
        words = words.copy()
        words[rows] = finish(state, at.count)
    return words


def proofs(n: int, levels: list[Level]) -> np.ndarray:
    """Digests of the siblings of n nodes, level by level, left to right."""
    state, taken = start(n).copy(), np.zeros(n, np.int64)
    for level in levels:
        for s in range(level.others.shape[1]):
            rows = np.flatnonzero((level.slot != s) & (level.count > s))
            state[rows] = absorb(state[rows], as_text(level.others[rows, s]))
            taken[rows] += 1
    return finish(state, taken)


def _pack(level: Level) -> np.ndarray:
    """A level as rows of words: slot, count, state, siblings."""
    n = len(level.slot)
    return np.concatenate([level.slot[:, None], level.count[:, None], level.before, level.others.reshape(n, -1)], axis=1).astype(np.uint32)


def _unpack(paths: list[bytes], fanout: int) -> list[Level]:
    """The levels of paths of several lengths; missing ones have count 0."""
    width = 10 + 8 * fanout
    rows = [np.frombuffer(p, np.uint32).reshape(-1, width) for p in paths]
    deepest = max((len(r) for r in rows), default=0)
    table = np.zeros((len(rows), deepest, width), np.uint32)
    for r, row in zip(table, rows, strict=True):
        r[: len(row)] = row
    none = np.zeros(len(rows), np.int64)
    return [
        Level(none, t[:, 0].astype(np.int64), t[:, 1].astype(np.int64), t[:, 2:10], t[:, 10:].reshape(len(rows), fanout, 8)) for t in table.transpose(1, 0, 2)
    ]


def words_of(column: pa.Array) -> np.ndarray:
    """Binary digests as words (n, 8)."""
    column = column.cast(pa.large_binary())
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    begin = column.buffers()[1] if len(column) else None
    at = int(np.frombuffer(begin, np.int64)[column.offset]) if begin is not None else 0
    return raw[at : at + 32 * len(column)].view(">u4").astype(np.uint32).reshape(-1, 8)


def binary(words: np.ndarray) -> pa.Array:
    raw = words.astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(len(words) + 1, dtype=np.int32) * 32), pa.py_buffer(raw)])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no block is in two of them; rows are sorted by ``grp`` and ``block``."""
    left = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        same = (held.column("grp").to_numpy(zero_copy_only=False) == held.column("grp")[-1].as_py()) & (held.column("block").to_numpy() == held.column("block")[-1].as_py())
        cut = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield held.slice(0, cut)
        left = held.slice(cut)
    if left is not None and len(left):
        yield left


def _trees(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(number of the block of each row, first row of each block)."""
    grp, block = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    fresh = np.ones(len(batch), bool)
    fresh[1:] = (grp[1:] != grp[:-1]) | (block[1:] != block[:-1])
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def _height(n: np.ndarray, fanout: int, most: int) -> np.ndarray:
    """Levels until one node remains of n, ``most`` at most."""
    h, n = np.zeros(len(n), np.int64), n.astype(np.int64)
    while ((n > 1) & (h < most)).any():
        h += (n > 1) & (h < most)
        n = -(-n // fanout)
    return h


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with ``pos``, their place in their group ``grp`` by ``order``, and ``n``, the group's size."""
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    rows = settled(ranged, "merkle-order")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = rows.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    runs = settled(rows.groupBy("part", "grp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-runs")
    whole = Window.partitionBy("grp")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("part", "grp", "first", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(whole).alias("n"))
    few = runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(starts) if few else starts, ["part", "grp"]).withColumn("pos", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


def _block(size: int) -> Column:
    return F.expr(f"pos div {size}").alias("block")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _block_roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, pos, n, digest): the roots of the blocks of nodes (grp, pos, n, digest), as nodes of the round above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_blocks(batches):
            tree, first = _trees(batch)
            n = batch.column("n").to_numpy()[first]
            _, words, _ = grow(words_of(batch.column("digest")), tree, _height(n, fanout, levels), fanout)
            heads = batch.take(pa.array(first))
            above = -(-n // fanout**levels)
            yield pa.RecordBatch.from_arrays([heads.column("grp"), heads.column("block"), pa.array(above), binary(words)], ["grp", "pos", "n", "digest"])

    cut = _by_block(nodes.select("grp", "pos", "n", "digest", _block(fanout**levels)))
    return cut.mapInArrow(run, "grp string, pos long, n long, digest binary")


def _paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, pos, n, digest, path): what is retained above each node, from what is above its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tree, up, paths in _with_paths(batches, fanout, levels):
            every = np.stack([_pack(x) for x in up], axis=1) if up else np.zeros((len(batch), 0, 1), np.uint32)
            used = np.stack([x.count > 0 for x in up], axis=1) if up else np.zeros((len(batch), 0), bool)
            own = [row[keep].tobytes() + paths[t] for row, keep, t in zip(every, used, tree, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("grp", "pos", "n", "digest")], pa.array(own, pa.binary())], ["grp", "pos", "n", "digest", "path"])

    return _beside(nodes.select("grp", "pos", "n", "digest"), above, fanout**levels).mapInArrow(run, "grp string, pos long, n long, digest binary, path binary")


def _beside(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """Nodes by block, each block led by the row of ``above`` that holds its path: that row has pos -1."""
    rows = nodes.select("*", _block(size), F.lit(None).cast("binary").alias("path"))
    lead = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    return _by_block(rows.unionByName(lead, allowMissingColumns=True))


def _with_paths(batches: Iterator[pa.RecordBatch], fanout: int, levels: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[Level], list[bytes]]]:
    """(rows, block of each row, their levels inside the blocks, path above each block)."""
    for batch in _whole_blocks(batches):
        lead = batch.column("pos").to_numpy() < 0
        paths = batch.filter(pa.array(lead)).column("path").to_pylist()
        batch = batch.filter(pa.array(~lead))
        tree, first = _trees(batch)
        grown, _, _ = grow(words_of(batch.column("digest")), tree, _height(batch.column("n").to_numpy()[first], fanout, levels), fanout)
        node, own = np.arange(len(batch)), []
        for level in grown:
            own.append(level.of(node))
            node = level.parent[node]
        yield batch, tree, own, paths


def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, grp, digest, changed) of every row; ``changed`` is the leaf after tampering, null where there is none.

    Tampering adds one to n_chars where 7 divides the crc32 of the id.
    """
    docs = documents.select(*[F.col(c) for c in FIELDS])

    def leaf(n_chars: Column | None = None) -> Column:
        parts = [_field(c, n_chars if c == "n_chars" else None) for c in FIELDS]
        return F.unhex(F.sha2(F.concat(*parts), 256))

    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then bytewise
    return docs.select("doc_id", grp.alias("grp"), leaf().alias("digest"), F.when(struck, leaf(F.col("n_chars") + 1)).alias("changed"))


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of blocks of those, and so on until each group has one."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(settled(_block_roots(rounds[-1], fanout, levels), "merkle-roots"))
        most = -(-most // fanout**levels)
    return rounds


def manifest(documents: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    ship(documents.sparkSession)
    found = settled(leaves(documents), "merkle-leaves")
    bottom = settled(placed(found, ["doc_id", "digest"]), "merkle-nodes")
    rounds = _rounds(bottom, fanout, block_levels)
    subroots = rounds[-1].select("grp", "digest")
    top = settled(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"]), "merkle-nodes")
    crown = _rounds(top, fanout, block_levels)
    ends = crown[-1].select("digest").take(1)
    root = bytes(ends[0][0]) if ends else b""
    none = F.lit(b"")
    # down again: above the root is nothing
    paths = crown[-1].select("grp", "pos", "n", "digest", none.alias("path"))
    for nodes in reversed(crown[:-1]):
        paths = settled(_paths(nodes, paths, fanout, block_levels), "merkle-paths")
    paths = top.select("of", "pos").join(paths.select("pos", "digest", "path"), "pos").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "digest", "path")
    # a group's subroot is the first thing that travels with its paths
    paths = paths.withColumn("path", F.concat("digest", "path"))
    for nodes in reversed(rounds[1:-1]):
        paths = settled(_carried(nodes, paths, fanout, block_levels), "merkle-paths")
    return _verdicts(bottom, paths, root, fanout, block_levels if len(rounds) > 1 else 0)


def _carried(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``_paths`` of nodes whose paths begin with the 32 bytes of the group's subroot."""
    subroot = above.select("grp", F.col("pos").alias("block"), F.substring("path", 1, 32).alias("subroot"))
    own = _paths(nodes, above.withColumn("path", F.expr("substring(path, 33)")), fanout, levels)
    return own.select("*", _block(fanout**levels)).join(subroot, ["grp", "block"]).select("grp", "pos", "n", "digest", F.concat("subroot", "path").alias("path"))


def _verdicts(bottom: DataFrame, above: DataFrame, root: bytes, fanout: int, levels: int) -> DataFrame:
    """Every leaf's proof and the root that its tampered or original form folds to."""
    names = ["doc_id", "leaf", "subroot", "proof", "folded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tree, own, paths in _with_paths(batches, fanout, levels):
            upper = _unpack([p[32:] for p in paths], fanout)
            every = own + [level.of(tree) for level in upper]
            changed = batch.column("changed")
            leaf = words_of(pc.coalesce(changed, batch.column("digest")))
            subroot = pa.array([p[:32] for p in paths], pa.binary()).take(pa.array(tree))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), subroot, binary(proofs(len(batch), every)), binary(fold(leaf, every))], names)

    kind = bottom.schema["doc_id"].dataType.simpleString()
    rows = _beside(bottom.select("grp", "pos", "n", "digest", "doc_id", "changed"), above.select("grp", "pos", "path"), fanout**levels)
    out = rows.mapInArrow(run, f"doc_id {kind}, leaf binary, subroot binary, proof binary, folded binary")
    as_hex = {"leaf": "leaf", "subroot": "subroot", "proof": "proof_sha256", "folded": "folded_root"}
    told = {new: F.lower(F.hex(old)).alias(new) for old, new in as_hex.items()}
    return out.select("doc_id", told["leaf"], told["subroot"], F.lit(root.hex()).alias("root"), told["proof_sha256"], told["folded_root"], (F.col("folded") == F.lit(root)).alias("verified"))
