"""SimHash near-duplicate detection with deletion-variant signatures.

A document's features are its three-word shingles, repeats included, hashed by XXH64; a fingerprint
bit is set where more than half of the hashes have it. Two fingerprints are linked at
``DISTANCE`` or fewer differing bits.

To find the links, a fingerprint is cut into two segments, fewer than the three of which one would
be equal: of a link, at least one segment differs in at most one bit. Each segment is indexed
under one variant for each of its bits, with that bit left out (a wildcard), so two segments that
differ in one bit or none meet under an equal key. Rows are dealt and sorted by key, and what meets is
verified on the whole fingerprint; a link is given out by one of its keys only.

A key that more than ``BUCKET`` different fingerprints have is not compared pair by pair. Its members
are passed on as they come, and indexed again under their own value and all values one bit from it:
two fingerprints are linked just if they share such a value (one of the differing bits turned), and all that
share one are links of each other, so the least of them stands for the rest, nothing is verified and nothing is
lost. Every link has a key; if that one is large, both ends are indexed again.

Classes are the connected components of the fingerprints; equal fingerprints are one node, so
copies are never paired.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, joined by one space; fewer than three words are one
shingle; a null text or one without words has fingerprint zero, linked like any other. Rows
without an id have a fingerprint and link others; component_id is the least id reachable, null if there is
none. Repeated rows keep a row each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.llm.dart_minhash import components
from pixelquarry.session import settled, ship

DISTANCE = 2
SEGMENTS, WIDTH = 2, 32
SHINGLE = 3
SEED = 42
#: Different fingerprints of one key that are compared pair by pair; more are indexed by their neighbours.
BUCKET = 48
#: Fingerprints of components (16 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Longer shingles are hashed one by one.
_LONG = 256

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every span of the bytes."""
    size = ends - begins
    out = np.zeros(len(begins), np.uint64)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(buf))
        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(raw[int(begins[i]) : int(ends[i])], seed)
    rows = np.flatnonzero(size <= _LONG)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    eight = np.empty(len(buf) + 8, np.uint64)  # the eight bytes from each place
    for k in range(8):
        part = padded[k : k + len(eight[k::8]) * 8].view("<u8")
        eight[k::8] = part
    at, left = begins[rows].astype(np.int64), size[rows].astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(rows), s + _P5, np.uint64)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            acc = [np.full(len(wide), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            go = np.arange(len(wide))
            while len(go):
                w = wide[go]
                for lane in range(4):
                    acc[lane][go] = _round(acc[lane][go], eight[at[w] + 8 * lane])
                at[w] += 32
                left[w] -= 32
                go = go[left[w] >= 32]
            v = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                v = (v ^ _round(np.zeros(len(wide), np.uint64), a)) * _P1 + _P4
            h[wide] = v
        h += size[rows].astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(left >= 8)
            h[go] = _turn(h[go] ^ _round(np.zeros(len(go), np.uint64), eight[at[go]]), 27) * _P1 + _P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        h[go] = _turn(h[go] ^ ((eight[at[go]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[go] += 4
        left[go] -= 4
        for _ in range(3):
            go = np.flatnonzero(left > 0)
            h[go] = _turn(h[go] ^ ((eight[at[go]] & np.uint64(0xFF)) * _P5), 11) * _P1
            at[go] += 1
            left[go] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out[rows] = h
    return out


def shingle_hashes(pack: bs.Pack, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, XXH64) of every shingle, ordered by document."""
    begins, ends = bs.spans_of(~bs.IS_SPACE[pack.buf])
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    docs = pack.doc_of(begins)
    # words with one space between them
    size = ends - begins
    to = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    inside = ~bs.IS_SPACE[pack.buf]
    keep = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[keep] = pack.buf[inside]
    upper = (joined >= 0x41) & (joined <= 0x5A)
    joined[upper] |= 0x20
    count = np.bincount(docs, minlength=pack.n)
    first = np.cumsum(count) - count
    per_doc = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(pack.n), per_doc)
    word = np.arange(len(of)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + first[of]
    last = np.minimum(word + width, first[of] + count[of]) - 1
    return of, xxh64(joined, to[word], to[last] + size[last])


def fingerprints_of(pack: bs.Pack, width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of every document of a pack."""
    docs, hashes = shingle_hashes(pack, width)
    out = np.zeros(pack.n, np.uint64)
    if not len(docs):
        return out
    n = np.bincount(docs, minlength=pack.n)
    some = np.flatnonzero(n)
    begins = (np.cumsum(n) - n)[some]
    for byte in range(8):  # bits of one byte at a time keep memory small
        part = ((hashes >> np.uint64(8 * byte)) & np.uint64(0xFF)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little")[:, 0]
        out[some] |= packed.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint as a signed long."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text")):
                got = pa.array(fingerprints_of(pack, width).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], got], ["doc_id", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, print of each key): segment, left-out bit and the segment's other 31 bits, for both segments and all bits."""
    keys = []
    for number in range(SEGMENTS):
        segment = (prints >> np.uint64(WIDTH * number)) & np.uint64((1 << WIDTH) - 1)
        for bit in range(WIDTH):
            under = segment & np.uint64((1 << bit) - 1)
            over = (segment >> np.uint64(bit + 1)) << np.uint64(bit)
            keys.append(np.uint64((number * WIDTH + bit) << (WIDTH - 1)) | over | under)
    return np.concatenate(keys), np.tile(prints, len(keys))


def _giving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The segment and left-out bit by which a pair is given out: its first segment that differs in one bit or none, at that bit or at 0."""
    wanted = np.full(len(a), -1, np.int64)
    for number in range(SEGMENTS):
        differ = ((a ^ b) >> np.uint64(WIDTH * number)) & np.uint64((1 << WIDTH) - 1)
        bit = np.bitwise_count(np.maximum(differ, np.uint64(1)) - np.uint64(1))
        wanted = np.where((wanted < 0) & (np.bitwise_count(differ) <= 1), number * WIDTH + bit.astype(np.int64), wanted)
    return wanted


def bucket_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between prints under one key; rows are sorted by key."""
    left, right, step = [prints[:0]], [prints[:0]], 1
    at = np.arange(len(keys))
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= DISTANCE]
        own = near[(keys[near] >> np.uint64(WIDTH - 1)).astype(np.int64) == _giving(prints[near], prints[near + step])]
        left.append(prints[own])
        right.append(prints[own + step])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def neighbours(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, print) of all values at most one bit away."""
    values = [prints, *(prints ^ np.uint64(1 << bit) for bit in range(64))]
    return np.concatenate(values), np.tile(prints, len(values))


def _spread(prints: DataFrame, by: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    """(name, fingerprint): the rows that ``by`` makes of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                values, own = by(batch.column("fingerprint")[begin : begin + 1000].to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(own.view(np.int64))], [name, "fingerprint"])

    return prints.select("fingerprint").mapInArrow(run, f"{name} long, fingerprint long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the different fingerprints of ``prints``, enough of them to connect all that are linked."""
    ship(prints.sparkSession)

    def judged(keys: np.ndarray, own: np.ndarray, large: np.uint64 | None) -> pa.RecordBatch:
        size = np.diff(np.append(np.flatnonzero(np.diff(keys, prepend=~keys[:1])), len(keys)))
        many = np.repeat(size > bucket, size)
        if large is not None:
            many |= keys == large
        a, b = bucket_links(keys[~many], own[~many])
        alone = own[many]
        one, other = np.concatenate([a, alone]), np.concatenate([b, alone])
        return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(other.view(np.int64), mask=np.arange(len(one)) >= len(a))], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of small keys; the members of large ones with b null, as they come."""
        keys, own, large = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            own = np.concatenate([own, batch.column("fingerprint").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if len(keys) - cut > bucket or (large is not None and keys[-1] == large):
                yield judged(keys, own, large)
                large, keys, own = keys[-1], keys[:0], own[:0]
            elif cut:
                yield judged(keys[:cut], own[:cut], large)
                keys, own = keys[cut:], own[cut:]
        if len(keys):
            yield judged(keys, own, large)

    keyed = _spread(prints, variants, "key").repartition("key").sortWithinPartitions("key")
    met = settled(keyed.mapInArrow(meet, "a long, b long"), "simhash-met")
    again = met.where("b is null").select(F.col("a").alias("fingerprint")).distinct()
    # at most 65 different fingerprints have a value
    shared = _spread(again, neighbours, "value").groupBy("value").agg(F.collect_set("fingerprint").alias("own")).where(F.size("own") > 1)
    arms = shared.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b").distinct()
    return met.where("b is not null").unionByName(arms)


def near_duplicates(documents: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint as 16 lowercase hexadecimal digits."""
    printed = settled(fingerprints(documents, width), "simhash-prints")
    nodes = settled(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = components(settled(links(nodes, bucket), "simhash-links"))
    members = nodes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = settled(members.select("fingerprint", "component", "least").join(least, "component").select("fingerprint", "component_id"), "simhash-classes")
    few = moved.count() <= BROADCAST_ROWS
    every = nodes.join(F.broadcast(moved) if few else moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return printed.join(every, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
