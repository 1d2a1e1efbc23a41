"""MinHash near-duplicate detection with DartMinHash sketches.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs.
Darts are thrown into the region of each shingle: [0, weight) by rank, the same darts for the same
shingle in every document. Ranks are cut into cells; a hash of (shingle, unit of weight, cell) says
how many darts fall into it (a Poisson number) and where each lands: its rank and one of
``BANDS * ROWS`` coordinates. Only cells up to the rank that fills the coordinates of a document of
that total weight are looked at (about k ln k darts whatever its length); a document with an empty
coordinate throws the next cells. The earliest dart of a coordinate is a weighted MinHash: two
documents agree there with probability equal to their weighted Jaccard similarity.

Documents with equal texts are one node. Nodes that agree on a band of ``ROWS`` coordinates share a
bucket. First every node of a bucket is compared to the bucket's least node (a star, never all
pairs); similarities are exact, on the shingles themselves, and pairs of ``SIMILARITY`` or more are
links. Where a bucket still holds two components, nodes that can reach nobody are left out (a bound
from the shingles that a node shares with none of the others), and the others are written down as
their difference from a typical node, the hub of the bucket: the shingles that only one of the two has.
The buckets of like nodes agree on a hub by majority, so a node has about one.
Nodes linked to the hub are one component. The differences are then taken from the hub as most of its nodes
have it, and nodes that are surely like the one nearest to that are linked to it, so a link that is still missing has
an end that is too far from it; then the two differences must share a good part of their shingles, and only pairs
that share one of the rarest of them (a prefix filter) are compared, by their differences. So what many
nodes have in common is never a join key, and no link between bucket mates is lost.
Classes are the connected components of the links.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^5)^26 < 4e-5.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one shingle; a null text or
one without words matches nothing. Texts are the same if half of their SHA-256 is, and then
in one class. Rows without an id take part like all others. Rows that share an id
but not the text are different documents of that id. A class is known by its component, a node;
its class id is the least doc_id in it, null if all its rows are without ids, so that rows of class
id null may be of different classes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm import bytescan as bs
from pixelquarry.session import settled, ship

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 26, 5
#: Ids of at most so many documents (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A hub's typical differences are told from about so many of its nodes; units that one in HOT of them or more has are frequent.
TYPICAL, HOT = 64, 16
#: Rank cells: expected darts of the first cell of a unit of weight; each next one doubles the
#: range until a cell holds one dart on average, then all cells are alike.
FINE = 12

_SPREAD = 4.0  # darts beyond k ln k, in units of k: few documents need a second throw


def shingles(pack: bs.Pack, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, occurrence number in the document) of every shingle."""
    begins, ends = bs.spans_of(~bs.IS_SPACE[pack.buf])
    words, docs = bs.span_hashes(pack.buf, begins, ends), pack.doc_of(begins)
    hashes, at = bs.window_hashes(words, docs, width)
    parts, of = [hashes], [docs[at]]
    count = np.bincount(docs, minlength=pack.n)
    start = np.cumsum(count) - count
    for n in range(1, width):  # short texts are one shingle
        short = np.flatnonzero(count == n)
        h = np.full(len(short), n, np.uint64)
        for k in range(n):
            h = bs.mix(h * np.uint64(0x2545F4914F6CDD1D) + words[start[short] + k])
        parts.append(h)
        of.append(short)
    hashes, docs = np.concatenate(parts), np.concatenate(of)
    keys = bs.mix(hashes ^ bs.mix(docs.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    hashes, docs, keys = hashes[order], docs[order], keys[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    runs = np.flatnonzero(fresh)
    occurrence = np.arange(len(docs)) - np.repeat(runs, np.diff(np.append(runs, len(docs))))
    return docs, hashes, occurrence


def _settled(df: DataFrame) -> DataFrame:
    return settled(df, "near-duplicates")


def _cells(expected: float) -> int:
    """How many rank cells hold so many expected darts for a unit of weight."""
    least = 2.0**-FINE
    if expected <= 1:
        return 1 + max(0, math.ceil(math.log2(expected / least)))
    return FINE + 1 + math.ceil(expected - 1)


def _cell(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of rank cells, in expected darts."""
    fine = np.exp2(np.minimum(c, FINE) - 1.0 - FINE)
    begin = np.where(c == 0, 0.0, np.where(c <= FINE, fine, c - FINE * 1.0))
    return begin, np.where(c == 0, 2.0**-FINE, np.where(c <= FINE, fine, 1.0))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) * 2.0**-53


def _throw(units: np.ndarray, docs: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int, best: np.ndarray, sign: np.ndarray) -> None:
    """Throw the darts of cells begin <= c < end of every unit of weight; keep the earliest per coordinate."""
    order = np.argsort(-end, kind="stable")
    units, docs, begin, end = units[order], docs[order], begin[order], end[order]
    for c in range(int(begin.min(initial=0)), int(end.max(initial=0))):
        some = slice(0, int(np.searchsorted(-end, -c, side="left")))
        if begin[some].max(initial=0) > c:
            some = np.flatnonzero((begin <= c) & (c < end))
        own, where = units[some], docs[some]
        if not len(own):
            continue
        lo, width = (float(x) for x in _cell(np.array(c)))
        h = bs.mix(own + np.uint64(c * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        u = _uniform(h)
        # Poisson numbers by inversion: how many steps of the distribution lie below u
        step, total, j = math.exp(-width), math.exp(-width), 0
        hit = np.flatnonzero(u >= total)
        while len(hit):
            g = bs.mix(h[hit] ^ bs.mix(np.array([j + 1], np.uint64)))
            rank = lo + width * _uniform(bs.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            coordinate = ((g >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            slot = where[hit] * k + coordinate
            np.minimum.at(best, slot, rank)
            won = rank == best[slot]
            sign[slot[won]] = g[won]
            j += 1
            step *= width / j
            total += step
            hit = hit[u[hit] >= total] if step > 1e-18 else hit[:0]


def sketch(pack: bs.Pack, k: int = BANDS * ROWS, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of k darts a document, total weights); documents of weight 0 have no valid one."""
    docs, hashes, occurrence = shingles(pack, width)
    units = bs.mix(hashes + bs.mix(occurrence.astype(np.uint64) + np.uint64(1)))
    weight = np.bincount(docs, minlength=pack.n)
    best, sign = np.full(pack.n * k, np.inf), np.zeros(pack.n * k, np.uint64)
    need = k * (math.log(k) + _SPREAD)
    cells = {int(w): _cells(need / w) for w in np.unique(weight[weight > 0])}
    until = np.array([cells.get(int(w), 0) for w in weight])
    begin, end = np.zeros(len(docs), np.int64), until[docs]
    while len(docs):
        _throw(units, docs, begin, end, k, best, sign)
        empty = np.isinf(best.reshape(-1, k)).any(axis=1)[docs]
        units, docs, begin = units[empty], docs[empty], end[empty]
        end = begin + np.maximum(1, begin // 4)
    return sign.reshape(pack.n, k), weight


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        h = bs.mix(h * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, r])
    return h


def text_digest(text: str = "text") -> Column:
    """128 bits of the SHA-256 of a text; null for a null text."""
    return F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))


def sketches(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, weight, keys): text hash, number of shingles and bucket keys of every document."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text")):
                signatures, weight = sketch(pack, bands * rows, width)
                keys = band_keys(signatures, bands, rows).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(pack.n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], batch.column("digest")[begin:end], pa.array(weight.astype(np.int64)), flat],
                    ["doc_id", "digest", "weight", "keys"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), "text").mapInArrow(
        run, "doc_id long, digest binary, weight long, keys array<long>"
    )


def _units(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit) of every unit of weight, and the weight of every row."""
    (_, _, pack), = bs.slices(texts, most=1 << 60)
    docs, hashes, occurrence = shingles(pack, width)
    return docs, bs.mix(hashes + bs.mix(occurrence.astype(np.uint64) + np.uint64(1))), np.bincount(docs, minlength=pack.n)


def similarity(left: pa.Array, right: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each row's two texts."""
    (docs, units, n), (others, theirs, m) = _units(left, width), _units(right, width)
    _, at, _ = np.intersect1d(units ^ bs.mix(docs.astype(np.uint64)), theirs ^ bs.mix(others.astype(np.uint64)), assume_unique=True, return_indices=True)
    both = np.bincount(docs[at], minlength=len(n))
    return both / np.maximum(n + m - both, 1)


def differences(left: pa.Array, right: pa.Array, width: int = SHINGLE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of each row's two texts: the units that only one of them has, as a list, and both weights."""
    (docs, units, n), (others, theirs, m) = _units(left, width), _units(right, width)
    rows, keys = np.concatenate((docs, others)), np.concatenate((units, theirs))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    twice = np.zeros(len(rows), bool)
    twice[1:] = (rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1])
    twice[:-1] |= twice[1:].copy()
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows[~twice], minlength=len(n))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~twice].view(np.int64))), n, m


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the texts of both."""
    return pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    ).select("a", "b", "text_a", "text_b")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of pairs with bounded bytes of text."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column("text_a"))) + np.asarray(pc.binary_length(batch.column("text_b")))
        begin = 0
        while begin < len(batch):
            end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:].astype(np.int64)), bs.SLICE_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity; the texts are joined to them by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            same = pa.array(similarity(part.column("text_a"), part.column("text_b"), width) >= least)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(same), part.column("b").filter(same)], ["a", "b"])

    return _beside(pairs, texts).mapInArrow(run, "a long, b long")


def _spokes(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, hub, delta, weight, hub_weight) of pairs (a, b) of a node and a hub: delta holds the units of only one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            delta, n, m = differences(part.column("text_a"), part.column("text_b"), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), delta, pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))],
                ["node", "hub", "delta", "weight", "hub_weight"],
            )

    return _beside(pairs, texts).mapInArrow(run, "node long, hub long, delta array<long>, weight long, hub_weight long")


def _alike(apart: Column, weights: Column, least: float) -> Column:
    """Whether two nodes of these weights together, ``apart`` of it in one node only, reach the similarity."""
    return (weights - apart) / 2 / F.greatest(weights - (weights - apart) / 2, F.lit(1)) >= least


def _rebased(spokes: DataFrame, least: float) -> DataFrame:
    """The spokes against a reference that is near to most nodes of a hub, with ``cold`` (the rarer units of ``common``), ``size`` and ``slack``.

    The reference is the hub with the units reversed that most of its deltas hold. Any set of units would do, as
    |x - y| is |x - r| + |y - r| less twice what these share; so it is found, and rare told from frequent units, by the deltas
    of about ``TYPICAL`` nodes. Two nodes whose slacks, size - e * weight, are 0 or less together are linked.
    """
    sizes = spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    some = _settled(spokes.join(sizes, "hub").where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TYPICAL)) == 0).select("hub", "common"))
    held = some.select("hub", F.explode("common").alias("unit")).groupBy("hub", "unit").agg(F.count(F.lit(1)).alias("n"))
    held = held.where("n > 1").join(some.groupBy("hub").agg(F.count(F.lit(1)).alias("of")), "hub")
    hubs = _settled(
        held.groupBy("hub").agg(
            F.collect_list(F.when(2 * F.col("n") > F.col("of"), F.col("unit"))).alias("most"),
            F.collect_list(F.when(F.least("n", F.col("of") - F.col("n")) * HOT >= F.col("of"), F.col("unit"))).alias("hot"),
        )
    )
    none = F.array().cast("array<long>")
    known = spokes.join(hubs, "hub", "left").withColumns({c: F.coalesce(c, none) for c in ("most", "hot")})
    missing = F.array_except("most", "delta")
    known = known.withColumns({c: F.concat(F.array_except(c, "most"), missing) for c in ("delta", "common")})
    e = (1 - least) / (1 + least)
    return known.select(
        "hub", "node", "weight", "delta", "common", F.array_except("common", "hot").alias("cold"),
        F.size("delta").alias("size"), (F.size("delta") - e * F.col("weight")).alias("slack"),
    )


def _inner(based: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of nodes so near to the reference that they must be like the nearest one, b."""
    nearest = based.groupBy("hub").agg(F.min(F.struct("slack", "node", "size", "weight")).alias("best")).select("hub", "best.node", "best.size", "best.weight")
    met = based.select("hub", "node", "size", "weight").join(nearest.toDF("hub", "b", "size_b", "weight_b"), "hub").where("node <> b")
    sure = _alike(F.col("size") + F.col("size_b"), F.col("weight") + F.col("weight_b"), least)
    return met.where(sure).select(F.col("node").alias("a"), "b")


def _crossing(based: DataFrame, linked: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of one hub that lie in two components; ``linked`` holds the links of ``_inner``.

    ``common`` is the part of a delta that may lie in another one too; the rest only takes places of the prefix.

    A link of x and y shares at least half the sum of their slacks of the two differences from the reference. That is more
    than 0, or both would be linked to the nearest node. For a node of the nearest one's component the least
    demand over all partners is that of the least slack in other components, for the others that of the nearest node. Units
    come in the order of their frequency, cold ones before the others, which only make rows where the prefix reaches them.
    """
    e = (1 - least) / (1 + least)
    known = based.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nearest = known.groupBy("hub").agg(F.min(F.struct("slack", "node", "component")).alias("best")).select("hub", F.col("best.slack").alias("first"), F.col("best.component").alias("main"))
    known = _settled(known.join(nearest, "hub"))
    second = known.where("component <> main").groupBy("hub").agg(F.min("slack").alias("second"))  # hubs of one component have no row
    demand = (F.col("slack") + F.when(F.col("component") == F.col("main"), F.col("second")).otherwise(F.col("first"))) / 2
    prefix = F.col("size") - F.greatest(F.lit(1), F.ceil(demand - 1e-6)) + 1
    hot = F.size("common") - F.size("cold")
    placed = _settled(
        known.join(second, "hub").withColumn("prefix", prefix).where(F.col("size") - F.size("common") < F.col("prefix"))
        .select("hub", "node", "component", "weight", "delta", "common", "cold", "size", "prefix", (F.col("size") - hot).alias("ahead"))
    )
    units = _settled(
        placed.select("hub", "node", "component", "cold", F.explode(F.when(F.col("ahead") >= F.col("prefix"), F.col("cold")).otherwise(F.col("common"))).alias("unit"))
        .select("hub", "node", "component", "unit", (~F.array_contains("cold", F.col("unit"))).alias("hot"))
    )
    often = units.groupBy("hub", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    # units of one component only come first and lead nowhere: they only take places of the prefix
    shared = _settled(units.select("hub", "node", "unit", "hot").join(often.where("c0 <> c1").drop("c0", "c1"), ["hub", "unit"]))
    rank = F.row_number().over(Window.partitionBy("hub", "node").orderBy("hot", "n", "unit"))
    alone = placed.join(
        shared.groupBy("hub", "node").agg(F.count_if(~F.col("hot")).alias("known")), ["hub", "node"]
    ).select("hub", "node", "component", "weight", "size", "prefix", (F.col("ahead") - F.col("known")).alias("alone"))
    entries = _settled(
        shared.withColumn("rank", rank).join(alone, ["hub", "node"]).withColumn("place", F.col("alone") + F.col("rank") - 1)
        .where("place < prefix").drop("n", "hot", "rank", "alone", "prefix")
    )
    # nodes of a unit's largest component meet only those of others. What is left of meetings inside one component
    # is at most as much as that, since no other is as large
    sizes = entries.groupBy("hub", "unit", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("hub", "unit").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("many")).where("many > 1")
    dealt = entries.join(largest.drop("many"), ["hub", "unit"]).withColumn("big", F.col("component") == F.col("largest"))
    left, right = (
        rows.select("hub", "unit", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "big", "weight", "size", "place")]) for rows, side in ((dealt.where("not big"), "a"), (dealt, "b"))
    )
    weights = F.col("weight_a") + F.col("weight_b")
    needed = (F.col("size_a") + F.col("size_b") - e * weights) / 2 - 1e-6
    pairs = (
        left.join(right, ["hub", "unit"])
        .where("big_b or (component_a <> component_b and node_a > node_b)")
        .where(F.least("weight_a", "weight_b") >= least * F.greatest("weight_a", "weight_b") - 1e-6)
        .where(F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= needed)
        .select("hub", F.greatest("node_a", "node_b").alias("node_a"), F.least("node_a", "node_b").alias("node_b")).distinct()
    )
    sides = [placed.select("hub", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "weight", "delta")]) for side in "ab"]
    both = _settled(pairs).join(sides[0], ["hub", "node_a"]).join(sides[1], ["hub", "node_b"])
    apart = F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))
    return both.where(_alike(apart, weights, least)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node is connected to.

    Labels travel over links and then to the label's own label, until none changes.
    """
    edges = _settled(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = _settled(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        lower = _settled(
            labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("component", "heard").alias("next"), F.col("component").alias("old"))
        )
        # labels that have themselves a lower label: each is looked up once, however many nodes have it
        named = lower.select(F.col("next").alias("node")).distinct().join(lower.select("node", F.col("next").alias("to")), "node")
        jump = _settled(named.where("to < node").select(F.col("node").alias("next"), "to"))
        few = jump.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        nxt = _settled(lower.join(F.broadcast(jump) if few else jump, "next", "left").select("node", F.coalesce("to", "next").alias("component"), "old"))
        if nxt.where("component <> old").limit(1).count() == 0:
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b); ``placed`` has the components so far, nodes that are not in it are their own.

    Only links between components count, as one edge between two of them.
    """
    ends = links.join(placed.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        placed.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left"
    ).select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    merged = components(ends.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct())
    moved = placed.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = merged.join(placed.select(F.col("component").alias("node")).distinct(), "node", "left_anti")  # components of one node so far
    return _settled(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(alone.select("node", "component")))


def _texts(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in pairs, each read at its least document; those without ids at any copy."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep", "digest"), "node")
    involved = _settled(involved)
    total, known = involved.agg(F.count("*"), F.count("rep")).first()
    small = total <= BROADCAST_ROWS
    wanted = involved.where("rep is not null").select(F.col("rep").alias("doc_id"), "node", "digest")
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if small else wanted, "doc_id")
    found = found.where(text_digest() == F.col("digest")).select("node", "text")
    if known < total:
        bare = documents.where("doc_id is null").select(text_digest().alias("digest"), "text")
        others = involved.where("rep is null").select("node", "digest")
        # copies go before a shuffled join, so that no node is many rows of one task
        found = found.union((bare.join(F.broadcast(others), "digest") if small else bare.dropDuplicates(["digest"]).join(others, "digest")).select("node", "text"))
    return _settled(found.dropDuplicates(["node"]))


def _open_rows(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components."""
    split = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    return _settled(placed.join(split, "key"))


def _own_units(texts: DataFrame, width: int) -> DataFrame:
    """(node, own): the units of a node that no other of these nodes has; no row for a node without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, pack in bs.slices(batch.column("text")):
                docs, hashes, occurrence = shingles(pack, width)
                units = bs.mix(hashes + bs.mix(occurrence.astype(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node")[begin:end].take(pa.array(docs)), pa.array(units)], ["node", "unit"])

    units = texts.select("node", "text").mapInArrow(run, "node long, unit long")
    alone = units.groupBy("unit").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return alone.groupBy("node").agg(F.collect_list("unit").alias("own"))


def _common(spokes: DataFrame, own: DataFrame) -> DataFrame:
    """The spokes with ``common``: their delta without the node's own units, which lie in no other delta against the hub."""
    known = spokes.join(own, "node", "left")
    return known.withColumn("common", F.when(F.col("own").isNull(), F.col("delta")).otherwise(F.array_except("delta", "own"))).drop("own")


def _reachable(rows: DataFrame, least: float) -> DataFrame:
    """Without the rows that no node of their bucket can reach.

    A node of weight w, of which ``own`` is nobody else's, shares at most w - own; with a partner of weight
    m or more its similarity is at most (w - own) / (max(m, w - own) + own).
    """
    smallest = rows.groupBy("key").agg(F.min("weight").alias("m"))
    shared = F.col("weight") - F.col("own")
    return _settled(rows.join(smallest, "key").where(shared >= least * (F.greatest("m", shared) + F.col("own"))).drop("m"))


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub): the node that the nodes of a bucket are written down against.

    A bucket's most typical node is the one with the least of its own. Each node prefers the one that is
    typical in the most of its buckets, counted by their sizes, and a bucket takes the preference of most of its
    nodes. So the buckets of one group of like texts share a hub, which need not lie in each of them,
    and a node is written down about once rather than once for each band.
    """
    typical = rows.groupBy("key").agg(F.min(F.struct("own", "node")).alias("hub"), F.count(F.lit(1)).alias("n"))
    known = rows.select("key", "node").join(typical.select("key", F.col("hub.node").alias("hub"), "n"), "key")

    def most(votes: DataFrame, by: str) -> DataFrame:
        return votes.groupBy(by).agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))

    preferred = most(known.groupBy("node", "hub").agg(F.sum("n").alias("n")), "node")
    return most(rows.select("key", "node").join(preferred, "node").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("n")), "key")


def near_duplicates(
    documents: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE
) -> DataFrame:
    """(doc_id, digest, class_id, weight, component) of every document row."""
    sketched = _settled(sketches(documents, bands, rows, width))
    # equal texts are one node; its sketch is that of any copy. The numbers hold, as they are written
    nodes = _settled(
        sketched.where("weight > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = nodes.select("node", "weight", F.explode("keys").alias("key"))
    stars = _settled(
        members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    )
    shared = members.join(stars, "key")
    first = _settled(shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    links = _settled(_verified(first, _texts(documents, nodes, first), least, width))
    linked = components(links)
    # what still lies in two components of one bucket
    placed = _settled(
        shared.select("key", "node", "weight").join(linked, "node", "left").select("key", "node", "weight", F.coalesce("component", "node").alias("component"))
    )
    rest = _open_rows(placed)
    texts = _texts(documents, nodes, rest.select(F.col("node").alias("a"), F.col("node").alias("b")))
    own = _settled(_own_units(texts, width))
    rest = _open_rows(_reachable(rest.join(own.select("node", F.size("own").cast("long").alias("own")), "node", "left").fillna(0, ["own"]), least))
    pairs = _settled(rest.join(_hubs(rest), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    if pairs.limit(1).count():
        spokes = _settled(_common(_spokes(pairs, texts, width), own))
        near = spokes.where(_alike(F.size("delta"), F.col("weight") + F.col("hub_weight"), least))
        based = _settled(_rebased(spokes, least))
        linked = _joined(linked, _settled(near.select(F.col("node").alias("a"), F.col("hub").alias("b")).union(_inner(based, least))))
        linked = _joined(linked, _settled(_crossing(based, linked, least)))
    least_id = (
        nodes.select("node", "rep").join(linked, "node").groupBy("component").agg(F.min("rep").alias("class_id"))
        .join(linked, "component").select("node", "component", "class_id")
    )
    classes = _settled(
        nodes.select("digest", "node", "rep").join(least_id, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("component"), F.coalesce("class_id", "rep").alias("class_id"))
    )
    return (
        sketched.select("doc_id", "digest", "weight").join(classes, "digest", "left")
        .select("doc_id", "digest", F.when(F.col("weight") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "weight", "component")
    )


def survivors(documents: DataFrame, **how) -> DataFrame:
    """One row of each class (component): that of the least id, or any row of a class without ids.

    Rows without words are all kept. The columns are those of the input.
    """
    classed = _settled(near_duplicates(documents, **how))
    rows = classed.where("weight > 0").groupBy("component", "doc_id", "digest").count()
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    kept = _settled(rows.join(best, "component").select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest"), "count", same.alias("keep")))
    keyed = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_digest().alias("digest"))
    on = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("digest") == F.col("g_digest"))
    out = keyed.join(kept.where("not keep"), on, "left_anti")
    twice = kept.where("keep and count > 1")
    if twice.limit(1).count():  # repeated rows: one of them
        out = out.join(twice, on, "left_anti").unionByName(out.join(twice, on, "left_semi").dropDuplicates(["id", "digest"]))
    return out.select("row.*")
