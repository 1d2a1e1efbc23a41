"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put in a hashed order and cut into blocks. With W the sum of the weights,
the j-th block of a source of weight w is released at slot floor(j W / w) and due by slot
ceil((j + 1) W / w). One block runs per slot, the released block with the earliest deadline first.
As the weights fill the processor exactly, every block meets its window, so at any slot each
source is less than one block away from its share, whatever the weights: they are taken as the
exact fractions that their numbers are, and all windows are computed in whole numbers.

A block is the same share of the rows at every size: all rows make about ``SLOTS`` blocks (single rows,
if they are fewer), and that schedule of bounded length is laid out on the driver from the
row counts of the sources. When a source runs out, the remaining ones go on from the next slot with
their weights scaled up: a new segment, from whose begin windows and shares count. This takes time
in proportion to slots, and to sources times segments. All rows are kept.

Defined cases: a null source is a source of its own; null, repeated and tied ids keep all
their rows; a source absent from the given weights, or of weight 0 or less, gets the least of the
given weights; weights of absent sources are unused; empty tables give no rows. Columns of the
input that clash with the result's are replaced in ``mix`` and ignored in ``schedule``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 17
#: Longest schedule that is broadcast, in slots; a longer one (of small given blocks) is joined by shuffle.
BROADCAST_SLOTS = 500_000

ADDED = ["rank", "block", "release", "deadline", "slot", "mix_position"]


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the same proportion."""
    exact = {k: Fraction(v) for k, v in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    return {k: int(x * scale) for k, x in exact.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """(slot, release, deadline) of every block of each source: released blocks by earliest deadline, ties by name."""
    w = whole_weights({k: weights[k] for k, n in blocks.items() if n > 0})
    out: dict[str, list[tuple[int, int, int]]] = {k: [] for k in w}
    begin = slot = 0  # the segment's first slot, the next slot
    while w:
        total = sum(w.values())
        first = {k: len(out[k]) for k in w}
        waiting = [(0, k) for k in w]
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int]] = []
        while True:
            now = slot - begin
            while waiting and waiting[0][0] <= now:
                release, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(len(out[k]) - first[k] + 1) * total // w[k]), k, release))
            deadline, k, release = heapq.heappop(ready)
            out[k].append((slot, begin + release, begin + deadline))
            slot += 1
            if len(out[k]) == blocks[k]:
                break
            heapq.heappush(waiting, ((len(out[k]) - first[k]) * total // w[k], k))
        del w[k]
        begin = slot
    return out


def _key(source: str = "source"):
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def _ranked(docs: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Adds _rank, the place in the source by md5 of the id: counts of hash ranges, then places inside them.

    Rows without an id are spread by a hash of their columns.
    """
    digits = max(2, math.ceil(math.log(max(1, sum(counts.values()) / 100_000), 16)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]).cast("string"))
    keyed = docs.withColumn("_md5", F.md5(name)).withColumn("_bin", F.substring("_md5", 1, digits))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_key", "_bin").count().select("_key", "_bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_key", "_bin").orderBy("_md5", "doc_id")
    return keyed.join(starts, ["_key", "_bin"]).withColumn("_rank", F.col("_from") + F.row_number().over(inside) - 1).drop("_md5", "_bin", "_from")


def default_weights(counts: Mapping[str, int]) -> dict[str, float]:
    """Square roots of the row counts: large sources are damped, all stay present."""
    return {k: math.sqrt(n) for k, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """The rows with rank, block, release, deadline, slot and mix_position (order by the last one)."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED).withColumn("_key", _key())
    counts = {r["_key"]: r["count"] for r in docs.groupBy("_key").count().collect()}  # one row a source
    if weights is None:
        wanted = default_weights(counts)
    else:
        named = {"-" if k is None else "+" + k: float(v) for k, v in weights.items() if v > 0}
        least = min(named.values(), default=1.0)
        wanted = {k: named.get(k, least) for k in counts}
    size = block_rows or max(1, -(-sum(counts.values()) // SLOTS))
    plan = schedule({k: -(-n // size) for k, n in counts.items()}, wanted)
    rows = [(k, j, *x) for k, own in plan.items() for j, x in enumerate(own)]
    kinds = [pa.string(), *[pa.int64()] * 4]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    table = spark.createDataFrame(
        pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["_key", "block", "slot", "release", "deadline"])
    )
    placed = _ranked(docs, counts).withColumn("block", F.expr(f"_rank div {size}"))
    return (
        placed.join(F.broadcast(table) if len(rows) <= BROADCAST_SLOTS else table, ["_key", "block"])
        .withColumn("rank", F.col("_rank"))
        .withColumn("mix_position", F.col("slot") * size + F.col("rank") % size)
        .select(*[c for c in docs.columns if c != "_key"], *ADDED)
    )


def in_order(mixed: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """The rows laid out so that reading the parts in turn gives the mix: part by range of position."""
    last = mixed.agg(F.max("mix_position")).first()[0]
    parts = max(1, -(-((last or 0) + 1) // rows_per_part))
    part = F.least(F.floor(F.col("mix_position") / rows_per_part), F.lit(parts - 1)).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("mix_position")
