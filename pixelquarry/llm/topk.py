"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query of a slice with one matrix product per block.
Score histograms are summed over all blocks and refined, ``BINS`` bins a pass, until the bin
that holds each query's k-th score is known closely; then only rows at or above it are kept
and ranked, ties to the smaller vec_id.

A block reports only the bins down to its own k-th best score. The k-th best of all rows is
never below that of a block, so every bin from the global k-th upwards is counted in full,
and a block sends at most k bins a query.

Queries are taken in slices of bounded bytes (``SLICE_BYTES``), each broadcast in turn, so what
is broadcast does not grow with the table.

Defined cases: vectors that are null, hold a null or non-finite component, or have a null id
take no part. A query meets only vectors of its own length. Rows that share a query's vec_id are
the query's own; if they differ, the one whose components sort first is the query. Repeated
candidate rows each count. Fewer than k candidates: all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import shared_dir, ship

FOUND = "query_id long, vec_id long, score long"
BINS = 4096
SLICE_BYTES = 4_000_000
BLOCK = 1024


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, without the vectors that take no part."""
    x = F.col("embedding")
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    )
    return vectors.where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"),
    )


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and the flat components."""
    return np.asarray(pc.list_value_length(column)), np.asarray(column.flatten())


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where they are exact, else in 64-bit integers."""
    most = (np.abs(queries).max(initial=0) * np.abs(block).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ block.T).astype(np.int64)
    return queries.astype(np.int64) @ block.T.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], shared, k: int):
    """(query index, candidate ids, scores, k-th best score a query) of each block and vector length."""
    for batch in batches:
        ids = np.asarray(batch.column("vec_id"))
        lengths, flat = _matrix(batch.column("v"))
        start = np.concatenate(([0], np.cumsum(lengths)))
        for dim, (index, q_ids, matrix) in shared.value.items():
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), BLOCK):
                some = rows[at : at + BLOCK]
                block = flat[start[some][:, None] + np.arange(dim)]
                s = _scores(matrix, block)
                own = q_ids[:, None] == ids[some][None, :]
                free = len(some) - own.sum(axis=1)
                low = np.where(own, np.iinfo(np.int64).min, s)
                kth = np.partition(low, -k, axis=1)[:, -k] if len(some) > k else low.min(axis=1)
                kth = np.where(free > k, kth, np.iinfo(np.int64).min)
                yield index, ids[some], s, ~own & (s >= kth[:, None])


def _histogram(shared, low: np.ndarray, high: np.ndarray, width: np.ndarray, k: int):
    """Counts of the scores in [low, high) by bins of the query's width."""

    def run(batches):
        for index, _, s, wanted in _blocks(batches, shared, k):
            lo, hi, w = (x[index][:, None] for x in (low, high, width))
            b = (s - lo) // w
            q, c = np.nonzero(wanted & (s >= lo) & (s < hi))
            keys, n = np.unique(index[q] * BINS + b[q, c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // BINS), pa.array(keys % BINS), pa.array(n.astype(np.int64))], ["q", "bin", "n"])

    return run


def _selected(shared, low: np.ndarray, q_ids: np.ndarray, k: int):
    def run(batches):
        for index, ids, s, wanted in _blocks(batches, shared, k):
            q, c = np.nonzero(wanted & (s >= low[index][:, None]))
            score, vec, query = s[q, c], ids[c], index[q]
            order = np.lexsort((vec, -score, query))
            query, vec, score = query[order], vec[order], score[order]
            first = np.searchsorted(query, query, side="left")
            top = np.arange(len(query)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[query[top]]), pa.array(vec[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def _slice_topk(candidates: DataFrame, queries: list, k: int, top_norm: float) -> tuple[DataFrame, Broadcast]:
    """The best candidates of one slice of queries, a few more than k for some, and what they were broadcast as."""
    q_ids = np.array([r.vec_id for r in queries], np.int64)
    by_dim: dict[int, tuple] = {}
    lengths = np.array([len(r.v) for r in queries])
    for dim in np.unique(lengths):
        index = np.flatnonzero(lengths == dim)
        by_dim[int(dim)] = (index, q_ids[index], np.array([queries[i].v for i in index], float).reshape(len(index), dim))
    shared = candidates.sparkSession.sparkContext.broadcast(by_dim)
    norms = np.array([float(np.sqrt(np.dot(r.v, r.v))) for r in queries])
    bound = np.minimum(np.ceil(norms * top_norm) + 1, 2.0**61).astype(np.int64)
    low, high, above = -bound, bound + 1, np.zeros(len(q_ids), np.int64)  # above: how many score high or more
    width = -(-(high - low) // BINS)
    running = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    while True:
        before = candidates.sparkSession.createDataFrame([(i, int(a)) for i, a in enumerate(above)], "q long, above long")
        found = (
            candidates.mapInArrow(_histogram(shared, low, high, width, k), "q long, bin long, n long")
            .groupBy("q", "bin").agg(F.sum("n").alias("n"))
            .withColumn("upto", running)
            .join(F.broadcast(before), "q")  # one row a query of this slice
            .where(F.col("upto") + F.col("above") >= k)
            .groupBy("q").agg(F.max(F.struct("bin", "upto", "n")).alias("at"))
            .collect()  # one row a query of this slice
        )
        open_ = False
        for r in found:
            q, at = r.q, r["at"]
            low[q] += at.bin * width[q]
            if width[q] > 1 and above[q] + at.upto > 4 * k:
                above[q] += at.upto - at.n
                high[q] = low[q] + width[q]
                width[q] = -(-width[q] // BINS)
                open_ = True
            else:
                high[q] = low[q]  # known closely enough: no further bins
        if not open_:
            return candidates.mapInArrow(_selected(shared, low, q_ids, k), FOUND), shared


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query row."""
    spark = vectors.sparkSession
    ship(spark)
    candidates = scaled(vectors, scale)
    queries = candidates.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    stats = candidates.agg(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"), F.max(F.size("v")).alias("dim")
    ).first()
    total = queries.count()
    slices = max(1, -(-total * 8 * max(1, stats.dim or 1) // slice_bytes))
    # one slice after the other, each written down: the plan is of one size, whatever the number of queries
    place, best = f"{shared_dir(spark)}/topk-{uuid.uuid4()}", spark.createDataFrame([], FOUND)
    for i in range(slices):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == i).orderBy("vec_id").collect()
        if not some:
            continue
        part, shared = _slice_topk(candidates, some, k, float(stats.norm))
        if slices == 1:
            best = part
        else:
            part.write.mode("append").parquet(place)
            shared.destroy()
            best = spark.read.schema(FOUND).parquet(place)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
