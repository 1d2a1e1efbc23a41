"""Texts as sequences of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.session import ship

#: Bytes of texts that are laid out together.
_SLICE = 1 << 20


def text_bytes(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, v): the UTF-8 bytes of every text, numbered from 0; null and empty texts have none."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(key), batch.column("_bytes").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            begin = 0
            while begin < len(column):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _SLICE, side="right")) - 1)
                end = min(end, len(column))
                size = np.diff(offsets[begin : end + 1])
                row = np.repeat(np.arange(begin, end), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                v = raw[offsets[begin] : offsets[end]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(pos), pa.array(v)], [key, "pos", "v"])
                begin = end

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes")).mapInArrow(run, f"{key} {kind}, pos long, v int")


def text_runs(texts: DataFrame, key: str, text: str = "text", least: int = 1, piece: int = _SLICE) -> DataFrame:
    """(key, start, v, length): the maximal runs of equal UTF-8 bytes of every text, of length ``least`` or more; null and empty texts have none.

    A text is one row, so its runs are found where it is read, ``piece`` bytes at a time, and no byte becomes a row that
    is shuffled or sorted. Texts that share a key are different texts.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(key), batch.column("_bytes").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            if offsets[-1] == offsets[0]:
                continue
            raw = np.frombuffer(column.buffers()[2], np.uint8)
            open_ = np.zeros(0, np.int64)  # the start of a run whose end is not seen yet
            for begin in range(int(offsets[0]), int(offsets[-1]), piece):
                end = min(begin + piece, int(offsets[-1]))
                fresh = np.ones(end - begin, bool)
                fresh[1:] = raw[begin + 1 : end] != raw[begin : end - 1]
                fresh[0] = begin == offsets[0] or raw[begin] != raw[begin - 1]
                first, last = np.searchsorted(offsets, (begin, end))
                fresh[offsets[first:last] - begin] = True
                starts = np.concatenate((open_, np.flatnonzero(fresh) + begin))
                ends = starts[1:]
                if end == offsets[-1]:
                    ends = np.append(ends, end)
                open_, starts = starts[len(ends) :], starts[: len(ends)]
                long = ends - starts >= least
                starts, ends = starts[long], ends[long]
                row = np.searchsorted(offsets, starts, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), pa.array(starts - offsets[row]), pa.array(raw[starts].astype(np.int32)), pa.array(ends - starts)],
                    [key, "start", "v", "length"],
                )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes")).mapInArrow(run, f"{key} {kind}, start long, v int, length long")
