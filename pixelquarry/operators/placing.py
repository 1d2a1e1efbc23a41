"""Rows in files of ranges: exact places in an order, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.session import settled


def in_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows sorted into files of ranges of ``order`` and read back with ``part`` and ``row``, the number of the file and the place in it.

    The files are in order, so a group that holds most of the rows is spread over many of them.
    """
    written = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order), name)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return written.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))
