"""Bands of rows: neighbours of pixels without a window over a whole image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a band: an image of any height is spread over tasks by bands of so many rows.
BAND = 64


def in_bands(pixels: DataFrame, above: bool = True, below: bool = False, rows: int = BAND) -> DataFrame:
    """The pixels dealt by (image_id, _band), with the row before a band and the row behind it, where asked for, as a halo.

    Rows of the halo have ``_own`` false. A window by (image_id, _band, ...) needs no further exchange.
    """
    band = F.expr(f"y div {rows}").cast("long")
    first, last = F.col("y") % rows == 0, F.col("y") % rows == rows - 1
    to = [band]
    if above:  # a band's last row is the halo above the next
        to.append(F.when(last, band + 1))
    if below:
        to.append(F.when(first & (F.col("y") > 0), band - 1))
    dealt = pixels.withColumn("_band", F.explode(F.array_compact(F.array(*to))))
    return dealt.withColumn("_own", F.col("_band") == band).repartition("image_id", "_band")
