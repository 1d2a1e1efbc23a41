"""Runs, deltas, predictions and per-pixel operation classes along raster order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixelquarry.functions import color as C
from pixelquarry.operators.bands import in_bands
from pixelquarry.session import ship


def rle_runs(seq: DataFrame, key: list[str], order: str, value: str, cap: int | None = None) -> DataFrame:
    """Maximal runs of equal values: (key, start, value, length); runs longer than ``cap`` are cut."""
    w = Window.partitionBy(*key).orderBy(order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = seq.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(w))
    parts = [*key, "_run"]
    if cap:
        place = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(order)) - 1
        runs = runs.withColumn("_part", F.floor(place / cap))
        parts.append("_part")
    return runs.groupBy(*parts).agg(F.min(order).alias("start"), F.first(value).alias(value), F.count(F.lit(1)).alias("length")).drop("_run", "_part")


def rle_expand(runs: DataFrame, key: list[str], value: str, width: int | None = None, on_overrun: str = "error") -> DataFrame:
    """Runs (in order of ``start``) to positions. Past ``width`` a run is clipped, or flagged in ``overrun``."""
    w = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    at = runs.withColumn("_from", F.coalesce(F.sum("length").over(w), F.lit(0)))
    end = F.col("_from") + F.col("length")
    if width is not None:
        at = at.withColumn("overrun", end > width) if on_overrun == "error" else at.where(F.col("_from") < width)
        end = end if on_overrun == "error" else F.least(end, F.lit(width))
    return at.withColumn("pos", F.explode(F.sequence(F.col("_from"), end - 1))).select(*key, "pos", value, *(["overrun"] if width is not None and on_overrun == "error" else []))


def delta_encode(seq: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``delta``: value less its predecessor, modulo 256."""
    w = Window.partitionBy(*key).orderBy(order)
    return seq.withColumn("delta", F.pmod(F.col(value) - F.lag(value, 1, 0).over(w), F.lit(256)))


def delta_decode(seq: DataFrame, key: list[str], order: str, delta: str = "delta") -> DataFrame:
    """``value``: running sum of deltas, modulo 256."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seq.withColumn("value", (F.sum(delta).over(w) % 256).cast("int"))


def _raster() -> WindowSpec:
    return Window.partitionBy("image_id", "_band").orderBy("pos")


def _banded(pixels: DataFrame, width: int) -> DataFrame:
    """The pixels in bands of rows, each with the row above it, and ``pos`` in raster order."""
    return in_bands(pixels).withColumn("pos", C.raster_order("y", "x", F.lit(width)))


def _owned(banded: DataFrame) -> DataFrame:
    return banded.where("_own").drop("_own", "_band")


def neighbours(pixels: DataFrame, value: str, width: int) -> DataFrame:
    """Adds left, up, up-left and up-right of raster order (null outside the image; up-right wraps on)."""
    lag = lambda n: F.lag(value, n).over(_raster())
    edge = F.col("x") == 0
    return _owned(_banded(pixels, width).withColumns(
        {"_l": F.when(~edge, lag(1)), "_u": lag(width), "_ul": F.when(~edge, lag(width + 1)), "_ur": lag(width - 1) if width > 1 else lag(1)}
    ))


def filter_residuals(pixels: DataFrame, value: str, width: int) -> DataFrame:
    """Residuals of the five scanline filters; what lies outside the image counts as 0."""
    n = neighbours(pixels, value, width)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    v = F.col(value)
    mod = lambda x: F.pmod(x, F.lit(256)).cast("int")
    return n.select(
        "image_id", "y", "x", mod(v).alias("none"), mod(v - z("_l")).alias("sub"), mod(v - z("_u")).alias("up"),
        mod(v - F.floor((z("_l") + z("_u")) / 2)).alias("average"), mod(v - C.paeth(z("_l"), z("_u"), z("_ul"))).alias("paeth"),
    )


def _predictors(t: Column, left: Column, tl: Column, tr: Column) -> dict[int, Column]:
    avg = lambda a, b: F.floor((a + b) / 2).cast("int")
    half = lambda a, b: F.floor((a - b) / 2 + F.when(a < b, 0.5).otherwise(0)).cast("int")  # noqa: E731  towards zero
    return {
        1: left, 2: t, 3: tr, 4: tl, 5: avg(avg(left, tr), t), 6: avg(left, tl), 7: avg(left, t), 8: avg(tl, t), 9: avg(t, tr),
        10: avg(avg(left, tl), avg(t, tr)), 12: C.clamp_byte(left + t - tl), 13: C.clamp_byte(avg(left, t) + half(avg(left, t), tl)),
    }


def predictor_residual(pixels: DataFrame, value: str, width: int, mode: int) -> DataFrame:
    """Residual of one predictor per channel: the first row uses left, the first column top, the first pixel 0.

    Mode 0 predicts 0 (colour channels). Mode 11 selects by all channels; see ``select_residual``.
    """
    n = neighbours(pixels, value, width)
    inner = F.lit(0) if mode == 0 else _predictors(F.col("_u"), F.col("_l"), F.col("_ul"), F.col("_ur"))[mode]
    guess = (
        F.when((F.col("x") == 0) & (F.col("y") == 0), 0).when(F.col("y") == 0, F.col("_l")).when(F.col("x") == 0, F.col("_u")).otherwise(inner)
    )
    return n.select("image_id", "y", "x", F.pmod(F.col(value) - guess, F.lit(256)).cast("int").alias("residual"))


def select_residual(pixels: DataFrame, width: int) -> DataFrame:
    """Residuals of the select predictor: left or top, whichever is nearer over all four channels."""
    at = lambda c, k: F.lag(c, k).over(_raster())
    n = _owned(_banded(pixels, width).withColumns({f"_{c}{k}": at(c, d) for c in "rgba" for k, d in (("l", 1), ("u", width), ("d", width + 1))}))
    total = lambda k: sum((F.abs(F.col(f"_{c}{k}") - F.col(f"_{c}d")) for c in "rgba"), F.lit(0))
    use_left = total("u") < total("l")  # left's distance is |top - top left|
    guess = lambda c: (
        F.when((F.col("x") == 0) & (F.col("y") == 0), 0).when(F.col("y") == 0, F.col(f"_{c}l")).when(F.col("x") == 0, F.col(f"_{c}u"))
        .when(use_left, F.col(f"_{c}l")).otherwise(F.col(f"_{c}u"))
    )
    return n.select("image_id", "y", "x", *[F.pmod(F.col(c) - guess(c), F.lit(256)).cast("int").alias(c) for c in "rgba"])


def gradient_residual(plane: DataFrame, value: str, width: int, kind: int) -> DataFrame:
    """Alpha-plane residuals: 1 horizontal, 2 vertical, 3 gradient; border pixels use what they have."""
    n = neighbours(plane, value, width)
    left, up = F.col("_l"), F.col("_u")
    along = F.when(F.col("x") > 0, left).when(F.col("y") > 0, up).otherwise(0)
    down = F.when(F.col("y") > 0, up).when(F.col("x") > 0, left).otherwise(0)
    inner = {1: along, 2: down, 3: F.when((F.col("x") > 0) & (F.col("y") > 0), C.clamp_byte(left + up - F.col("_ul"))).otherwise(along)}[kind]
    return n.select("image_id", "y", "x", F.pmod(F.col(value) - inner, F.lit(256)).cast("int").alias("residual"))


def gradient_restore(residuals: DataFrame, kind: int, residual: str = "residual") -> DataFrame:
    """(image_id, y, x, v) of alpha-plane residuals: undoes ``gradient_residual``.

    Kinds 1 and 2 are running sums, down the first column (or along the first row) and then along each row (down each
    column). Kind 3 depends on left, up and their corner at once: each image is undone by wavefronts, one diagonal after the other.
    """
    if kind in (1, 2):
        along, across = ("x", "y") if kind == 1 else ("y", "x")
        # the first sample of each line is the sum of all firsts up to it
        edge = residuals.where(F.col(along) == 0).select("image_id", across, F.sum(residual).over(Window.partitionBy("image_id").orderBy(across)).alias("_edge"))
        line = Window.partitionBy("image_id", across).orderBy(along)
        inner = F.sum(F.when(F.col(along) > 0, F.col(residual)).otherwise(0)).over(line)
        return residuals.join(edge, ["image_id", across]).select("image_id", "y", "x", F.pmod(F.col("_edge") + inner, F.lit(256)).cast("int").alias("v"))

    ship(residuals.sparkSession)

    def undo(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy().astype(np.int64) for c in "yx")
        h, w = int(y.max()) + 1, int(x.max()) + 1
        v, there = np.zeros((h, w), np.int64), np.zeros((h, w), bool)
        v[y, x], there[y, x] = table.column("residual").to_numpy(), True
        v[0], v[:, 0] = np.cumsum(v[0]) % 256, np.cumsum(v[:, 0]) % 256
        for k in range(2, h + w - 1):
            row = np.arange(max(1, k - w + 1), min(h, k))
            col = k - row
            guess = np.clip(v[row, col - 1] + v[row - 1, col] - v[row - 1, col - 1], 0, 255)
            v[row, col] = (v[row, col] + guess) % 256
        return pa.table({"image_id": table.column("image_id"), "y": table.column("y"), "x": table.column("x"), "v": pa.array(v[y, x].astype(np.int32))})

    shaped = residuals.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(residual).cast("int").alias("residual"))
    kind_of = shaped.schema["image_id"].dataType.simpleString()
    return shaped.groupBy("image_id").applyInArrow(undo, f"image_id {kind_of}, y int, x int, v int")


def slot_asof(pixels: DataFrame, width: int) -> DataFrame:
    """``prev_in_slot``: the latest earlier pixel of the image in the same hash slot, (0, 0, 0, 0) at first."""
    n = pixels.withColumn("pos", C.raster_order("y", "x", F.lit(width))).withColumn("slot", C.slot_hash("r", "g", "b", "a"))
    w = Window.partitionBy("image_id", "slot").orderBy("pos")
    packed = ((F.col("r") * 256 + F.col("g")).cast("long") * 256 + F.col("b")) * 256 + F.col("a")
    return n.withColumn("packed", packed).withColumn("prev_in_slot", F.lag("packed", 1, 0).over(w))


def op_profile(pixels: DataFrame, width: int) -> DataFrame:
    """The cheapest operation of every pixel: run, index, diff, luma, rgb or rgba."""
    n = _banded(slot_asof(pixels, width), width)
    n = _owned(n.withColumns({f"_{c}": F.lag(c, 1, 255 if c == "a" else 0).over(_raster()) for c in "rgba"}))
    signed = lambda c: F.pmod(F.col(c) - F.col(f"_{c}") + 128, F.lit(256)) - 128
    n = n.withColumns({"dr": signed("r"), "dg": signed("g"), "db": signed("b")})
    same = (F.col("dr") == 0) & (F.col("dg") == 0) & (F.col("db") == 0) & (F.col("a") == F.col("_a"))
    small = F.col("dr").between(-2, 1) & F.col("dg").between(-2, 1) & F.col("db").between(-2, 1)
    luma = F.col("dg").between(-32, 31) & (F.col("dr") - F.col("dg")).between(-8, 7) & (F.col("db") - F.col("dg")).between(-8, 7)
    op = (
        F.when(same, "run").when(F.col("prev_in_slot") == F.col("packed"), "index").when(F.col("a") != F.col("_a"), "rgba")
        .when(small, "diff").when(luma, "luma").otherwise("rgb")
    )
    return n.select("image_id", "y", "x", op.alias("op"))


def op_summary(profile: DataFrame) -> DataFrame:
    """Pixels by operation and an estimate of the coded bytes (a run is counted as a sixty-second of a byte)."""
    return profile.groupBy("op").agg(F.count(F.lit(1)).alias("pixels")).withColumn(
        "bytes", F.col("pixels") * F.when(F.col("op") == "run", 1 / 62).when(F.col("op").isin("index", "diff"), 1.0).when(F.col("op") == "luma", 2.0).when(F.col("op") == "rgb", 4.0).otherwise(5.0)
    )
