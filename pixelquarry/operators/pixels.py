"""Per-image aggregates, geometry and tiling of pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions import color as C
from pixelquarry.session import ship

# Origin and spacing of the seven interlace passes in x and y.
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
# First row and step of the four row passes.
GIF_ROWS = [(0, 8), (4, 8), (2, 4), (1, 2)]


def alpha_presence(pixels: DataFrame) -> DataFrame:
    """Images whose alpha is 0 throughout become opaque."""
    seen = F.bit_or("a").over(Window.partitionBy("image_id"))
    return pixels.withColumn("_seen", seen).withColumn("a", F.when(F.col("_seen") == 0, 255).otherwise(F.col("a"))).drop("_seen")


def channel_mask(packets: DataFrame) -> DataFrame:
    """Joint channel bits of an image's packets; bit 16 is alpha."""
    return packets.groupBy("image_id").agg(F.bit_or("channel").alias("mask")).withColumn("channels", F.when(F.col("mask").bitwiseAND(F.lit(16)) != 0, 4).otherwise(3))


def composite_channels(packets: DataFrame) -> DataFrame:
    """Channel values after packets in turn: each writes the channels of its mask, others stay 255."""
    w = Window.partitionBy("image_id").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = packets
    for name, bit in (("r", 128), ("g", 64), ("b", 32), ("a", 16)):
        written = F.when(F.col("channel").bitwiseAND(F.lit(bit)) != 0, F.col("value"))
        out = out.withColumn(name, F.coalesce(F.last(written, ignorenulls=True).over(w), F.lit(255)))
    return out


def assemble_scanlines(pixels: DataFrame) -> DataFrame:
    """Ordered channel arrays of every row."""
    g = pixels.groupBy("image_id", "frame", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", "a"))).alias("p"))
    return g.select("image_id", "frame", "y", *[F.col(f"p.{c}").alias(c) for c in "rgba"])


def touched_extent(draws: DataFrame, canvas: DataFrame | None = None) -> DataFrame:
    """Touched pixels and their bounds by frame; with ``canvas`` (image_id, w, h) whether they ``fit`` on it."""
    bounds = draws.groupBy("image_id", "frame").agg(
        F.count(F.lit(1)).alias("touched"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    if canvas is None:
        return bounds
    fit = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") < F.col("w")) & (F.col("y1") < F.col("h"))
    return bounds.join(canvas.select("image_id", "w", "h"), "image_id", "left").withColumn("fit", F.coalesce(fit, F.lit(False))).drop("w", "h")


def flip_vertical(pixels: DataFrame, height) -> DataFrame:
    return pixels.withColumn("y", C._c(height) - 1 - F.col("y"))


def crop_viewport(pixels: DataFrame, sx: int, sy: int, cw: int, ch: int) -> DataFrame:
    """Pixels inside the view, moved to its corner. The range filter reaches the scan."""
    inside = F.col("x").between(sx, sx + cw - 1) & F.col("y").between(sy, sy + ch - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - sx, "y": F.col("y") - sy})


def clamp_offset(offset, size, view) -> Column:
    return F.least(F.greatest(F.lit(0), C._c(offset)), F.greatest(F.lit(0), C._c(size) - C._c(view)))


def deinterlace_adam7(passes: DataFrame) -> DataFrame:
    """(pass 0..6, i, j) addresses to (x, y)."""
    at = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in ADAM7]), F.col("pass") + 1)
    return passes.withColumns({"x": F.col("i") * at(2) + at(0), "y": F.col("j") * at(3) + at(1)})


def deinterlace_gif_rows(rows: DataFrame, height: int) -> DataFrame:
    """Stored row numbers to image rows: the passes list their rows one after another."""
    order = [y for first, step in GIF_ROWS for y in range(first, height, step)]
    return rows.withColumn("y", F.element_at(F.array(*[F.lit(y) for y in order]), F.col("seq_row") + 1))


def swap_rb(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"r": F.col("b"), "b": F.col("r")})


def tile_pixels(pixels: DataFrame, bits: int) -> DataFrame:
    """Mean, least and greatest grey of tiles of 2^bits; edge tiles are smaller."""
    grey = C.luma8("r", "g", "b")
    return pixels.groupBy("image_id", F.shiftright("x", bits).alias("tx"), F.shiftright("y", bits).alias("ty")).agg(
        F.avg(grey).alias("mean"), F.min(grey).alias("low"), F.max(grey).alias("high"), F.count(F.lit(1)).alias("pixels")
    )


def tile_join(pixels: DataFrame, tiles: DataFrame, bits: int, width: int) -> DataFrame:
    """Attach the attribute of the tile that holds each pixel, by tile number."""
    across = (width + (1 << bits) - 1) >> bits
    tile = F.shiftright("y", bits) * across + F.shiftright("x", bits)
    return pixels.withColumn("tile", tile).join(tiles, ["image_id", "tile"])


def plane_dims(w, h) -> list[Column]:
    """Chroma plane size: half, rounded up."""
    return [F.floor((C._c(v) + 1) / 2).cast("int") for v in (w, h)]


def component_dims(w, h, factors: tuple[int, int], highest: tuple[int, int]) -> list[Column]:
    """Plane size of a component with sampling factors (across, down), the highest of its image given: w * h_i / h_max, rounded up."""
    return [F.floor((C._c(v) * f + most - 1) / most).cast("int") for v, f, most in zip((w, h), factors, highest, strict=True)]


def explode_raster(rasters: DataFrame) -> DataFrame:
    """Uncompressed payloads to pixel rows, addressed by columns w, h, bpp, data_off, stride and bottom_up.

    Rows are exploded before columns, so that one large image spreads over tasks by bands of rows.
    """
    rows = rasters.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    start = F.col("data_off") + F.when(F.col("bottom_up"), F.col("h") - 1 - F.col("y")).otherwise(F.col("y")) * F.col("stride")
    line = rows.select("file_id", "y", "w", "bpp", F.hex(F.col("content").substr((start + 1).cast("int"), F.col("stride").cast("int"))).alias("hx"))
    cells = line.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    byte = lambda k: F.conv(F.col("hx").substr((F.col("x") * F.col("bpp") / 4).cast("int") + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return cells.select("file_id", "y", "x", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def explode_packed_raster(rasters: DataFrame, bits: int) -> DataFrame:
    """1, 2, 4 or 8-bit samples, high bits first, rows padded to the stride; the last row first where ``bottom_up``."""
    rows = rasters.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    line = F.when(F.col("bottom_up"), F.col("h") - 1 - F.col("y")).otherwise(F.col("y"))
    start = F.col("data_off") + line * F.col("stride")
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("_at", start + F.floor(F.col("x") * bits / 8))
    byte = F.conv(F.hex(F.col("content").substr((F.col("_at") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shift = F.lit(8 - bits) - (F.col("x") * bits) % 8
    return cells.select("file_id", "y", "x", F.call_function("shiftright", byte, shift.cast("int")).bitwiseAND(F.lit((1 << bits) - 1)).alias("idx"))


SAMPLES = "file_id long, y int, x int, r int, g int, b int, a int"
#: Rows of pixels that are given to Python together.
_ROWS = 64


def explode_samples(rasters: DataFrame) -> DataFrame:
    """(file_id, y, x, r, g, b, a) of uncompressed payloads of any layout.

    The layout is in columns: w, h, data_off, stride (bytes of a stored row), bottom_up, ``channels`` (their order, as ``rgb``,
    ``bgra`` or ``g``), ``planar`` (one plane after the other, else interleaved) and ``wide`` (16-bit samples, high byte first).
    A grey sample is all three colours; without alpha a is the highest value. Bands of rows are cut out of the payload first, so that one
    large image spreads over tasks; a band becomes arrays as strided views of its bytes. A payload that is cut short gives
    the rows that are whole.
    """
    ship(rasters.sparkSession)
    first = F.explode(F.expr(f"sequence(0, h - 1, {_ROWS})"))
    bands = rasters.where("w > 0 and h > 0").withColumn("y", first)
    n = F.least(F.lit(_ROWS), F.col("h") - F.col("y"))
    line = F.when(F.col("bottom_up"), F.col("h") - F.col("y") - n).otherwise(F.col("y"))
    planes = F.when(F.col("planar"), F.length("channels")).otherwise(1)

    def cut(k: Column) -> Column:
        start = F.col("data_off") + (k * F.col("h") + line) * F.col("stride")
        return F.substring(F.col("content"), (start + 1).cast("int"), (n * F.col("stride")).cast("int"))

    dealt = bands.select(
        F.col("file_id").cast("long").alias("file_id"), F.col("y").cast("int").alias("y"), n.cast("int").alias("n"), F.col("w").cast("int").alias("w"), F.col("stride").cast("int").alias("stride"),
        "bottom_up", "channels", "planar", "wide", F.transform(F.sequence(F.lit(0), planes - 1), cut).alias("parts"),
    ).repartition("file_id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _band(**r)

    return dealt.mapInArrow(run, SAMPLES)


def _band(file_id: int, y: int, n: int, w: int, stride: int, bottom_up: bool, channels: str, planar: bool, wide: bool, parts: list[bytes]) -> pa.RecordBatch:
    """The pixels of a band of rows."""
    kind = np.dtype(">u2" if wide else "u1")
    each = 1 if planar else len(channels)
    stored = min(len(p) // stride for p in parts)
    rows = [np.ndarray((stored, w, each), kind, p, strides=(stride, each * kind.itemsize, kind.itemsize)) for p in parts]
    planes = dict(zip(channels, (p[:, :, 0] for p in rows) if planar else np.moveaxis(rows[0], 2, 0), strict=True))
    numbers = np.arange(y, y + n)[::-1] if bottom_up else np.arange(y, y + n)
    numbers = numbers[:stored]
    opaque = np.full((stored, w), 65535 if wide else 255)
    colours = [planes.get(c, planes.get("g")) if c in "rgb" else planes.get("a", opaque) for c in "rgba"]
    columns = [np.full(stored * w, file_id), np.repeat(numbers, w).astype(np.int32), np.tile(np.arange(w, dtype=np.int32), stored), *(c.astype(np.int32).reshape(-1) for c in colours)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file_id", "y", "x", "r", "g", "b", "a"])


def pack_bmp(pixels: DataFrame) -> DataFrame:
    """One 24-bit bitmap file per image and frame: headers, rows bottom-up, blue first, rows padded with zeros."""
    two = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")

    def le(v: Column, width: int) -> Column:
        h = F.lpad(F.hex(v.cast("long")), 2 * width, "0")
        return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))])

    lines = pixels.groupBy("image_id", "frame", "y").agg(
        F.count(F.lit(1)).alias("w"), F.array_sort(F.collect_list(F.struct("x", F.concat(two("b"), two("g"), two("r")).alias("v")))).alias("p")
    )
    body = F.array_join(F.transform("p", lambda s: s["v"]), "")
    stride = (F.floor((F.col("w") * 24 + 31) / 32) * 4).cast("int")
    padded = lines.withColumn("line", body).withColumn("stride", stride)
    images = padded.groupBy("image_id", "frame").agg(
        F.max("w").alias("w"), F.count(F.lit(1)).alias("h"), F.max("stride").alias("stride"), F.sort_array(F.collect_list(F.struct("y", "line")), asc=False).alias("rows")
    )
    size = F.col("stride") * F.col("h")
    head = F.concat(
        F.lit("424D"), le(size + 54, 4), F.lit("00000000"), le(F.lit(54), 4), le(F.lit(40), 4), le(F.col("w"), 4), le(F.col("h"), 4),
        le(F.lit(1), 2), le(F.lit(24), 2), F.lit("00000000"), le(size, 4), F.lit("0" * 32),
    )
    return images.select("image_id", "frame", F.unhex(F.concat(head, F.array_join(F.transform("rows", lambda s: F.rpad(s["line"], 2 * F.col("stride"), F.lit("0"))), ""))).alias("bmp"))
