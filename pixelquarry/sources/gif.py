"""GIF files as tables: frames with their controls, and colour tables as a keyed dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions.color import byte_at, le_int


def gif_frames(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, frame, x, y, w, h, delay_ms, dispose, clear, interlaced, palette_id, bgindex, offset) of every image block.

    ``chunks`` is ``list_chunks(files)``: the fields are in the blocks' first bytes. A control block holds for the next
    image; ``clear`` is its transparent index, null if it has none. ``palette_id`` is 0 for the file's colour table, the
    frame's number plus 1 for a table of its own, and null where there is neither.
    """
    gif = chunks.where("container = 'gif' and type in ('21', '2C')")
    w = Window.partitionBy("file_id").orderBy("chunk_no")
    image, control = F.col("type") == "2C", (F.col("type") == "21") & (byte_at("head", 1) == 0xF9)
    numbered = gif.withColumn("frame", F.count_if(image).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.last(F.when(control, F.col("head")), ignorenulls=True).over(Window.partitionBy("file_id", "frame").orderBy("chunk_no"))
    frames = numbered.withColumn("control", own).where(image)
    screen = files.select("file_id", byte_at("content", 10).alias("screen_flags"), byte_at("content", 11).alias("bgindex"))
    flags, held = byte_at("head", 9), byte_at("control", 3)
    both = frames.join(screen, "file_id")
    table = F.when(flags.bitwiseAND(F.lit(0x80)) != 0, F.col("frame") + 1).when(F.col("screen_flags").bitwiseAND(F.lit(0x80)) != 0, 0)
    return both.select(
        "file_id", F.col("frame").cast("int").alias("frame"), *[le_int("head", at, 2).cast("int").alias(c) for c, at in (("x", 1), ("y", 3), ("w", 5), ("h", 7))],
        F.coalesce(le_int("control", 4, 2) * 10, F.lit(0)).cast("int").alias("delay_ms"), F.coalesce(F.shiftright(held, 2).bitwiseAND(F.lit(7)), F.lit(0)).cast("int").alias("dispose"),
        F.when(held.bitwiseAND(F.lit(1)) != 0, byte_at("control", 6)).cast("int").alias("clear"), (flags.bitwiseAND(F.lit(0x40)) != 0).alias("interlaced"),
        table.cast("int").alias("palette_id"), F.col("bgindex").cast("int").alias("bgindex"), "offset",
    )


def _entries(tables: DataFrame) -> DataFrame:
    """(file_id, palette_id, idx, r, g, b) of (file_id, palette_id, flags, at, content)."""
    n = F.expr("shiftleft(2, cast(flags & 7 as int))")
    cut = tables.where(F.col("flags").bitwiseAND(F.lit(0x80)) != 0).select("file_id", "palette_id", F.substring(F.col("content"), (F.col("at") + 1).cast("int"), n * 3).alias("table"))
    rows = cut.select("file_id", "palette_id", "table", F.explode(F.expr("sequence(0, octet_length(table) div 3 - 1)")).alias("idx")).where("idx >= 0")
    return rows.select("file_id", "palette_id", F.col("idx").cast("int").alias("idx"), *[byte_at("table", F.col("idx") * 3 + k).cast("int").alias(c) for k, c in enumerate("rgb")])


def gif_palettes(files: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_id, palette_id, idx, r, g, b): the colour tables of the files and of their frames."""
    shared = files.select("file_id", F.lit(0).alias("palette_id"), byte_at("content", 10).alias("flags"), F.lit(13).cast("long").alias("at"), "content").where(F.expr("substring(content, 1, 3)") == F.lit(b"GIF"))
    own = frames.where("palette_id > 0").select("file_id", "palette_id", "offset").join(files.select("file_id", "content"), "file_id")
    local = own.select("file_id", "palette_id", byte_at("content", F.col("offset") + 9).alias("flags"), (F.col("offset") + 10).alias("at"), "content")
    return _entries(shared).unionByName(_entries(local))


def frame_colors(frames: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, frame, idx, r, g, b, a): each frame's colours; the transparent index has alpha 0."""
    a = F.when(F.col("idx") == F.col("clear"), 0).otherwise(255)
    joined = frames.select("file_id", "frame", "palette_id", "clear").join(palettes, ["file_id", "palette_id"])
    return joined.select(F.col("file_id").alias("image_id"), "frame", "idx", "r", "g", "b", a.alias("a"))


def draw_frames(indexes: DataFrame, colors: DataFrame) -> DataFrame:
    """(image_id, frame, y, x, r, g, b, a) of decoded indexes (image_id, frame, y, x, idx) under each frame's colours; unknown indexes are not drawn."""
    return indexes.join(colors, ["image_id", "frame", "idx"]).select("image_id", "frame", "y", "x", "r", "g", "b", "a")


def backgrounds(frames: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, bgindex, r, g, b): the colour of each file's background index in its own table."""
    asked = frames.select("file_id", "bgindex").distinct().withColumn("palette_id", F.lit(0))
    found = asked.join(palettes.withColumnRenamed("idx", "bgindex"), ["file_id", "palette_id", "bgindex"])
    return found.select(F.col("file_id").alias("image_id"), "bgindex", "r", "g", "b")
