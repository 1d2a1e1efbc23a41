"""Palettes, nearest colours, lookup cubes and quantisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.functions import color as C

# The sixteen standard colours, by index.
VGA16 = [
    (0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128), (192, 192, 192),
    (128, 128, 128), (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255),
]
# The 256-entry palette, by index.
WIN256 = [
    (0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128), (192, 192, 192),
    (192, 220, 192), (166, 202, 240), (42, 63, 170), (42, 63, 255), (42, 95, 0), (42, 95, 85), (42, 95, 170), (42, 95, 255),
    (42, 127, 0), (42, 127, 85), (42, 127, 170), (42, 127, 255), (42, 159, 0), (42, 159, 85), (42, 159, 170), (42, 159, 255),
    (42, 191, 0), (42, 191, 85), (42, 191, 170), (42, 191, 255), (42, 223, 0), (42, 223, 85), (42, 223, 170), (42, 223, 255),
    (42, 255, 0), (42, 255, 85), (42, 255, 170), (42, 255, 255), (85, 0, 0), (85, 0, 85), (85, 0, 170), (85, 0, 255),
    (85, 31, 0), (85, 31, 85), (85, 31, 170), (85, 31, 255), (85, 63, 0), (85, 63, 85), (85, 63, 170), (85, 63, 255),
    (85, 95, 0), (85, 95, 85), (85, 95, 170), (85, 95, 255), (85, 127, 0), (85, 127, 85), (85, 127, 170), (85, 127, 255),
    (85, 159, 0), (85, 159, 85), (85, 159, 170), (85, 159, 255), (85, 191, 0), (85, 191, 85), (85, 191, 170), (85, 191, 255),
    (85, 223, 0), (85, 223, 85), (85, 223, 170), (85, 223, 255), (85, 255, 0), (85, 255, 85), (85, 255, 170), (85, 255, 255),
    (127, 0, 0), (127, 0, 85), (127, 0, 170), (127, 0, 255), (127, 31, 0), (127, 31, 85), (127, 31, 170), (127, 31, 255),
    (127, 63, 0), (127, 63, 85), (127, 63, 170), (127, 63, 255), (127, 95, 0), (127, 95, 85), (127, 95, 170), (127, 95, 255),
    (127, 127, 0), (127, 127, 85), (127, 127, 170), (127, 127, 255), (127, 159, 0), (127, 159, 85), (127, 159, 170), (127, 159, 255),
    (127, 191, 0), (127, 191, 85), (127, 191, 170), (127, 191, 255), (127, 223, 0), (127, 223, 85), (127, 223, 170), (127, 223, 255),
    (127, 255, 0), (127, 255, 85), (127, 255, 170), (127, 255, 255), (170, 0, 0), (170, 0, 85), (170, 0, 170), (170, 0, 255),
    (170, 31, 0), (170, 31, 85), (170, 31, 170), (170, 31, 255), (170, 63, 0), (170, 63, 85), (170, 63, 170), (170, 63, 255),
    (170, 95, 0), (170, 95, 85), (170, 95, 170), (170, 95, 255), (170, 127, 0), (170, 127, 85), (170, 127, 170), (170, 127, 255),
    (170, 159, 0), (170, 159, 85), (170, 159, 170), (170, 159, 255), (170, 191, 0), (170, 191, 85), (170, 191, 170), (170, 191, 255),
    (170, 223, 0), (170, 223, 85), (170, 223, 170), (170, 223, 255), (170, 255, 0), (170, 255, 85), (170, 255, 170), (170, 255, 255),
    (212, 0, 0), (212, 0, 85), (212, 0, 170), (212, 0, 255), (212, 31, 0), (212, 31, 85), (212, 31, 170), (212, 31, 255),
    (212, 63, 0), (212, 63, 85), (212, 63, 170), (212, 63, 255), (212, 95, 0), (212, 95, 85), (212, 95, 170), (212, 95, 255),
    (212, 127, 0), (212, 127, 85), (212, 127, 170), (212, 127, 255), (212, 159, 0), (212, 159, 85), (212, 159, 170), (212, 159, 255),
    (212, 191, 0), (212, 191, 85), (212, 191, 170), (212, 191, 255), (212, 223, 0), (212, 223, 85), (212, 223, 170), (212, 223, 255),
    (212, 255, 0), (212, 255, 85), (212, 255, 170), (212, 255, 255), (255, 0, 85), (255, 0, 170), (255, 31, 0), (255, 31, 85),
    (255, 31, 170), (255, 31, 255), (255, 63, 0), (255, 63, 85), (255, 63, 170), (255, 63, 255), (255, 95, 0), (255, 95, 85),
    (255, 95, 170), (255, 95, 255), (255, 127, 0), (255, 127, 85), (255, 127, 170), (255, 127, 255), (255, 159, 0), (255, 159, 85),
    (255, 159, 170), (255, 159, 255), (255, 191, 0), (255, 191, 85), (255, 191, 170), (255, 191, 255), (255, 223, 0), (255, 223, 85),
    (255, 223, 170), (255, 223, 255), (255, 255, 85), (255, 255, 170), (204, 204, 255), (255, 204, 255), (51, 255, 255), (102, 255, 255),
    (153, 255, 255), (204, 255, 255), (0, 127, 0), (0, 127, 85), (0, 127, 170), (0, 127, 255), (0, 159, 0), (0, 159, 85),
    (0, 159, 170), (0, 159, 255), (0, 191, 0), (0, 191, 85), (0, 191, 170), (0, 191, 255), (0, 223, 0), (0, 223, 85),
    (0, 223, 170), (0, 223, 255), (0, 255, 85), (0, 255, 170), (214, 0, 147), (119, 119, 119), (134, 134, 134), (150, 150, 150),
    (178, 178, 178), (165, 0, 33), (42, 31, 170), (42, 31, 255), (255, 124, 128), (42, 63, 85), (255, 251, 240), (58, 110, 165),
    (128, 128, 128), (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255),
]
SKIPPED = 246
#: Most colours that a nearest search is broadcast for; a palette has at most 256.
_SCHEMA = "palette_id string, idx int, r int, g int, b int"


# The sixteen colours of the Color Graphics Adapter.
CGA16 = [
    (0, 0, 0), (0, 0, 170), (0, 170, 0), (0, 170, 170), (170, 0, 0), (170, 0, 170), (170, 85, 0), (170, 170, 170),
    (85, 85, 85), (85, 85, 255), (85, 255, 85), (85, 255, 255), (255, 85, 85), (255, 85, 255), (255, 255, 85), (255, 255, 255),
]
PALETTES = {"vga16": VGA16, "win256": WIN256, "cga16": CGA16}


def palette(spark: SparkSession, palette_id: str) -> DataFrame:
    """(palette_id, idx, r, g, b) of a built-in palette."""
    return spark.createDataFrame([(palette_id, i, *c) for i, c in enumerate(PALETTES[palette_id])], _SCHEMA)


def palette_lookup(pixels: DataFrame, colors: DataFrame, on_missing: str = "zero") -> DataFrame:
    """Replace ``idx`` by its colour. Out of range: entry 0, transparent black, or null (``strict``).

    Entries are opaque unless the palette has a column ``a``.
    """
    cols = ["r", "g", "b"]
    alpha = F.col("a") if "a" in colors.columns else F.lit(255)
    known = F.broadcast(colors.select("idx", *cols, alpha.alias("_own")))  # one palette: at most 256 rows
    out = pixels.drop(*cols, "a").join(known, "idx", "left").withColumn("a", F.col("_own")).drop("_own")
    if on_missing == "transparent":
        return out.fillna(0, [*cols, "a"])
    if on_missing == "zero":
        zero = colors.where("idx = 0").select(*cols, alpha.alias("a")).agg(*[F.first(c).alias(f"_{c}") for c in (*cols, "a")])
        out = out.join(F.broadcast(zero), F.lit(True), "left")
        return out.select(*[c for c in out.columns if c not in (*cols, "a") and c[0] != "_"], *[F.coalesce(c, f"_{c}").alias(c) for c in (*cols, "a")])
    return out


def nearest_palette_color(colors: DataFrame, entries: list[tuple[int, int, int]], skip: int = SKIPPED) -> DataFrame:
    """Adds ``idx`` of the least weighted distance; lowest index on ties; entry ``skip`` is never chosen.

    The palette, at most 256 entries, is a literal in the expression: no join at all.
    """
    ranked = [C.color_distance(["r", "g", "b"], list(c)) * 256 + i for i, c in enumerate(entries) if i != skip]
    least = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    return colors.withColumn("idx", (least % 256).cast("int"))


def build_color_lut(spark: SparkSession, palette_id: str) -> DataFrame:
    """(kr, kg, kb, idx): nearest entry of the key colour of each of the 32768 five-bit cells."""
    entries = F.broadcast(palette(spark, palette_id).where(F.col("idx") != SKIPPED).select(F.col("idx"), F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb")))
    cells = spark.range(32768).select(*[F.shiftright("id", s).bitwiseAND(F.lit(31)).cast("int").alias(k) for k, s in (("kr", 10), ("kg", 5), ("kb", 0))])
    far = C.color_distance([F.col("kr") * 8, F.col("kg") * 8, F.col("kb") * 8], ["pr", "pg", "pb"])
    # 32768 cells by at most 256 entries, whatever the data
    return cells.join(entries, F.lit(True)).groupBy("kr", "kg", "kb").agg(F.min(far * 256 + F.col("idx")).alias("best")).select("kr", "kg", "kb", (F.col("best") % 256).cast("int").alias("idx"))


def quantize_lut(pixels: DataFrame, palette_id: str) -> DataFrame:
    """Palette index and colour of every pixel through the lookup cube; fixed-size tables are broadcast."""
    spark = pixels.sparkSession
    lut = F.broadcast(build_color_lut(spark, palette_id))  # 32768 rows
    entries = F.broadcast(palette(spark, palette_id).select("idx", F.col("r").alias("qr"), F.col("g").alias("qg"), F.col("b").alias("qb")))
    keyed = pixels.withColumns({k: C.bucket5(C.clamp_byte(c)) for k, c in (("kr", "r"), ("kg", "g"), ("kb", "b"))})
    return keyed.join(lut, ["kr", "kg", "kb"]).join(entries, "idx").drop("kr", "kg", "kb")


def quantization_error(quantized: DataFrame) -> DataFrame:
    """Sum and mean of original less palette colour by image, in sixteenths."""
    gap = {c: (F.col(c) - F.col(f"q{c}")) * 16 for c in "rgb"}
    return quantized.groupBy("image_id").agg(*[f(gap[c]).alias(f"{n}_{c}") for c in "rgb" for n, f in (("sum", F.sum), ("avg", F.avg))])


def palette_usage(quantized: DataFrame) -> DataFrame:
    """Pixels by image and palette index."""
    return quantized.groupBy("image_id", "idx").agg(F.count(F.lit(1)).alias("pixels"))


def distinct_colors(pixels: DataFrame, approx: bool = False) -> DataFrame:
    """Colours by image and the bits of a packed index: 8 above 16 colours, 4 above 4, 2 above 2, else 1."""
    key = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    n = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return pixels.groupBy("image_id").agg(n.alias("colors")).withColumn("bits", F.when(F.col("colors") > 16, 8).when(F.col("colors") > 4, 4).when(F.col("colors") > 2, 2).otherwise(1))


def color_bucket_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*[C.bucket5(c).alias(f"k{c}") for c in "rgb"]).agg(F.count(F.lit(1)).alias("pixels"))


def first_keys(colors: DataFrame) -> DataFrame:
    """One colour per (image_id, key): the one declared first."""
    w = Window.partitionBy("image_id", "key").orderBy("pos")
    return colors.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pos")


def xpm_key_join(cells: DataFrame, colors: DataFrame) -> DataFrame:
    """Colour of each cell by its key, null where no colour has the key."""
    return cells.join(first_keys(colors), ["image_id", "key"], "left")


def unmatched_keys(cells: DataFrame, colors: DataFrame) -> DataFrame:
    return cells.join(colors.select("image_id", "key").distinct(), ["image_id", "key"], "left_anti")


def cga_index(idx, background, flags):
    """Index into the sixteen colours of a 2-bit image: 0 is the background, others a step of two. The header's bytes are numbers or columns."""
    col = lambda v: F.lit(v) if isinstance(v, int) else C._c(v)
    p, i = (F.shiftright(col(flags), k).bitwiseAND(F.lit(1)) for k in (6, 5))
    c = C._c(idx)
    return F.when(c == 0, F.shiftright(col(background), 4)).otherwise(c * 2 + p + i * 8).cast("int")


def cga_lookup(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """2-bit pixels (image_id, y, x, idx) in colours, by their image's header bytes (image_id, background, flags)."""
    named = pixels.join(headers.select("image_id", "background", "flags"), "image_id").withColumn("idx", cga_index("idx", "background", "flags")).drop("background", "flags")
    return palette_lookup(named, palette(pixels.sparkSession, "cga16"))
