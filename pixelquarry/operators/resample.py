"""Upsampling of planes (image_id, y, x, v) by windows over rows and columns of bands.

A plane is dealt once by bands of rows with a row of halo on both sides; windows down the columns and along the rows
of a band need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.operators.bands import in_bands


def _at(value: Column | str, along: str, across: str, step: int) -> Column:
    """Neighbour along an axis; past the edge the pixel itself."""
    w = Window.partitionBy("image_id", "_band", across).orderBy(along)
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.lag(v, -step).over(w) if step < 0 else F.lead(v, step).over(w), v)


def _two(df: DataFrame, axis: str, low: Column, high: Column) -> DataFrame:
    """Two outputs for every input along an axis."""
    both = df.withColumn("_o", F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("v")), F.struct(F.lit(1).alias("k"), high.alias("v")))))
    return both.withColumn(axis, F.col(axis) * 2 + F.col("_o.k")).withColumn("v", F.col("_o.v")).select("image_id", "_band", "y", "x", "v")


def _vertical(plane: DataFrame) -> DataFrame:
    """Adds the samples above and below; at the edges the sample itself."""
    banded = in_bands(plane, above=True, below=True)
    return banded.withColumns({"_u": _at("v", "y", "x", -1), "_d": _at("v", "y", "x", 1)}).where("_own").drop("_own")


def upsample_h2(plane: DataFrame) -> DataFrame:
    """Twice as wide: (3 * near + neighbour + 2) >> 2, ends copied. The last pair leans on the last but one."""
    w = Window.partitionBy("image_id", "_band", "y").orderBy("x")
    p = in_bands(plane, above=False).withColumns({"_l": F.lag("v").over(w), "_r": F.lead("v").over(w)})
    near = lambda a, b: F.shiftright(a * 3 + b + 2, 2)
    v, left, right = F.col("v"), F.col("_l"), F.col("_r")
    # in the last pair the first output is of the last but one sample, the second a copy of the last
    low = F.when(left.isNull(), v).when(right.isNull(), near(left, v)).otherwise(near(v, left))
    high = F.when(right.isNull(), v).otherwise(near(v, right))
    return _two(p, "x", low, high).drop("_band")


def upsample_v2(plane: DataFrame) -> DataFrame:
    """Twice as high: (3 * near + far + 2) >> 2, edges lean on themselves."""
    p = _vertical(plane)
    near = lambda b: F.shiftright(F.col("v") * 3 + b + 2, 2)
    return _two(p, "y", near(F.col("_u")), near(F.col("_d"))).drop("_band")


def upsample_hv2(plane: DataFrame) -> DataFrame:
    """Twice both ways: t = 3 * near + far down the columns, then (t + 2) >> 2 at row ends and (3 t + t' + 8) >> 4 inside."""
    p = _vertical(plane)
    tall = _two(p, "y", F.col("v") * 3 + F.col("_u"), F.col("v") * 3 + F.col("_d"))
    w = Window.partitionBy("image_id", "_band", "y").orderBy("x")
    t = tall.withColumns({"_l": F.lag("v").over(w), "_r": F.lead("v").over(w)})
    end, inner = F.shiftright(F.col("v") + 2, 2), lambda b: F.shiftright(F.col("v") * 3 + b + 8, 4)
    return _two(t, "x", F.coalesce(inner(F.col("_l")), end), F.coalesce(inner(F.col("_r")), end)).drop("_band")


def upsample_nearest(plane: DataFrame, hs: int, vs: int) -> DataFrame:
    """Every sample repeated hs times across and vs times down."""
    p = plane.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(hs - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(vs - 1))))
    return p.select("image_id", (F.col("y") * vs + F.col("_j")).alias("y"), (F.col("x") * hs + F.col("_i")).alias("x"), "v")


def upsample(plane: DataFrame, hs: int, vs: int) -> DataFrame:
    """The kernel that fits the factors; nearest where there is none."""
    kernel = {(1, 1): lambda p: p.select("image_id", "y", "x", "v"), (1, 2): upsample_v2, (2, 1): upsample_h2, (2, 2): upsample_hv2}.get((hs, vs))
    return kernel(plane) if kernel else upsample_nearest(plane, hs, vs)


def upsample_center(plane: DataFrame) -> DataFrame:
    """Twice both ways, centred: (9 * mid + 3 * side + 3 * vertical + diagonal + 8) / 16, edges clamped."""
    p = _vertical(plane)
    p = p.withColumns({f"_{c}{k}": _at(c2, "x", "y", s) for c, c2 in (("m", "v"), ("u", "_u"), ("d", "_d")) for k, s in (("l", -1), ("r", 1))})
    out = lambda side, vert, diag: F.floor((F.col("v") * 9 + F.col(side) * 3 + F.col(vert) * 3 + F.col(diag) + 8) / 16).cast("int")
    four = [(0, 0, "_ml", "_u", "_ul"), (0, 1, "_mr", "_u", "_ur"), (1, 0, "_ml", "_d", "_dl"), (1, 1, "_mr", "_d", "_dr")]
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), out(s, v, d).alias("v")) for j, i, s, v, d in four]))
    return p.withColumn("_o", cells).select("image_id", (F.col("y") * 2 + F.col("_o.j")).alias("y"), (F.col("x") * 2 + F.col("_o.i")).alias("x"), F.col("_o.v").alias("v"))
