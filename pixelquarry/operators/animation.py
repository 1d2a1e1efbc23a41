"""Frame timelines and compositing by carrying pixels forward."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.session import settled

#: About so many places of frames are sorted by one task, however many there are.
TASK_ROWS = 250_000
#: Colours of at most so many images are broadcast; more are joined by a shuffle, without a sort of the canvas.
BROADCAST_ROWS = 200_000


def frame_timeline(frames: DataFrame) -> DataFrame:
    """Start and end of every frame and the image's duration, in milliseconds."""
    w = Window.partitionBy("image_id").orderBy("frame")
    return frames.withColumn("end_ms", F.sum("delay_ms").over(w)).withColumn("start_ms", F.col("end_ms") - F.col("delay_ms")).withColumn(
        "duration_ms", F.sum("delay_ms").over(Window.partitionBy("image_id"))
    )


def carry_controls(frames: DataFrame) -> DataFrame:
    """Frames without controls of their own take the last ones given."""
    w = Window.partitionBy("image_id").orderBy("frame")
    return frames.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) for c in ("dispose", "delay_ms")})


def composite_frames(draws: DataFrame, frames: DataFrame) -> DataFrame:
    """Canvas value of every frame at every touched place; null is transparent.

    It is the frame's own opaque draw (alpha above 128), else the last opaque draw of an earlier
    frame that is kept (dispose 0 or 1). Only places drawn at some time are listed.
    """
    places = settled(draws.select("image_id", "y", "x").distinct(), "places")
    moments = frames.select("image_id", "frame", "dispose")
    sizes = places.groupBy("image_id").agg(F.count(F.lit(1)).alias("p")).join(moments.groupBy("image_id").agg(F.count(F.lit(1)).alias("f")), "image_id")
    rows = sizes.agg(F.sum(F.col("p") * F.col("f"))).first()[0] or 0
    own = F.struct("r", "g", "b", "a")
    drawn = draws.where("a > 128 and y is not null and x is not null").select("image_id", "y", "x", "frame", F.lit(0).alias("kind"), own.alias("own"))
    grid = places.join(moments, "image_id").withColumn("kind", F.lit(1))
    # draws stand before the frame that they are of; one sort of both in place of a join and a sort
    steps = grid.unionByName(drawn, allowMissingColumns=True).repartition(math.ceil(rows / TASK_ROWS) + 1, "image_id", "y", "x")
    w = Window.partitionBy("image_id", "y", "x").orderBy("frame", "kind")
    latest = F.last(F.when(F.col("kind") == 0, F.struct("frame", "own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = steps.withColumn("_l", latest).where("kind = 1").withColumn("_o", F.when(F.col("_l.frame") == F.col("frame"), F.col("_l.own")))
    kept = F.when(F.col("dispose") <= 1, F.col("_o"))
    value = F.coalesce("_o", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return full.withColumn("_v", value).select("image_id", "frame", "y", "x", *[F.col(f"_v.{c}").alias(c) for c in "rgba"])


def background_fill(canvas: DataFrame, frames: DataFrame, colors: DataFrame) -> DataFrame:
    """Under every draw, images with a background index above 0 have that colour; others stay transparent.

    ``colors`` is (image_id, bgindex, r, g, b): the colour of each image's background index; an index without one stays transparent.
    """
    filled = frames.groupBy("image_id").agg(F.min_by("bgindex", "frame").alias("bgindex")).where("bgindex > 0")
    known = filled.join(colors, ["image_id", "bgindex"]).select("image_id", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    bare = F.col("a").isNull() & F.col("_r").isNotNull()
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = canvas.join(known.hint("broadcast" if small else "shuffle_hash"), "image_id", "left")
    return out.withColumns({**{c: F.when(bare, F.col(f"_{c}")).otherwise(F.col(c)) for c in "rgb"}, "a": F.when(bare, 255).otherwise(F.col("a"))}).drop("_r", "_g", "_b")
