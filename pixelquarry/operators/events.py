"""Folds of viewer events: clamped positions, drags and mode cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelquarry.operators.placing import in_ranges
from pixelquarry.session import ship


# Clamped additions x -> min(high, max(low, x + shift)) are closed under composition: a run of events is one
# such map, so runs are folded where they lie and only their maps meet.

MAPS = "part long, run long, key string, shift long, low long, high long"


def _ordered(events: DataFrame, key: str, order: list[str], delta: str, lo: int, hi: int, goto: str | None) -> DataFrame:
    """Events in files of ranges of (key, order): key as text, and the clamped addition of each event."""
    ship(events.sparkSession)
    bounds = F.lit(lo).cast("long"), F.lit(hi).cast("long")
    fixed = F.lit(None).cast("long") if goto is None else F.when(F.col(goto).isNotNull(), F.least(bounds[1], F.greatest(bounds[0], F.col(goto).cast("long"))))
    step = F.coalesce(F.col(delta).cast("long"), F.lit(0).cast("long"))
    maps = {"shift": F.when(fixed.isNull(), step).otherwise(F.lit(0)), "low": F.coalesce(fixed, bounds[0]), "high": F.coalesce(fixed, bounds[1])}
    named = events.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate([key, *order])], *[v.cast("long").alias(k) for k, v in maps.items()])
    ranged = in_ranges(named, [f"_o{k}" for k in range(len(order) + 1)], "events")
    # a part is read by one task, in order
    text = F.coalesce(F.concat(F.lit("="), F.col("_o0").cast("string")), F.lit("")).alias("key")
    return ranged.select("*", text).repartition("part").sortWithinPartitions("part", "row")


def _maps(ordered: DataFrame) -> DataFrame:
    """(part, run, key, shift, low, high): the composed map of each key's events in each part; ``run`` counts a part's keys."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, held = None, 0, (0, 0, 0)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "shift", "low", "high")]
            done = []
            for part, key, a, low, high in zip(*columns, strict=True):
                if (part, key) != at:
                    if at is not None:
                        done.append((at[0], run, at[1], *held))
                    run = run + 1 if at is not None and at[0] == part else 0
                    at, held = (part, key), (a, low, high)
                else:
                    b, c, d = held
                    held = (a + b, min(high, max(low, c + a)), min(high, max(low, d + a)))
            if done:
                yield _maps_batch(done)
        if at is not None:
            yield _maps_batch([(at[0], run, at[1], *held)])

    return ordered.select("part", "key", "shift", "low", "high").mapInArrow(fold, MAPS)


def _maps_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "run", "key", "shift", "low", "high"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == "key" else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def _carried(start: Column, maps: Column) -> Column:
    """A position taken through maps in order."""
    return F.aggregate(maps, start, lambda p, m: F.least(m["high"], F.greatest(m["low"], p + m["shift"])))


#: What one line moves, and what a wheel's notch counts.
LINE, NOTCH = 20, 120


def position_steps(events: DataFrame, lo: int, hi: int, page: int) -> DataFrame:
    """Adds ``step`` and ``goto`` of scroll events by ``kind``: line and page (delta counts them, upwards negative), wheel (delta in
    notches, away from the user upwards, whole notches only), top, bottom, track (delta is the place); any other kind moves by delta.
    """
    kind, delta = F.col("kind"), F.col("delta").cast("long")
    notches = F.expr(f"cast(delta as bigint) div {NOTCH}")
    step = F.when(kind == "line", delta * LINE).when(kind == "page", delta * page).when(kind == "wheel", -notches * LINE).when(kind.isin("top", "bottom", "track"), 0).otherwise(delta)
    goto = F.when(kind == "top", lo).when(kind == "bottom", hi).when(kind == "track", delta)
    return events.withColumns({"step": step.cast("long"), "goto": goto.cast("long")})


def clamped_fold(events: DataFrame, key: str, order: list[str], delta: str, lo: int, hi: int, goto: str | None = None) -> DataFrame:
    """``pos`` after every event: min(hi, max(lo, pos + delta)) from lo on, in order; where ``goto`` is not null, its clamped value.

    Events lie in files of ranges, so a session may be spread over many. One pass composes the events of each
    session in each file to one map; a session that goes on in the next files takes its position from the maps of
    the files before, and a second pass steps from there. Linear, and no session is in one row or task. What
    reaches the driver is at most one position a file.
    """
    ordered = _ordered(events, key, order, delta, lo, hi, goto)
    maps = _maps(ordered)
    step = F.struct("part", "shift", "low", "high")
    spread = maps.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("maps")).where("size(maps) > 1")  # a map for each file at most
    going = spread.select(F.explode(F.sequence(F.lit(1), F.size("maps") - 1)).alias("k"), "maps")
    begin = F.lit(lo).cast("long")
    entered = going.select(F.get("maps", F.col("k"))["part"].alias("part"), _carried(begin, F.slice("maps", F.lit(1), F.col("k"))).alias("pos"))
    enters = {r.part: r.pos for r in entered.collect()}  # only the first session of a file can go on from another

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos = (None, None), lo
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "key", "shift", "low", "high")]
            out = []
            for part, name, a, low, high in zip(*columns, strict=True):
                if (part, name) != at:
                    pos = enters.get(part, lo) if part != at[0] else lo
                    at = (part, name)
                pos = min(high, max(low, pos + a))
                out.append(pos)
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.startswith("_o")], pa.array(out, pa.int64())], [*[n for n in batch.schema.names if n.startswith("_o")], "pos"])

    kept = [f for f in ordered.schema if f.name.startswith("_o")]
    stepped = ordered.mapInArrow(walk, T.StructType([*kept, T.StructField("pos", T.LongType())]))
    return stepped.select(*[F.col(f"_o{k}").alias(c) for k, c in enumerate([key, *order])], "pos")


def last_position(events: DataFrame, key: str, order: list[str], delta: str, lo: int, hi: int, goto: str | None = None) -> DataFrame:
    """The position after a session's last event, from the maps of its events in each file."""
    maps = _maps(_ordered(events, key, order, delta, lo, hi, goto))
    ended = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "shift", "low", "high"))).alias("maps"))
    kind = events.schema[key].dataType.simpleString()
    return ended.select(F.expr(f"case when key = '' then null else cast(substring(key, 2) as {kind}) end").alias(key), _carried(F.lit(lo).cast("long"), F.col("maps")).alias("pos"))


def drag_segments(events: DataFrame) -> DataFrame:
    """Net and path displacement of every drag: moves after a ``down`` up to the next ``down`` or ``up``."""
    w = Window.partitionBy("session_id").orderBy("seq")
    s = events.withColumn("drag", F.count_if(F.col("kind") == "down").over(w)).withColumn("ups", F.count_if(F.col("kind") == "up").over(w))
    s = s.withColumn("ups_at_down", F.last(F.when(F.col("kind") == "down", F.col("ups")), ignorenulls=True).over(w))
    s = s.where((F.col("drag") > 0) & (F.col("ups") == F.col("ups_at_down")) & F.col("kind").isin("down", "move"))
    d = Window.partitionBy("session_id", "drag").orderBy("seq")
    s = s.withColumns({"dx": F.lag("px").over(d) - F.col("px"), "dy": F.lag("py").over(d) - F.col("py")}).where("kind = 'move'")
    return s.groupBy("session_id", "drag").agg(
        F.count(F.lit(1)).alias("moves"), F.sum("dx").alias("net_x"), F.sum("dy").alias("net_y"), F.sum(F.abs("dx") + F.abs("dy")).alias("path")
    )


def mode_cycle(events: DataFrame, start: int = 1, modes: int = 5) -> DataFrame:
    """The mode after every press."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return events.where("kind = 'mode'").withColumn("mode", ((F.lit(start) + F.count(F.lit(1)).over(w)) % modes).cast("int")).select("session_id", "seq", "mode")
