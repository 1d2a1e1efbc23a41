"""Streams: a catalogue of arriving files, and positions of viewer sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pixelquarry.operators import catalogue
from pixelquarry.operators.events import position_steps
from pixelquarry.session import ship
from pixelquarry.sources.images import EXTENSIONS, stream_image_files


def catalogue_rows(files: DataFrame) -> DataFrame:
    """Route, format, header, size check and reason of files, without their content."""
    sized = catalogue.size_guard(catalogue.validate_header(catalogue.probe_header(catalogue.sniff_format(catalogue.route_by_extension(files)))))
    return sized.withColumn("reason", F.coalesce("reason", "size_reason")).drop("content", "size_reason")


def stream_catalogue(spark: SparkSession, path: str, out: str, checkpoint: str, exts=EXTENSIONS) -> StreamingQuery:
    """Headers of arriving files go to ``out/headers``, failures to ``out/quarantine``; each file exactly once.

    A batch overwrites the folder of its own number, so a repeated batch leaves no second copy.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = catalogue_rows(batch).persist()
        good, bad = catalogue.quarantine_split(rows)
        good.write.mode("overwrite").parquet(f"{out}/headers/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        rows.unpersist()

    return stream_image_files(spark, path, exts).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POSITION = "session_id long, seq long, pos long"
#: The state store that keeps typed states with timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Positions(StatefulProcessor):
    """One value of state a session, its position; a timer forgets sessions that are idle."""

    def __init__(self, lo: int, hi: int, idle_ms: int):
        self.lo, self.hi, self.idle_ms = lo, hi, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pos = handle, handle.getValueState("pos", "pos long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        pos = self.pos.get()[0] if self.pos.exists() else self.lo
        pdf, out = pd.concat(list(rows)).sort_values("seq"), []
        for step, goto in zip(pdf["step"], pdf["goto"], strict=True):
            pos = min(self.hi, max(self.lo, int(goto) if not pd.isna(goto) else pos + int(step)))
            out.append(pos)
        self.pos.update((pos,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"session_id": key[0], "seq": pdf["seq"].astype("int64").to_numpy(), "pos": out})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.pos.clear()
        yield pd.DataFrame({"session_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "pos": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def stream_position(events: DataFrame, lo: int = 0, hi: int = 100, page: int = 10, idle: str = "1 hour") -> DataFrame:
    """The clamped position after every event (session_id, seq, kind, delta) of each session; idle sessions are forgotten.

    Kinds are those of ``events.position_steps``. The session's state store becomes ``STATE_STORE``, which typed states need;
    ``clamped_fold`` over the same steps is the batch form.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = Positions(lo, hi, int(pd.Timedelta(idle).total_seconds() * 1000))
    steps = position_steps(events, lo, hi, page).select("session_id", "seq", "step", "goto")
    return steps.groupBy("session_id").transformWithStateInPandas(processor, POSITION, "Append", "ProcessingTime")
