"""Session helpers: checkpoint folder, table readers and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent in local mode (single-machine tests) a temporary folder is made,
    handed to the context, so that ``DataFrame.checkpoint`` works too, and removed at exit. A cluster
    without the setting is an error: executors would not see each other's files.
    """
    sc = spark.sparkContext
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="pixelquarry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, and their size is known to later joins."""
    place = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers once per context, for functions run on executors.

    Batches for Python workers are bounded by bytes too, unless the session has a bound of its own:
    Spark's is 64 MB, held by the JVM and by the worker for each task; the JVM's allocator keeps what a batch
    has taken for each thread, and workers cut batches into smaller slices anyway.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(_BATCH_BYTES, "1m")
    if getattr(sc, "_pixelquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="pixelquarry-"), "pixelquarry.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._pixelquarry_shipped = True
