"""Session settings, durable intermediate results and size-checked broadcasts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join key may hold a third of all rows; AQE then splits that key's partition over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

BROADCAST_ROWS = 200_000


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names; only a local session may fall back to its own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def durable(frame: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder and read it back, so later steps see the same rows even after executors are lost."""
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint(eager=True)


def durable_rows(frame: DataFrame) -> DataFrame:
    """Durable, and joined by shuffles. The planner guesses a checkpoint's size from the columnar file it began with; a frame with many rows of
    coordinates per feature is far larger, and a broadcast by that guess fills the driver."""
    return durable(frame).hint("merge")


def dealt(frame: DataFrame, key: str, by_cores: bool = False) -> DataFrame:
    """The rows dealt to all tasks by their key, before work that is heavy per row: a small file is read by one task, however many rows it holds.
    Small rows with very much work each are dealt by the number of cores, as their size alone would join them in a few tasks."""
    return frame.repartition(4 * frame.sparkSession.sparkContext.defaultParallelism, F.col(key)) if by_cores else frame.repartition(F.col(key))


def scratch_folder(spark: SparkSession) -> str:
    """A new name for files of this session, in the folder that the driver and every executor share."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def only_row(frame: DataFrame) -> Row:
    """The one row of an aggregate without groups. Its numbers then go into later plans as literals, which keeps those short."""
    return frame.first()


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting (at most `rows` + 1 rows); a larger frame stays a shuffled join under AQE.

    The count runs the frame's plan, so callers hand over frames that are durable or cheap.
    """
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame
