"""What the operators of this subpackage share: table reads, written intermediates and key hashes."""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    made = tempfile.mkdtemp(prefix="written-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(frame: DataFrame, block: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: short lineage, column pruning, sizes known, safe when executors are lost.
    Tasks hold a block of rows before they write it, 128 MB by default; for large values `block` can name fewer bytes."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    (frame.write if block is None else frame.write.option("parquet.block.size", block)).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A key that repeated rows share and that spreads rows without an id by their content."""
    return F.xxhash64(*columns)


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value's text, modulo; NULL counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def best(frame: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest score per group, ties to the smaller `tie`, with `rank` from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_ranked(frame: DataFrame, group: str, order: list[Column], k: int, parts: int = 64) -> DataFrame:
    """The first k rows per group with `rank` (long) from 1. A large group is first cut to k rows in each of its parts."""
    part = F.pmod(F.xxhash64(*frame.columns), F.lit(parts))
    near = frame.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))).where(F.col("rank") <= k).drop("__part", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle Python workers beside the next stage, and they should be small."""
    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def released(function):
    """A function over an iterator of batches that gives its memory back when the last one is done."""
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()
    return run
