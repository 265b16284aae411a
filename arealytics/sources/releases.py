"""Releases: all tables of a run become readable together, or none does; logs that a repeated run does not double.

A run writes its tables under its own id and then moves one pointer, a file with that id, over the old one. A rename over an existing file is one
step of the file system, so a reader finds the old release or the new one, and a run that fails on the way leaves the old one as it was.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "current"


def _place(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run) or run.strip(".") == "":
        raise ValueError(f"a run id is made of letters, digits, '.', '_' and '-': {run!r}")
    return f"run={run}"


def _files(spark: SparkSession, path: str):
    """The Hadoop file context for a path, and its path object."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    return context, at


def _point(spark: SparkSession, folder: str, run: str) -> None:
    jvm = spark._jvm
    context, fresh = _files(spark, f"{folder}/.{POINTER}-{run}")
    create, overwrite = (jvm.org.apache.hadoop.fs.CreateFlag.valueOf(n) for n in ("CREATE", "OVERWRITE"))
    out = context.create(fresh, jvm.java.util.EnumSet.of(create, overwrite), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    try:
        out.write(run.encode())
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), rename)


def current_run(spark: SparkSession, folder: str) -> str | None:
    """The id of the release that readers see."""
    context, at = _files(spark, f"{folder.rstrip('/')}/{POINTER}")
    if not context.util().exists(at):
        return None
    return spark.read.text(f"{folder.rstrip('/')}/{POINTER}").first()["value"]


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """Write all tables under the run's id, then make them the release. A repeated run replaces its own files only."""
    folder = folder.rstrip("/")
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{_place(run)}/{name}")
    _point(spark, folder, run)


def read_release(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the current release, None if there is no release."""
    run = current_run(spark, folder)
    return None if run is None else spark.read.parquet(f"{folder.rstrip('/')}/{_place(run)}/{name}")


def gated_publish(spark: SparkSession, records: DataFrame, tables: dict[str, DataFrame], folder: str, run: str) -> bool:
    """Publish a source's tables only when none of its quality records is FAIL."""
    from ..operators.contracts import passes
    if not passes(records):
        return False
    publish(spark, tables, folder, run)
    return True


def log_run(records: DataFrame, folder: str, run: str) -> None:
    """Add a run's records to a log. They lie under the run's id, so logging a run again replaces what it logged before."""
    records.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{_place(run)}")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All logged records with the id of their run (`run`)."""
    return spark.read.option("basePath", folder).parquet(folder).withColumn("run", F.col("run").cast("string"))
