"""Writers: staged tables, catalogue tables, logs, GeoJSON features and flat point layers."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .releases import gated_publish, log_run


def write_staged(frame: DataFrame, folder: str, name: str, csv: bool = False) -> str:
    """One overwritten table per name: Parquet, or CSV for a table without geometry."""
    path = f"{folder.rstrip('/')}/{name}.{'csv' if csv else 'parquet'}"
    writer = frame.write.mode("overwrite")
    writer.option("header", "true").csv(path) if csv else writer.parquet(path)
    return path


def write_sorted(frame: DataFrame, path: str, keys: list[str]) -> None:
    """A table in key order over its files, without gathering it in one task."""
    frame.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def load_table(frame: DataFrame, name: str, comment: str, bucket: str | None = None, buckets: int = 64) -> None:
    """Replace a catalogue table, say where it comes from, and collect statistics. Bucketing by key keeps later joins local."""
    spark = frame.sparkSession
    writer = frame.write.mode("overwrite").format("parquet")
    if bucket:
        writer = writer.bucketBy(buckets, bucket).sortBy(bucket)
    writer.saveAsTable(name)
    text = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {name} IS '{text}'")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def load_tables(tables: dict[str, DataFrame], comments: dict[str, str], schema: str | None = None) -> dict[str, str]:
    """Load every table; one that fails does not stop the others. Returns the problems by table."""
    problems = {}
    for name, frame in tables.items():
        try:
            load_table(frame, f"{schema}.{name}" if schema else name, comments.get(name, ""))
        except Exception as error:  # the problem is reported, the other tables still load
            problems[name] = str(error).splitlines()[0]
    return problems


def table_comment(title: str, release: str, retrieved: str, licence: str) -> str:
    return f"{title}. Release: {release}. Retrieved {retrieved[:10]}. Licence: {licence}."


def write_manifest(records: DataFrame, path: str) -> None:
    """The manifest table is replaced; its maps are kept as JSON text."""
    (records.withColumns({"files": F.to_json("files"), "extra": F.coalesce(F.to_json("extra"), F.lit("{}")), "loaded_at": F.current_timestamp()})
     .write.mode("overwrite").parquet(path))


def append_quality(records: DataFrame, path: str, run_at: str) -> None:
    """The quality log only grows: each run adds its records. Adding a run's records again changes nothing."""
    log_run(records.withColumn("run_at", F.to_timestamp(F.lit(run_at))), path, re.sub("[^A-Za-z0-9._-]", "-", run_at))


def gated_write(records: DataFrame, tables: dict[str, DataFrame], folder: str, run: str = "latest") -> bool:
    """Write a source's tables only when none of its records is FAIL, all of them or none; see `releases.read_release`."""
    return gated_publish(records.sparkSession, records, tables, folder, run)


def run_report(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """(source, status, seconds, reason) of a run; rows and issues are in the metrics table and the quality log."""
    return spark.createDataFrame(runs, "source string, status string, seconds double, reason string")


def feature_text(properties: list[str], geom: str, digits: int = 5) -> Column:
    """A row's GeoJSON feature as text; a missing property is null."""
    place = F.transform(F.col(geom), lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), place.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def feature_lines(frame: DataFrame, properties: list[str], geom: str, digits: int = 5) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    return frame.select(feature_text(properties, geom, digits).alias("value"))


def write_features(frame: DataFrame, path: str, properties: list[str], geom: str) -> None:
    feature_lines(frame, properties, geom).write.mode("overwrite").text(path)


def flat_layer(points: DataFrame, tile: float, digits: int = 5, chunk: int = 10_000, key: str = "id", x: str = "x", y: str = "y",
               place: str = "place", slices: int = 256) -> DataFrame:
    """Counted and near points as flat coordinate lists [x, y, x, y, ...] per tile, in chunks of at most `chunk` points.

    Points are numbered within their tile in two levels: inside a slice of it (by a hash of the key), and by the running total of the slices before.
    So a tile that holds half of all points is numbered by many tasks, and becomes as many chunks as it needs.
    """
    rounded = points.filter(F.col(place) != "far").select(
        place, F.floor(F.col(y) / tile).alias("tile_row"), F.floor(F.col(x) / tile).alias("tile_col"),
        F.round(x, digits).alias("x"), F.round(y, digits).alias("y"), F.xxhash64(key).alias("h"))
    sliced = rounded.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int"))
    keys = [place, "tile_row", "tile_col"]
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select(*keys, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("h", "x", "y")) - 1
    spread = sliced.join(totals, [*keys, "slice"]).withColumn("part", F.floor(number / chunk))
    pair = F.struct("x", "y")
    return spread.groupBy(*keys, "part").agg(F.flatten(F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def outside_total(points: DataFrame, place: str = "place") -> DataFrame:
    return points.agg(F.count_if(F.col(place) != "counted").alias("outside_total"))
