"""Files of any size as rows of bounded size: cut at a separator by many tasks, put in order by running sums, joined only where they belong together."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable

ORDER = ["file_path", "file_block", "file_row"]


def read_pieces(spark: SparkSession, path: str | list[str], separator: str, name: str | None = None) -> DataFrame:
    """(file_path, file_block, file_row, file_size, value): what stands between separators, in file order by the first three columns."""
    reader = spark.read.option("lineSep", separator)
    if name:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    meta = F.col("_metadata")
    return reader.text(path).select(meta["file_path"].alias("file_path"), meta["file_block_start"].alias("file_block"), F.monotonically_increasing_id().alias("file_row"),
                                    meta["file_size"].alias("file_size"), "value")


def running_sum(pieces: DataFrame, value: Column, into: str) -> DataFrame:
    """Add `into`: the sum of the value over all earlier pieces of the file. Two levels: blocks of the file, of which it has few, and pieces."""
    valued = pieces.withColumn("_v", value.cast("long"))
    before = Window.partitionBy("file_path").orderBy("file_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = valued.groupBy("file_path", "file_block").agg(F.sum("_v").alias("_all"))
    blocks = blocks.select("file_path", "file_block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("file_path", "file_block").orderBy("file_row").rowsBetween(Window.unboundedPreceding, -1)
    joined = valued.join(broadcast_if_small(durable(blocks)), ["file_path", "file_block"])
    return joined.withColumn(into, F.col("_earlier") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_earlier")


def json_objects(spark: SparkSession, path: str | list[str], collection: str, name: str | None = None) -> DataFrame:
    """(file_path, value): the objects of JSON files as text. In a file whose outer object holds `collection` (a pattern) they are the objects one level
    below it, in other files the outer ones, however they are laid out over lines.

    Files are cut after every closing brace. Running sums of quotes tell which pieces begin inside a string, running sums of braces outside strings
    how deep they begin; an object is the run of pieces between two changes of level. So a document on one line is read by many tasks, and only
    the pieces of one object meet.
    """
    # Two characters of an escape stay two characters, so that places in the masked text are places in the text.
    plain = F.regexp_replace("value", r"(?s)\\.", "__")
    read = durable(read_pieces(spark, path, "}", name).withColumn("plain", plain).withColumn("quotes", F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))))
    opened = running_sum(read, F.col("quotes"), "quotes_before").withColumn("odd", (F.col("quotes_before") % 2).cast("int"))
    masked = F.array_join(F.transform(F.split("plain", '"'), lambda s, i: F.when((i + F.col("odd")) % 2 == 1, F.repeat(F.lit("_"), F.length(s))).otherwise(s)), '"')
    opened = opened.withColumn("masked", masked).withColumn("opens", F.length("masked") - F.length(F.replace("masked", F.lit("{"), F.lit(""))))
    last = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("file_block"), F.desc("last_row"))) == 1
    ends = opened.groupBy("file_path", "file_block").agg(F.max("file_row").alias("last_row")).withColumn("last", last).filter("last")
    ends = broadcast_if_small(durable(ends.select("file_path", "file_block", F.col("last_row").alias("file_row"), F.lit(True).alias("last"))))
    # What follows the last closing brace of a file ends with none.
    closes = ((F.col("odd") + F.col("quotes")) % 2 == 0) & F.col("last").isNull()
    closed = durable(opened.join(ends, ORDER, "left").withColumn("closes", closes.cast("int")).select(*ORDER, "value", "masked", "opens", "closes"))
    deep = running_sum(closed, F.col("opens") - F.col("closes"), "depth")
    outer = deep.filter((F.col("depth") <= 1) & F.col("value").rlike(collection)).select("file_path").distinct().withColumn("level", F.lit(2))
    deep = deep.join(broadcast_if_small(durable(outer)), "file_path", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    starts = (F.col("depth") < F.col("level")) & (F.col("depth") + F.col("opens") >= F.col("level"))
    marked = durable(deep.withColumn("starts", starts).filter(F.col("starts") | (F.col("depth") >= F.col("level"))))
    numbered = running_sum(marked, F.col("starts").cast("int"), "earlier").withColumn("number", F.col("earlier") + F.col("starts").cast("int"))
    skipped = F.length(F.expr("substring_index(masked, '{', CAST(level - depth AS INT))"))
    body = F.when(F.col("starts"), F.substr("value", (skipped + 1).cast("int"), F.length("value"))).otherwise(F.col("value"))
    text = F.sort_array(F.collect_list(F.struct("file_block", "file_row", F.concat(body, F.lit("}")).alias("text"))))
    return numbered.groupBy("file_path", "number").agg(F.array_join(F.transform(text, lambda p: p["text"]), "").alias("value")).select("file_path", "value")


def file_digests(spark: SparkSession, folder: str, name: str = "*") -> DataFrame:
    """(path, sha256) of all files of a name under a folder. A file's lines stream through one running digest, so no file is a row; files are
    hashed beside each other."""
    lines = read_pieces(spark, folder, "\n", name).select(*ORDER, "file_size", F.col("value").cast("binary").alias("value"))

    def digested(batches):
        last, state, seen, size = None, None, 0, 0

        def done():
            if seen < size:  # the file ends with a line break
                state.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([state.hexdigest()], pa.string())], ["path", "sha256"])
        for batch in batches:
            for path, whole, value in zip(batch.column("file_path").to_pylist(), batch.column("file_size").to_pylist(), batch.column("value").to_pylist()):
                if path != last:
                    if last is not None:
                        yield done()
                    last, state, seen, size = path, hashlib.sha256(), 0, whole
                else:
                    state.update(b"\n")
                    seen += 1
                state.update(value)
                seen += len(value)
        if last is not None:
            yield done()

    hashed = lines.repartition("file_path").sortWithinPartitions(*ORDER).mapInArrow(digested, "path string, sha256 string")
    # Empty files have no lines, and scans leave them out; their names are all the driver lists.
    name_only = F.regexp_replace("path", "^file:/+", "file:/")
    listed = spark.createDataFrame([(p,) for p in lines.inputFiles()], "path string").select(name_only.alias("path"))
    hashed = durable(hashed.select(name_only.alias("path"), "sha256"))
    return hashed.unionByName(listed.join(hashed, "path", "left_anti").select("path", F.sha2(F.lit(b""), 256).alias("sha256")))
