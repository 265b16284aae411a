"""Readers for published files: titled CSV, many CSVs with differing headers, cell grids, GeoJSON, features, manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import boxes
from ..operators.relate import first_per_key
from ..session import broadcast_if_small, durable
from . import pieces

# Fixed value: the mark of a title line, its text and date.
TITLE = r"^(.*?)\s*\[.*Generated:(\d{4}-\d{2}-\d{2})"
def _without_mark(line: Column) -> Column:
    return F.regexp_replace(line, "^﻿", "")


FILE_ORDER = ["file_path", "file_block", "file_row"]
# One cell with the comma before it; a quoted cell may hold commas, line breaks and doubled quotes.
_CELL = r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'


def cells_of(record: Column) -> Column:
    """The cells of a CSV record, without the quotes around them."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    inner = F.transform(found, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, r'^"|"\z', ""), '""', '"')).otherwise(c))
    return inner


def csv_records(lines: DataFrame) -> DataFrame:
    """(file_path, file_block, file_row, record) from lines (file_path, file_block, file_row, value): lines that end inside quotes are
    joined to the next ones.

    A line begins a record where the number of quotes before it in its file is even. That parity is a prefix sum in two levels: inside a block of
    the file, and over the totals of its blocks, of which a file has few. Only the lines of records with line breaks are then gathered, by record,
    and a record is one row; a quote that never closes makes the rest of its file one record. Empty records are left out.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = lines.withColumn("quotes", quotes)
    along = Window.partitionBy("file_path").orderBy("file_block")
    before, past = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_path", "file_block").orderBy("file_row")
    blocks = counted.groupBy("file_path", "file_block").agg(F.sum("quotes").alias("all"))
    blocks = blocks.select("file_path", "file_block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("earlier"))
    held = counted.join(broadcast_if_small(durable(blocks)), ["file_path", "file_block"])
    parity = (F.col("earlier") + F.coalesce(F.sum("quotes").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    marked = held.withColumn("begins", parity == 0).withColumn("whole", F.col("begins") & (F.col("quotes") % 2 == 0))
    marked = durable(marked.select(*FILE_ORDER, "value", "begins", "whole"))
    single = marked.filter("whole").select(*FILE_ORDER, F.col("value").alias("record"))
    # A later line belongs to the last beginning before it, which may lie in an earlier block.
    parts, start = marked.filter("NOT whole"), F.when(F.col("begins"), F.struct("file_block", "file_row"))
    lasts = parts.groupBy("file_path", "file_block").agg(F.max(start).alias("last"))
    lasts = lasts.select("file_path", "file_block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    owned = parts.join(broadcast_if_small(durable(lasts)), ["file_path", "file_block"]).withColumn("start", F.coalesce(F.last(start, ignorenulls=True).over(past), "carried"))
    line = F.sort_array(F.collect_list(F.struct("file_block", "file_row", "value")))
    several = owned.groupBy("file_path", "start").agg(F.array_join(F.transform(line, lambda x: x["value"]), "\n").alias("record"))
    several = several.select("file_path", "start.file_block", "start.file_row", "record")
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r$", "")).filter(F.col("record") != "")


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The CSV records of files, in any number of tasks; see `csv_records`."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return csv_records(lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block"),
                                    F.monotonically_increasing_id().alias("file_row"), _without_mark(F.col("value")).alias("value")))


def titled_rows(lines: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a titled CSV given as records (`value`), as text with blanks kept as "", and the release read from the title.

    The title is known by its [...Generated:date] mark; the header is the record that names all columns, in whatever order, and cells are
    taken by its places. No line numbers are needed, so the records can come from many tasks.
    """
    lines = lines.select(_without_mark(F.col("value")).alias("value"))
    title = lines.filter(F.col("value").rlike(TITLE))
    release = title.limit(1).select(F.concat(F.regexp_extract("value", TITLE, 1), F.lit(", generated "), F.regexp_extract("value", TITLE, 2)).alias("release"))
    cells = F.transform(cells_of(F.col("value")), lambda c: F.trim(c))
    heading = F.size(F.array_except(F.array(*[F.lit(c) for c in columns]), cells)) == 0
    header = lines.filter(heading).select(cells.alias("names")).first()
    if header is None:
        raise ValueError(f"no line names the columns {', '.join(columns)}")
    place = {n: i for i, n in reversed(list(enumerate(header["names"])))}
    body = lines.filter(~F.col("value").rlike(TITLE) & ~heading & (F.trim("value") != "")).select(cells_of(F.col("value")).alias("cells"))
    return body.select(*[F.coalesce(F.get("cells", F.lit(place[c])), F.lit("")).alias(c) for c in columns]), release


def read_titled_csv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return titled_rows(durable(read_records(spark, path).select(F.col("record").alias("value"))), columns)


def csv_union(records: DataFrame) -> DataFrame:
    """The records of many CSV files stacked by column name, each by its own file's header (its first record).

    Headers are rows, joined to the records by path, so one pass serves any number of files and only the names reach the driver. Blanks stay "",
    columns that a file lacks are missing. `file_path`, `file_block` and `file_row` keep the order of the rows.
    """
    records = durable(records)
    place = F.struct("file_block", "file_row")
    heads = records.groupBy("file_path").agg(F.min(place).alias("head"), F.min_by("record", place).alias("names"))
    heads = durable(heads.select("file_path", "head", F.transform(cells_of(_without_mark(F.col("names"))), lambda c: F.trim(c)).alias("names")))
    names = heads.select(F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    body = records.join(broadcast_if_small(heads), "file_path").filter(place > F.col("head")).select(*FILE_ORDER, "names", cells_of(F.col("record")).alias("cells"))

    def cell(name):
        at = F.array_position("names", F.lit(name))
        return F.when(at > 0, F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit(""))).alias(name)
    return body.select(*[cell(r["name"]) for r in names if r["name"]], *FILE_ORDER)


def read_csv_union(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """All CSVs of a name (any case) under a folder; see `csv_union`. None if there is no such file."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", either).text(folder)
    if not lines.inputFiles():
        return None
    return csv_union(csv_records(lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block"),
                                              F.monotonically_increasing_id().alias("file_row"), "value")))


def first_stop_rows(stops: DataFrame, key: str = "stop_id") -> DataFrame:
    """The first row of each stop in file order."""
    return first_per_key(stops, [key], [F.col(c) for c in FILE_ORDER]).drop(*FILE_ORDER)


def feed_release(spark: SparkSession, folder: str) -> DataFrame | None:
    """"feed <version> <start date>" from the first feed_info.txt that has a row."""
    info = read_csv_union(spark, folder, "feed_info.txt")
    if info is None:
        return None
    for column in ("feed_version", "feed_start_date"):
        if column not in info.columns:
            info = info.withColumn(column, F.lit(None).cast("string"))
    text = F.concat_ws(" ", F.lit("feed"), *[F.when(F.col(c) != "", F.col(c)) for c in ("feed_version", "feed_start_date")])
    return info.agg(F.min_by(text, F.struct(*FILE_ORDER)).alias("release"))


def read_cell_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Workbook cells as rows (file, sheet, row_no, cells). The converter that unpacks a workbook writes `row_no`."""
    frame = spark.read.format(fmt).option("header", "true").load(path)
    if "cells" in frame.columns:
        return frame.select("file", "sheet", F.col("row_no").cast("int").alias("row_no"), "cells")
    columns = [c for c in frame.columns if c not in ("file", "sheet", "row_no")]
    return frame.select("file", "sheet", F.col("row_no").cast("int").alias("row_no"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("cells"))


_FEATURE = "struct<type:string,properties:map<string,string>,geometry:string>"
_POINT = "array<double>"
_DEPTH = {"Point": 1, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def line_features(lines: DataFrame) -> DataFrame:
    """(file, marks, items) per line of GeoJSON text (file, value): how many features the line starts, and those it holds whole."""
    text = F.regexp_replace(_without_mark(F.col("value")), r"^\s+|[\s,]+$", "")
    read = lines.select("file", text.alias("value"), F.regexp_count("value", F.lit(r'"type"\s*:\s*"Feature"')).alias("marks"))
    kind = F.get_json_object("value", "$.type")
    one = F.when(kind == "Feature", F.array(F.from_json("value", _FEATURE)))
    many = F.when(kind == "FeatureCollection", F.from_json("value", f"struct<features:array<{_FEATURE}>>")["features"])
    return read.select("file", "marks", F.coalesce(one, many, F.array().cast(f"array<{_FEATURE}>")).alias("items"))


def document_features(documents: DataFrame) -> DataFrame:
    """The features of whole documents (`value`): a collection or a single feature, however it is laid out."""
    return line_features(documents.select(F.lit("").alias("file"), "value")).select(F.explode("items").alias("f"))


def read_geojson(spark: SparkSession, path: str, properties: dict[str, str], whole: bool = False) -> DataFrame:
    """Features with the declared properties (names compared in lower case), `lon` and `lat` for points, `line` and `geom`.

    Files are cut into features by many tasks, be they collections on one line, a feature per line or pretty-printed; no document is a row. With
    `whole` every file is one row, which suits many small files.
    """
    if whole:
        return feature_columns(document_features(spark.read.text(path, wholetext=True)), properties)
    objects = pieces.json_objects(spark, path, r'"type"\s*:\s*"FeatureCollection"')
    items = objects.select(F.from_json("value", _FEATURE).alias("f")).filter(F.col("f.type") == "Feature")
    return feature_columns(items, properties)


def feature_columns(items: DataFrame, properties: dict[str, str]) -> DataFrame:
    """Parsed features (`f`) as columns; see `read_geojson`."""
    lowered = F.map_from_entries(F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    read = items.select(lowered.alias("p"), F.get_json_object("f.geometry", "$.type").alias("kind"),
                        F.get_json_object("f.geometry", "$.coordinates").alias("xy"))

    def coordinates(kind):
        return F.when(F.col("kind") == kind, F.from_json("xy", "array<" * (_DEPTH[kind] - 1) + _POINT + ">" * (_DEPTH[kind] - 1)))

    def vertex(p):
        return F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    point = coordinates("Point")
    line = F.coalesce(coordinates("MultiLineString"), F.when(F.col("kind") == "LineString", F.array(coordinates("LineString"))))
    polygon = F.coalesce(coordinates("MultiPolygon"), F.when(F.col("kind") == "Polygon", F.array(coordinates("Polygon"))))
    columns = [F.try_element_at("p", F.lit(n)).try_cast(t).alias(n) for n, t in properties.items()]
    return read.select(*columns, F.get(point, 0).alias("lon"), F.get(point, 1).alias("lat"),
                       F.transform(line, lambda part: F.transform(part, vertex)).alias("line"),
                       F.transform(polygon, lambda part: F.transform(part, lambda ring: F.transform(ring, vertex))).alias("geom"))


def read_features(spark: SparkSession, path: str, box: tuple | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A feature table kept in Parquet with `minx`, `miny`, `maxx`, `maxy`: the box and the class filter reach the scan."""
    frame = spark.read.parquet(path)
    if box:
        frame = frame.filter(boxes.bounds_meet_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), box))
    if where is not None:
        frame = frame.filter(where)
    return frame.select(*columns) if columns else frame


_RECORD = ("struct<release:string,url:string,retrieved_at:string,files:map<string,struct<path:string,sha256:string>>,"
           "extra:map<string,string>>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's records: one row per source with its files and extras as maps."""
    text = spark.read.text(path, wholetext=True)
    sources = text.select(F.explode(F.from_json("value", f"struct<sources:map<string,{_RECORD}>>")["sources"]).alias("source_id", "r"))
    return sources.select("source_id", "r.*")


def check_found(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each recorded file with `status` ok, changed or missing, given the checksums found (path, found)."""
    wanted = manifest.select("source_id", F.explode("files").alias("name", "f")).select("source_id", "name", "f.path", "f.sha256")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return wanted.join(found, "path", "left").select("source_id", "name", "path", status.alias("status"))


def folder_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256) below a folder: of its files, and of each folder directly in it, as the checksum of its files' paths and checksums in order.
    A table may be one file or a folder of parts; see `pieces.file_digests`."""
    base = folder.rstrip("/") + "/"
    held = durable(pieces.file_digests(spark, folder, glob).select(F.substring_index("path", base, -1).alias("path"), "sha256"))
    top = F.substring_index("path", "/", 1)
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n")
    inner = held.filter(F.contains("path", F.lit("/"))).groupBy(top.alias("path")).agg(F.sha2(lines, 256).alias("sha256"))
    return held.unionByName(inner)


def check_files(spark: SparkSession, folder: str, manifest: DataFrame, glob: str = "*") -> DataFrame:
    """`check_found` for the files and folders of a folder, of any size."""
    return check_found(manifest, folder_digests(spark, folder, glob).withColumnRenamed("sha256", "found"))


def accepted_sources(checked: DataFrame) -> DataFrame:
    """Per source, the reason it must not be read, or missing when all its files are intact."""
    bad = F.col("status") != "ok"
    reason = F.when(F.col("status") == "missing", F.concat("path", F.lit(" is missing"))).otherwise(
        F.concat("path", F.lit(" does not match its recorded checksum")))
    return checked.groupBy("source_id").agg(F.min(F.when(bad, reason)).alias("refused"))


def read_staged(spark: SparkSession, folder: str, name: str, frames: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """A table of this run if it was made, else its staged copy, else None."""
    if frames and name in frames:
        return frames[name]
    for fmt in ("parquet", "csv"):
        try:
            return spark.read.format(fmt).option("header", "true").load(f"{folder.rstrip('/')}/{name}.{fmt}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
    return None
