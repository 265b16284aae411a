"""Registered queries of the readers, sheet rules and sinks; their inputs are sheets and layers derived from the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import areas as joins
from ..session import durable
from ..sources import files, sheets, sinks, tables
from . import areas
from .areas import table
from .spatial_queries import ASSIGN_SQL, BLOCKS_SQL, SQUARES_SQL

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def _grid(frame, file, sheet, row_no, *cells):
    return frame.select(F.lit(file).alias("file"), sheet.cast("string").alias("sheet"), row_no.cast("int").alias("row_no"),
                        F.array(*[c.cast("string") for c in cells]).alias("cells"))


def _lit(text):
    return F.lit(text).cast("string")


@query("header_discovery", """SELECT 'n' || s_nationkey AS sheet, 2 + s_nationkey % 3 AS header_row, count(*) FILTER (WHERE s_suppkey % 10 <> 3) AS data_rows,
    sum(s_suppkey) FILTER (WHERE s_suppkey % 10 <> 3) AS keys FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (WHERE s_suppkey % 10 <> 3) > 0""")
def header_discovery(spark, sf):
    """One sheet per nation with its header on a row of its own, in either column order, and some empty rows."""
    suppliers = table(spark, sf, "supplier")
    nation = F.col("s_nationkey")
    head, sheet, turned = nation % 3 + 2, F.concat(F.lit("n"), nation.cast("string")), nation % 2 == 1
    nations = suppliers.select("s_nationkey").distinct()
    empty = F.col("s_suppkey") % 10 == 3

    def pair(a, b):
        return F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    key, name = F.when(~empty, F.col("s_suppkey").cast("string")), F.when(~empty, F.col("s_name"))
    grid = (_grid(nations, "f", sheet, F.lit(1), F.concat(F.lit("Table "), sheet), _lit(None))
            .unionByName(_grid(nations, "f", sheet, head, *pair(F.lit(" Latitude "), F.lit("LONG"))))
            .unionByName(_grid(suppliers, "f", sheet, head + F.col("s_suppkey") + 1, *pair(key, name))))
    normal = {"latitude": "lat", "long": "lon"}

    def clean(v):
        text = F.lower(F.trim(v))
        return F.when(text == "latitude", normal["latitude"]).when(text == "long", normal["long"]).otherwise(text)
    headers = sheets.header_rows(grid, ["lat", "lon"], normalise=clean)
    rows = sheets.rows_below(grid, headers).join(headers, sheets.SHEET)
    value = F.get("cells", (F.array_position("header", "lat") - 1).cast("int"))
    return rows.groupBy("sheet", "header_row").agg(F.count(F.lit(1)).alias("data_rows"), F.sum(value.cast("bigint")).alias("keys"))


@query("two_level_header", """SELECT 100000000 + s_suppkey AS SA2_CODE21, s_name AS sa2_name, s_suppkey * 30 + 1 AS earners, CASE WHEN s_suppkey % 4 <> 0 THEN 30 + s_suppkey % 20 END AS median_age,
    50000 + s_suppkey AS median_income, 60000 + s_suppkey AS mean_income, '2020-21' AS year FROM supplier WHERE s_suppkey % 6 <> 0""")
def two_level_header(spark, sf):
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    one = suppliers.limit(1)
    groups = [None, None, "Earners (persons)", None, "Median age (years)", None, "Median ($)", None, "Mean ($)", None]
    years = ["SA2", "Name", "2019-20", "2020-21", "2019-20", "2020-21", "2019-20", "2020-21", "2019-20", "2020-21"]
    code = F.when(key % 6 == 0, key + 800000000).otherwise(key + 100000000)
    values = [code, F.col("s_name"), key, F.format_number(key * 30 + 1, 0), key, F.when(key % 4 == 0, "np").otherwise((key % 20 + 30).cast("string")),
              key, F.format_number(key + 50000, 0), key, key + 60000]
    sheet = F.lit("Table 1.4")
    grid = (_grid(one, "f", sheet, F.lit(5), *[_lit(g) for g in groups]).unionByName(_grid(one, "f", sheet, F.lit(6), *[_lit(y) for y in years]))
            .unionByName(_grid(suppliers, "f", sheet, key + 7, *values)))
    income, year = sheets.clean_income(grid)
    return income.withColumn("year", F.lit(year))


BUSINESS_SQL = """SELECT chr(65 + (p_partkey % 26)::INTEGER) AS code, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 800000000 ELSE 100000000 END + p_partkey AS area, p_size FROM part"""


@query("business_sheet", f"""SELECT code AS industry_code, count(*) AS rows, sum(area) AS areas, sum(p_size * 1000) AS total_businesses FROM ({BUSINESS_SQL})
    WHERE area < 200000000 AND code BETWEEN 'A' AND 'S' GROUP BY code UNION ALL SELECT 'dropped', count(*), NULL, NULL FROM ({BUSINESS_SQL}) WHERE area < 200000000 AND code > 'S'""")
def business_sheet(spark, sf):
    parts, key = table(spark, sf, "part"), F.col("p_partkey")
    one = parts.limit(1)
    heads = ["Industry", "Industry", "SA2", "SA2", *[h.title() for h in sheets.TURNOVER_HEADINGS]]
    code = F.when(key % 5 == 0, key + 800000000).otherwise(key + 100000000)
    letter = F.char(key % 26 + 65)
    grid = (_grid(one, "f", F.lit("Data"), F.lit(3), *[_lit(h) for h in heads])
            .unionByName(_grid(parts, "f", F.lit("Data"), key + 5, letter, F.col("p_type"), code, F.col("p_name"), *[F.col("p_size")] * 6,
                               F.format_number(F.col("p_size") * 1000, 0))))
    kept, dropped = sheets.clean_businesses(grid)
    per = kept.groupBy("industry_code").agg(F.count(F.lit(1)).alias("rows"), F.sum("SA2_CODE21").alias("areas"), F.sum("total_businesses").alias("total_businesses"))
    return per.unionByName(dropped.select(F.lit("dropped").alias("industry_code"), F.col("dropped_rows").alias("rows")), allowMissingColumns=True)


@query("mesh_block_merge", """SELECT 10000000000 + p_partkey AS MB_CODE21, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS category, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS dwellings,
    100000000 + p_partkey % 50 AS SA2_CODE21 FROM part WHERE p_partkey % 3 <> 0""")
def mesh_block_merge(spark, sf):
    parts, key = table(spark, sf, "part"), F.col("p_partkey")
    one = parts.limit(1)
    count_heads = ["MB_CODE_2021", "MB_CATEGORY_NAME_2021", "AREA_ALBERS_SQKM", "Dwelling", "Person"]
    place_heads = ["MB_CODE_2021", "SA1_CODE_2021", "SA2_CODE_2021", "GCCSA_CODE_2021"]
    counts = (_grid(one, "c", F.lit("Table 1"), F.lit(2), *[_lit(h) for h in count_heads])
              .unionByName(_grid(parts.filter(key % 7 != 0), "c", F.lit("Table 1"), key + 3, key + 10000000000, F.col("p_type"), F.col("p_retailprice"),
                                 F.col("p_size"), F.col("p_size") * 2)))
    places = (_grid(one, "a", F.lit("MB"), F.lit(1), *[_lit(h) for h in place_heads])
              .unionByName(_grid(parts, "a", F.lit("MB"), key + 2, key + 10000000000, key + 20000000000, key % 50 + 100000000,
                                 F.when(key % 3 == 0, "1RNSW").otherwise("1GSYD"))))
    merged = sheets.mesh_blocks(sheets.clean_mesh_allocation(places), sheets.clean_mesh_counts(counts))
    return merged.select("MB_CODE21", "category", "dwellings", "SA2_CODE21")


@query("stop_rules", """SELECT c_custkey::VARCHAR AS stop_id, CASE WHEN c_custkey % 5 <> 0 THEN 'S' || c_custkey END AS stop_code, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 4 END AS location_type,
    CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 60 <> 1 THEN 113 + c_custkey % 40 END AS lon FROM customer""")
def stop_rules(spark, sf):
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        key.cast("string").alias("stop_id"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("S"), key.cast("string"))).alias("stop_code"),
        F.col("c_name").alias("stop_name"), F.when(key % 4 == 0, "").otherwise((key % 4).cast("string")).alias("location_type"),
        F.when(key % 50 == 0, "").when(key % 60 == 1, "1501").otherwise((key % 40 + 113).cast("string")).alias("stop_lon"), F.lit("-33.5").alias("stop_lat"))
    return tables.clean_stops(rows).select("stop_id", "stop_code", "location_type", "lon")


@query("shop_sources", f"""WITH {BLOCKS_SQL}, n AS (SELECT 'n' || p_partkey AS osm_id, CASE p_partkey % 4 WHEN 0 THEN 'supermarket' ELSE 'convenience' END AS kind, 'node' AS mapped_as FROM part WHERE p_partkey % 4 IN (0, 1)),
    a AS (SELECT CASE WHEN id % 3 = 0 THEN 'r' || id ELSE 'w' || (id + 5) END AS osm_id, 'convenience' AS kind, 'area' AS mapped_as FROM blk WHERE id % 2 = 0)
    SELECT * FROM n UNION ALL SELECT * FROM a""")
def shop_sources(spark, sf):
    key = F.col("p_partkey")
    shop = F.when(key % 4 == 0, "supermarket").when(key % 4 == 1, "newsagent").otherwise("florist")
    nodes = table(spark, sf, "part").select(key.alias("osm_id"), F.col("p_name").alias("name"), F.lit(151.0).alias("lon"), F.lit(-33.0).alias("lat"),
                                            F.concat(F.lit('"shop"=>"'), shop, F.lit('"')).alias("other_tags"))
    turned = geo.map_vertices(F.col("geom"), lambda x, y: F.struct((x / 100 + 151).alias("x"), (y / 1000 - 34).alias("y")))
    shapes = areas.blocks(spark, sf).select(
        F.col("id").alias("osm_id"), F.when(F.col("id") % 3 != 0, F.col("id") + 5).alias("osm_way_id"), F.lit(None).cast("string").alias("shop"),
        F.when(F.col("id") % 2 == 0, "fuel").alias("amenity"), F.lit("Fuel").alias("name"), F.lit(None).cast("string").alias("other_tags"), turned.alias("geom"))
    return tables.clean_shops(nodes, shapes).select("osm_id", "kind", "mapped_as")


@query("catchment_rules", """WITH p AS (SELECT p_partkey AS id, 'PRIMARY' AS t, p_name AS d FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey AS id, 'HIGH' AS t, p_name AS d FROM part WHERE p_partkey % 3 = 0),
    f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN 'FUTURE' END AS t, NULL::VARCHAR AS d FROM part WHERE p_partkey % 5 = 0),
    cur AS (SELECT * FROM p UNION ALL SELECT * FROM s), fst AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'PRIMARY' ELSE 'HIGH' END AS t, p_name AS d FROM part)
    SELECT id AS USE_ID, t AS CATCH_TYPE, d AS USE_DESC FROM cur WHERE id NOT IN (SELECT id FROM f)
    UNION ALL SELECT f.id, coalesce(f.t, fst.t), coalesce(f.d, fst.d) FROM f JOIN fst USING (id) WHERE f.id IN (SELECT id FROM cur)""")
def catchment_rules(spark, sf):
    shapes = areas.blocks(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    key = F.col("id")

    def layer(step, kind, text):
        return shapes.filter(key % step == 0).select(key.alias("USE_ID"), kind.alias("CATCH_TYPE"), text.alias("USE_DESC"), "geom")
    none = F.lit(None).cast("string")
    future = layer(5, F.when(key % 10 != 0, "FUTURE"), none)
    out = tables.clean_catchments(layer(2, F.lit("PRIMARY"), F.col("p_name")), layer(3, F.lit("HIGH"), F.col("p_name")), future)
    return out.select("USE_ID", "CATCH_TYPE", "USE_DESC")


@query("feature_json", f"""WITH {SQUARES_SQL} SELECT code, area_name AS name, CASE WHEN code % 8 <> 0 THEN area_km2 END AS area_km2, c + 1.0 AS second_x, 5 AS corners FROM sq""")
def feature_json(spark, sf):
    """Features written as text and read back by path, as a page would."""
    squares = areas.squares(spark, sf).withColumn("km2", F.when(F.col("code") % 8 != 0, F.col("area_km2"))).withColumnRenamed("area_name", "name")
    text = sinks.feature_lines(squares, ["code", "name", "km2"], "geom")

    def read(path):
        return F.get_json_object("value", path)
    ring = F.from_json(read("$.geometry.coordinates[0][0]"), "array<array<double>>")
    return text.select(read("$.properties.code").cast("bigint").alias("code"), read("$.properties.name").alias("name"),
                       read("$.properties.km2").cast("bigint").alias("area_km2"), F.get(F.get(ring, 1), 0).alias("second_x"), F.size(ring).alias("corners"))


@query("flat_layer", f"""WITH {ASSIGN_SQL}, b AS (SELECT min(c) AS x0, min(r) AS y0, max(c) + 1 AS x1, max(r) + 1 AS y1 FROM sq),
    p AS (SELECT x, y, CASE WHEN area_code IS NOT NULL THEN 'counted' WHEN x BETWEEN x0 - 0.3 AND x1 + 0.3 AND y BETWEEN y0 - 0.3 AND y1 + 0.3 THEN 'near' ELSE 'far' END AS place FROM asg, b)
    SELECT place, floor(y / 4)::BIGINT AS tile_row, floor(x / 4)::BIGINT AS tile_col, count(*) AS points, round(sum(x + y), 3) AS total FROM p WHERE place <> 'far' GROUP BY ALL""")
def flat_layer(spark, sf):
    placed = joins.assign_points(areas.sites(spark, sf), areas.squares(spark, sf))
    layer = sinks.flat_layer(joins.split_points(placed, areas.squares(spark, sf), "geom", 0.3), 4.0, chunk=500)
    total = F.aggregate("coordinates", F.lit(0.0), lambda a, v: a + v)
    return (layer.select("place", "tile_row", "tile_col", (F.size("coordinates") / 2).alias("n"), total.alias("t"))
            .groupBy("place", "tile_row", "tile_col").agg(F.sum("n").cast("bigint").alias("points"), F.round(F.sum("t"), 3).alias("total")))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("manifest_check", """SELECT t AS source_id, t || '.parquet' AS path, CASE t WHEN 'orders' THEN 'changed' WHEN 'absent' THEN 'missing' ELSE 'ok' END AS status
    FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations', 'absent']) AS t)""")
def manifest_check(spark, sf):
    """The tables' own files against a manifest in which one checksum is wrong and one file is missing."""
    name = F.substring_index("path", ".", 1)
    held = durable(files.folder_digests(spark, sf, "*.parquet")).filter(name.isin(TABLES) & (F.col("path") == F.concat(name, F.lit(".parquet"))))
    wrong = F.when(name == "orders", F.reverse("sha256")).otherwise(F.col("sha256"))
    listed = held.select(name.alias("source_id"), F.map_from_arrays(F.array(F.lit("main")), F.array(F.struct("path", wrong.alias("sha256")))).alias("files"))
    gone = spark.range(1).select(F.lit("absent").alias("source_id"), F.map_from_arrays(
        F.array(F.lit("main")), F.array(F.struct(F.lit("absent.parquet").alias("path"), F.sha2(F.lit(b""), 256).alias("sha256")))).alias("files"))
    return files.check_files(spark, sf, listed.unionByName(gone), "*.parquet").select("source_id", "path", "status")
