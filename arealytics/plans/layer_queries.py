"""Registered queries of the map layers and of tables that go through files: cell grids, staged tables, sorted output, hospitals, roads, amenities."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import contracts, spatial_stats
from ..operators.ranking import ranked
from ..session import durable, only_row, scratch_folder
from ..sources import files, runs, sinks, tables
from .areas import table
from .spatial_queries import MORAN_SQL, _weights, _z

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f
    return register


@query("cell_grid_files", """SELECT 'book' AS file, 'sheet ' || p_size AS sheet, p_partkey::INT AS row_no, p_name || '|' || CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE p_type END AS cells FROM part""")
def cell_grid_files(spark, sf):
    """Workbook cells written as a converter would, one column per cell, and read back as a grid."""
    key = F.col("p_partkey")
    wide = table(spark, sf, "part").select(F.lit("book").alias("file"), F.concat(F.lit("sheet "), F.col("p_size").cast("string")).alias("sheet"), key.cast("string").alias("row_no"),
                                           F.col("p_name").alias("A"), F.when(key % 3 != 0, F.col("p_type")).alias("B"))
    folder = scratch_folder(spark)
    wide.write.option("header", "true").csv(folder)
    grid = files.read_cell_grid(spark, folder, "csv")
    return grid.select("file", "sheet", "row_no", F.array_join("cells", "|", "-").alias("cells"))


@query("staged_readback", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'run' ELSE 'staged' END AS taken_from FROM customer""")
def staged_readback(spark, sf):
    """A table of this run goes before its staged copy, a staged one before none."""
    customers, folder = table(spark, sf, "customer"), scratch_folder(spark)
    halves = {n: customers.filter(F.col("c_custkey") % 2 == r).select(F.col("c_custkey").alias("id")) for n, r in (("even", 0), ("odd", 1))}
    for name, frame in halves.items():
        sinks.write_staged(frame.withColumn("taken_from", F.lit("staged")), folder, name)
    run = {"even": halves["even"].withColumn("taken_from", F.lit("run"))}
    if files.read_staged(spark, folder, "none", run) is not None:
        raise RuntimeError("a table that was never made was read")
    return files.read_staged(spark, folder, "even", run).unionByName(files.read_staged(spark, folder, "odd", run))


@query("sorted_output", """SELECT o_orderkey AS id, o_custkey AS customer, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders""")
def sorted_output(spark, sf):
    """Orders written in order over many files; each row's place follows from the files before its own and the rows before it there."""
    folder = scratch_folder(spark)
    sinks.write_sorted(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), folder, ["customer", "id"])
    read = spark.read.parquet(folder).select("id", "customer", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"))
    inside = ranked(read, [F.col("customer").asc(), F.col("id").asc()], by=["file"], name="inner")
    sizes = read.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row per file
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return inside.join(sizes, "file").select("id", "customer", (F.col("earlier") + F.col("inner")).alias("place"))


@query("hospitals", """SELECT s_suppkey AS topoid, s_name AS generalname, CASE WHEN s_suppkey % 4 = 0 THEN 2 END AS classsubtype, 151.5::DOUBLE AS lon, -33.5::DOUBLE AS lat FROM supplier WHERE s_suppkey % 5 <> 0""")
def hospitals(spark, sf):
    key = F.col("s_suppkey")
    raw = table(spark, sf, "supplier").select(F.concat(key.cast("string"), F.lit(".0")).alias("topoid"), F.col("s_name").alias("generalname"), F.lit(None).cast("string").alias("alternativelabel"),
                                              F.when(key % 4 == 0, "2").otherwise("n/a").alias("classsubtype"), F.lit("1").alias("operationalstatus"),
                                              F.when(key % 5 != 0, 151.5).alias("lon"), F.lit(-33.5).alias("lat"))
    return tables.clean_hospitals(raw).select("topoid", "generalname", "classsubtype", "lon", "lat")


@query("walking_roads", """SELECT p_partkey::VARCHAR AS osm_id, CASE p_partkey % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary_link' WHEN 3 THEN 'pedestrian' END AS highway, 2::INT AS vertices FROM part
    WHERE p_partkey % 4 <> 2 AND p_partkey % 5 NOT IN (1, 2)""")
def walking_roads(spark, sf):
    """Street classes by part; some are closed to people, some closed but open on foot, some are motor roads."""
    key = F.col("p_partkey")
    kind = F.when(key % 4 == 0, "residential").when(key % 4 == 1, "primary_link").when(key % 4 == 2, "motorway").otherwise("pedestrian")
    tag = (F.when(key % 5 == 1, '"access"=>"private"').when(key % 5 == 2, '"lit"=>"yes","motorroad"=>"yes"').when(key % 5 == 3, '"access"=>"no","foot"=>"designated"'))
    ends = [F.struct(key.cast("double").alias("x"), F.lit(y).alias("y")) for y in (0.0, 1.0)]
    raw = table(spark, sf, "part").select(key.alias("osm_id"), kind.alias("highway"), F.col("p_name").alias("name"), tag.alias("other_tags"), F.array(F.array(*ends)).alias("line"))
    return tables.clean_roads(raw).select("osm_id", "highway", F.size(F.flatten("geom")).alias("vertices"))


@query("amenities", """SELECT c_custkey::VARCHAR AS osm_id, CASE WHEN c_custkey % 3 = 0 THEN 'toilets' ELSE 'drinking_water' END AS amenity, c_name AS name FROM customer WHERE c_custkey % 3 <> 2""")
def amenities(spark, sf):
    key = F.col("c_custkey")
    what = F.when(key % 3 == 0, "toilets").when(key % 3 == 1, "drinking_water").otherwise("bench")
    raw = table(spark, sf, "customer").select(key.alias("osm_id"), F.col("c_name").alias("name"), F.concat(F.lit('"fee"=>"no","amenity"=>"'), what, F.lit('"')).alias("other_tags"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    return tables.clean_amenities(raw).select("osm_id", "amenity", "name")


@query("local_layer", "SELECT n_nationkey AS objectid, n_name AS \"site name\" FROM nation")
def local_layer(spark, sf):
    return tables.clean_local_layer(table(spark, sf, "nation").select(F.col("n_nationkey").alias("OBJECTID"), F.col("n_name").alias("Site Name")))


@query("promoted_polygons", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN 1 END AS parts, CASE WHEN p_partkey % 4 <> 0 THEN (p_size * 2)::DOUBLE END AS area FROM part""")
def promoted_polygons(spark, sf):
    """Single polygons become one-part features; a missing one stays missing."""
    size = F.col("p_size").cast("double")
    rings = F.when(F.col("p_partkey") % 4 != 0, F.get(geo.rectangle(F.lit(0.0), F.lit(0.0), size, F.lit(2.0)), F.lit(0)))
    feature = durable(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), geo.as_multipolygon(rings).alias("geom")))
    return feature.select("id", F.when(F.col("geom").isNotNull(), F.size("geom")).alias("parts"), F.when(F.col("geom").isNotNull(), geo.polygon_area(F.col("geom"))).alias("area"))


@query("moran_identities", f"""WITH {MORAN_SQL} SELECT round(avg(z * nm), 6) AS mean_of_local, round(sum(z * nm) / sum(z * z), 6) AS slope,
    round(count(*) / sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) * sum(z * nm) / sum(z * z), 6) AS global_i FROM lg""")
def moran_identities(spark, sf):
    """The mean of the local values and the slope of neighbour means on values, beside the global value."""
    values, weights = _z(spark, sf), _weights(spark, sf)
    total = only_row(spatial_stats.global_moran(values, weights))["morans_i"]
    local = spatial_stats.local_moran(values, weights).agg(F.round(F.avg("local_i"), 6).alias("mean_of_local"), F.round(F.sum(F.col("z") * F.col("neighbour_mean")) / F.sum(F.col("z") * F.col("z")), 6).alias("slope"))
    return local.withColumn("global_i", F.round(F.lit(total), 6))


@query("geometry_rules", """WITH p AS (SELECT p_partkey % 6 AS k FROM part) SELECT "column", rule, n FROM (SELECT 'geom' AS "column", 'not null' AS rule, count(*) FILTER (k = 0) AS n FROM p
    UNION ALL SELECT 'geom', 'not empty', count(*) FILTER (k IN (1, 2)) FROM p UNION ALL SELECT 'line', 'a line', count(*) FILTER (k IN (1, 3)) FROM p
    UNION ALL SELECT 'place', 'not null', count(*) FILTER (k = 4) FROM p UNION ALL SELECT 'place', 'inside (150.0, -35.0, 152.0, -33.0)', count(*) FILTER (k = 5) FROM p) t WHERE n > 0""")
def geometry_rules(spark, sf):
    """Polygons that are missing or empty, lines of no or several parts, and points that are missing or out of the box."""
    k = F.col("k")
    at = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    line, none = F.array(at, at), F.array().cast("array<struct<x:double,y:double>>")
    polygon = F.when(k == 1, F.array().cast(geo.POLYGON_TYPE)).when(k == 2, F.array(F.array(none))).when(k > 2, geo.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    lines = F.when(k == 1, F.array(none)).when(k == 3, F.array(line, line)).otherwise(F.array(line))
    frame = table(spark, sf, "part").select((F.col("p_partkey") % 6).alias("k")).select(
        polygon.alias("geom"), lines.alias("line"), F.when(k != 4, F.when(k == 5, 140.0).otherwise(151.0)).alias("lon"), F.lit(-34.0).alias("lat"))
    rules = contracts.Contract((contracts.Field("geom", "polygon"), contracts.Field("line", "line"), contracts.Field("place", "point", box=(150.0, -35.0, 152.0, -33.0))))
    return contracts.contract_failures(durable(frame), rules, "shapes").select("column", "rule", "n")


def _loaded(spark, sf):
    """Three sources: a sound one with two tables, one with a warning, and one that fails its checks."""
    run = runs.Run(spark, scratch_folder(spark), "r1")
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    none = contracts.run_checks(customers, "customers", [contracts.Check(F.count(F.lit(1)), "{value} customers", low=0)])
    few = contracts.run_checks(suppliers, "suppliers", [contracts.Check(F.lit(1), "one is few", "warn", low=2)])
    bad = contracts.run_checks(suppliers, "broken", [contracts.Check(F.lit(1), "one is too few", low=2)])
    records = {n: contracts.issue_record(issues, contracts.profile(frame, n), n) for n, issues, frame in (("customers", none, customers), ("suppliers", few, suppliers), ("broken", bad, suppliers))}
    run.load("customers", "2031", {"all": customers, "rich": customers.filter("c_acctbal > 0")}, records["customers"], {"all": {"nation_3": F.count_if(F.col("c_nationkey") == 3)}})
    run.load("suppliers", "2030", {"all": suppliers}, records["suppliers"])
    run.load("broken", "2029", {"all": suppliers}, records["broken"])
    return run


@query("run_report", """SELECT 'customers' AS source, 'ok' AS status, '2031' AS release, 'all=' || (SELECT count(*) FROM customer) || ',rich=' || (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS rows, '' AS issues, '' AS reason
    UNION ALL SELECT 'suppliers', 'ok', '2030', 'all=' || (SELECT count(*) FROM supplier), 'suppliers: one is few', ''
    UNION ALL SELECT 'broken', 'failed', '2029', '', 'broken: one is too few', 'failed its checks: broken: one is too few'""")
def run_report(spark, sf):
    rows = F.array_join(F.array_sort(F.transform(F.map_entries("rows"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return _loaded(spark, sf).report().select("source", "status", "release", rows.alias("rows"), F.array_join("issues", "; ").alias("issues"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("run_metrics", """SELECT 'customers' AS source, 'all.rows' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'customers', 'all.nation_3', count(*) FILTER (c_nationkey = 3) FROM customer
    UNION ALL SELECT 'customers', 'rich.rows', count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'suppliers', 'all.rows', count(*) FROM supplier""")
def run_metrics(spark, sf):
    return _loaded(spark, sf).metrics()
