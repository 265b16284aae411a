"""Registered queries of layouts that vary: several sheets in one pile, CSV lines, GeoJSON documents, manifests, areas of very different sizes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..functions import geometry as geo
from ..functions.cells import AGE_BANDS
from ..operators import areas as joins
from ..operators import contracts
from ..session import scratch_folder
from ..sources import files, releases, sheets, sinks, tables
from . import areas
from .areas import table
from .source_queries import _grid, _lit
from .spatial_queries import BLOCKS_SQL, SQUARES_SQL

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f
    return register


WIDE = (-3.0, -3.0, 40.0, 400.0)


@query("area_shares_mixed", f"""WITH {SQUARES_SQL}, {BLOCKS_SQL}, a AS (SELECT code, c AS ax0, r AS ay0, c + 1 AS ax1, r + 1 AS ay1 FROM sq UNION ALL SELECT 9000000, {WIDE[0]}, {WIDE[1]}, {WIDE[2]}, {WIDE[3]}),
    p AS (SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM blk UNION ALL SELECT -1, {WIDE[0]} + 1, {WIDE[1]} + 1, {WIDE[2]} + 8, {WIDE[3]} + 8),
    o AS (SELECT id, code, least(x1, ax1) - greatest(x0, ax0) AS w, least(y1, ay1) - greatest(y0, ay0) AS h, (x1 - x0) * (y1 - y0) AS whole FROM p JOIN a ON least(x1, ax1) > greatest(x0, ax0) AND least(y1, ay1) > greatest(y0, ay0))
    SELECT code AS area_code, count(*) AS polygons, round(sum(w * h), 4) AS overlap, round(sum(w * h / whole), 4) AS share FROM o GROUP BY code""")
def area_shares_mixed(spark, sf):
    """One area and one polygon over everything among thousands of small ones."""
    def with_wide(frame, key, number, grow):
        x0, y0, x1, y1 = (F.lit(v + g) for v, g in zip(WIDE, grow))
        return frame.select(key, "geom").unionByName(spark.range(1).select(F.lit(number).cast("bigint").alias(key), geo.rectangle(x0, y0, x1, y1).alias("geom")))
    shares = joins.area_shares(with_wide(areas.blocks(spark, sf), "id", -1, (1, 1, 8, 8)), with_wide(areas.squares(spark, sf), "code", 9_000_000, (0, 0, 0, 0)))
    return shares.groupBy("area_code").agg(F.count(F.lit(1)).alias("polygons"), F.round(F.sum("overlap"), 4).alias("overlap"), F.round(F.sum("area_share"), 4).alias("share"))


@query("points_nested_areas", f"""WITH {SQUARES_SQL}, site AS (SELECT (o_custkey % 81) / 8.0::DOUBLE - 5 AS x, (o_orderkey % 83) / 8.0::DOUBLE - 5 AS y, o_orderkey AS k FROM orders),
    asg AS (SELECT k, (SELECT min(code) FROM sq WHERE greatest(abs(x), abs(y)) <= (code + 1) / 16.0) AS area_code FROM (SELECT k, x, y FROM site))
    SELECT area_code, count(*) AS points FROM asg GROUP BY area_code""")
def points_nested_areas(spark, sf):
    """Every area lies around the same spot, and the points' ids repeat or are missing."""
    key = F.col("s_suppkey")
    half = (key + 1) / 16.0
    nested = table(spark, sf, "supplier").select(key.alias("code"), geo.rectangle(-half, -half, half, half).alias("geom"))
    ids = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderkey") % 7)
    points = table(spark, sf, "orders").select(ids.alias("id"), ((F.col("o_custkey") % 81) / 8.0 - 5).alias("x"), ((F.col("o_orderkey") % 83) / 8.0 - 5).alias("y"))
    return joins.assign_points(points, nested).groupBy("area_code").agg(F.count(F.lit(1)).alias("points"))


@query("multi_sheet_mesh", """SELECT 10000000000 + p_partkey AS MB_CODE21, p_type AS category, p_retailprice AS area_sqkm, p_size AS dwellings, p_size * 2 + 1 AS persons FROM part""")
def multi_sheet_mesh(spark, sf):
    """Two sheets in one pile, with their headers on other rows and their columns in another order."""
    parts, key, one = table(spark, sf, "part"), F.col("p_partkey"), spark.range(1)
    values = {"MB_CODE_2021": key + 10_000_000_000, "MB_CATEGORY_NAME_2021": F.col("p_type"), "AREA_ALBERS_SQKM": F.col("p_retailprice"),
              "Dwelling": F.col("p_size"), "Person": F.col("p_size") * 2 + 1}
    first, other = list(values), ["MB_CODE_2021", *list(values)[:0:-1]]
    pile = None
    for sheet, order, head, half in (("a", first, 2, 0), ("b", other, 5, 1)):
        rows = _grid(one, "f", F.lit(sheet), F.lit(head), *[_lit(h) for h in order]).unionByName(
            _grid(parts.filter(key % 2 == half), "f", F.lit(sheet), key + head + 1, *[values[h] for h in order]))
        pile = rows if pile is None else pile.unionByName(rows)
    return sheets.clean_mesh_counts(pile)


@query("newest_sheet", """SELECT chr(65 + (p_partkey % 19)::INTEGER) AS industry_code, count(*) AS areas, sum(p_size * 2) AS total_businesses FROM part GROUP BY 1""")
def newest_sheet(spark, sf):
    """The workbook holds an older year too; only the newest turnover sheet counts."""
    parts, key, one = table(spark, sf, "part"), F.col("p_partkey"), spark.range(1)
    heads = ["Industry", "Industry", "SA2", "SA2", *sheets.TURNOVER_HEADINGS]
    pile = None
    for sheet, year, times in (("new", 2031, 2), ("old", 2030, 1)):
        counts = [F.col("p_size") * times] * 7
        rows = (_grid(one, "f", F.lit(sheet), F.lit(1), _lit(f"by Turnover Size, June {year}"), *[_lit(None)] * 10)
                .unionByName(_grid(one, "f", F.lit(sheet), F.lit(3), *[_lit(h) for h in heads]))
                .unionByName(_grid(parts, "f", F.lit(sheet), key + 5, F.char(key % 19 + 65), F.col("p_type"), key + 100_000_000, F.col("p_name"), *counts)))
        pile = rows if pile is None else pile.unionByName(rows)
    kept, _ = sheets.newest_businesses(pile)
    return kept.groupBy("industry_code").agg(F.count(F.lit(1)).alias("areas"), F.sum("total_businesses").alias("total_businesses"))


@query("population_sheet", """SELECT 100000000 + p_partkey AS SA2_CODE21, p_name AS sa2_name, p_size AS "0-4_people", p_size + 17 AS "85-and-over_people", p_size * 18 + 153 AS total_people
    FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0""")
def population_sheet(spark, sf):
    parts, key, one = table(spark, sf, "part"), F.col("p_partkey"), spark.range(1)
    labels = [b.replace("-and-over", " and over").replace("-", "–") for b in AGE_BANDS]
    rows = (_grid(one, "f", F.lit("t"), F.lit(4), *[_lit(x) for x in [None, None, None, None, *labels, "Total persons"]])
            .unionByName(_grid(one, "f", F.lit("t"), F.lit(5), *[_lit(x) for x in ["Year", "SA2 name", "GCCSA code", "SA2 code", *["no."] * 19]]))
            .unionByName(_grid(parts, "f", F.lit("t"), key + 6, F.when(key % 2 == 0, 2031).otherwise(2030), F.col("p_name"), F.when(key % 3 == 0, "1RNSW").otherwise("1GSYD"),
                               key + 100_000_000, *[F.col("p_size") + i for i in range(18)], F.format_number(F.col("p_size") * 18 + 153, 0))))
    return sheets.clean_population(rows, 2031).select("SA2_CODE21", "sa2_name", F.col("`0-4_people`"), F.col("`85-and-over_people`"), "total_people")


@query("titled_csv", """SELECT c_custkey AS polling_place_id, c_name || ', "hall" 2' AS polling_place_name, CASE WHEN c_custkey % 5 <> 0 THEN 151.25 END AS lon, 'Vote, generated 2031-05-06' AS release
    FROM customer WHERE c_custkey % 4 <> 0""")
def titled_csv(spark, sf):
    """Lines of a titled CSV with doubled quotes, commas inside quotes and its columns in another order."""
    names = [*tables.PLACE_NAMES, "Latitude", "Longitude"]
    held = {n: F.lit("") for n in names} | {
        "State": F.when(F.col("c_custkey") % 4 == 0, "VIC").otherwise("NSW"), "PollingPlaceID": F.col("c_custkey").cast("string"), "Latitude": F.lit("-33.5"),
        "PollingPlaceNm": F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""hall"" 2"')), "Longitude": F.when(F.col("c_custkey") % 5 == 0, "0").otherwise("151.25")}
    order = names[::-1]
    lines = (table(spark, sf, "customer").select(F.concat_ws(",", *[held[n] for n in order]).alias("value"))
             .unionByName(spark.range(1).select(F.explode(F.array(F.lit("Vote [Event Generated:2031-05-06T10]"), F.lit(",".join(order)))).alias("value"))))
    rows, release = files.titled_rows(lines, names)
    places = tables.clean_polling_places(rows)
    return places.select("polling_place_id", "polling_place_name", "lon", F.lit(release.first()["release"]).alias("release"))


@query("multi_file_csv", """WITH c AS (SELECT c_custkey AS k, c_custkey // 100 % 3 AS kind FROM customer)
    SELECT k::VARCHAR AS stop_id, CASE WHEN kind <> 1 THEN CASE WHEN k % 3 = 0 THEN 'Stand "' || k || '",' || chr(10) || chr(10) || 'level 2' WHEN k % 3 = 1 THEN 'Plain ' || k ELSE '' END END AS stop_name,
    CASE WHEN kind <> 2 THEN CASE WHEN k % 4 = 0 THEN '' ELSE (k % 90)::VARCHAR END END AS lat, CASE WHEN kind = 2 THEN 'a, b' END AS "note, long" FROM c""")
def multi_file_csv(spark, sf):
    """Files of customers with three kinds of headers, and names with quotes, commas and line breaks, read in one pass."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit('"Stand ""'), key.cast("string"), F.lit('"",\n\nlevel 2"'))).when(key % 3 == 1, F.concat(F.lit("Plain "), key.cast("string"))).otherwise("")
    lat = F.when(key % 4 == 0, "").otherwise((key % 90).cast("string"))
    file = F.floor(key / 100)
    kind = file % 3
    row = F.when(kind == 0, F.concat_ws(",", key.cast("string"), name, lat)).when(kind == 1, F.concat_ws(",", lat, key.cast("string"))).otherwise(F.concat_ws(",", F.lit('"a, b"'), name, key.cast("string")))
    head = F.when(kind == 0, "stop_id,stop_name,lat").when(kind == 1, "lat,stop_id").otherwise('"note, long",stop_name,"stop_id"')
    rows = table(spark, sf, "customer").select(file.alias("file"), key.alias("place"), row.alias("value"), head.alias("head"))
    heads = rows.groupBy("file").agg(F.lit(-1).cast("long").alias("place"), F.min("head").alias("value"))
    lines = rows.select("file", "place", "value").unionByName(heads.select("file", "place", "value"))
    folder = scratch_folder(spark)
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(folder)
    return files.read_csv_union(spark, folder, "*.txt").drop(*files.FILE_ORDER)


@query("staged_tables", "SELECT c_custkey AS code, upper(c_name) AS name, 'second' AS release FROM customer")
def staged_tables(spark, sf):
    """A second release over a first one, and a third that fails on its way and changes nothing."""
    customers, folder = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")), scratch_folder(spark)
    releases.publish(spark, {"customers": customers.limit(0)}, folder, "first")
    releases.publish(spark, {"customers": customers.withColumn("name", F.upper("name"))}, folder, "second")
    broken = customers.withColumn("name", F.raise_error(F.lit("a broken table")).cast("string"))
    try:
        releases.publish(spark, {"customers": customers, "other": broken}, folder, "third")
    except Exception as error:
        if "a broken table" not in str(error):
            raise
    return releases.read_release(spark, folder, "customers").withColumn("release", F.lit(releases.current_run(spark, folder)))


@query("gated_release", """SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY c_nationkey""")
def gated_release(spark, sf):
    """Counts that pass their checks are released; a later release with a failing record is not."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    folder, profile = scratch_folder(spark), contracts.profile(counts, "counts", ["nation"])
    sound = contracts.issue_record(contracts.run_checks(counts, "counts", [contracts.Check(F.min("customers"), "empty nations", low=1)]), profile, "counts")
    faulty = contracts.issue_record(contracts.run_checks(counts, "counts", [contracts.Check(F.count(F.lit(1)), "{value} nations", high=0)]), profile, "counts")
    done = [releases.gated_publish(spark, records, {"counts": frame}, folder, run) for run, records, frame in (("r1", sound, counts), ("r2", faulty, counts.limit(0)))]
    if done != [True, False]:
        raise RuntimeError(f"the gate let through {done}")
    return releases.read_release(spark, folder, "counts")


@query("quality_log", """SELECT 'nation ' || c_nationkey AS dataset, count(*) AS rows, unnest(['2031-01-01', '2031-01-02']) AS run FROM customer GROUP BY c_nationkey""")
def quality_log(spark, sf):
    """Two runs log their records, the second one twice."""
    records = table(spark, sf, "customer").groupBy(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    folder = scratch_folder(spark)
    for run in ("2031-01-01", "2031-01-02", "2031-01-02"):
        releases.log_run(records, folder, run)
    return releases.read_log(spark, folder)


@query("geojson_features", f"""WITH {SQUARES_SQL} SELECT code, area_name AS name, c + 1.0 AS second_x FROM sq""")
def geojson_features(spark, sf):
    """Features as one collection per ten areas, each on one line, and read back."""
    squares = areas.squares(spark, sf).withColumnRenamed("area_name", "name")
    tens = squares.withColumn("file", F.floor(F.col("code") / 10))
    lines = tens.select("file", sinks.feature_text(["code", "name"], "geom").alias("value"))
    collections = lines.groupBy("file").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("value"), ", "), F.lit("]}")).alias("value"))
    items = files.line_features(collections).select(F.explode("items").alias("f"))
    read = files.feature_columns(items, {"code": "bigint", "name": "string"})
    return read.select("code", "name", F.get(F.get(F.get("geom", 0), 0), 1)["x"].alias("second_x"))


@query("manifest_pages", """SELECT page_id::VARCHAR AS source_id, url AS path, CASE WHEN page_id % 17 = 0 THEN 'missing' WHEN page_id % 10 = 0 THEN 'changed' ELSE 'ok' END AS status FROM pages""")
def manifest_pages(spark, sf):
    """Pages as recorded files: some were changed afterwards, some are gone."""
    pages = table(spark, sf, "pages")
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    path = F.concat_ws("#", "url", "page_id")
    recorded = pages.select(F.col("page_id").cast("string").alias("source_id"), F.map_from_arrays(F.array(F.lit("main")), F.array(F.struct(
        path.alias("path"), F.when(F.col("page_id") % 10 == 0, F.reverse(digest)).otherwise(digest).alias("sha256")))).alias("files"))
    found = pages.filter(F.col("page_id") % 17 != 0).select(path.alias("path"), digest.alias("found"))
    return files.check_found(recorded, found).select("source_id", F.regexp_replace("path", "#[0-9]+$", "").alias("path"), "status")


@query("snake_names", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'latitude' ELSE lower(regexp_replace(trim(regexp_replace(p_type || ' no', '[^A-Za-z0-9]+', ' ', 'g')), ' ', '_', 'g')) END AS name,
    CASE WHEN p_partkey % 4 = 0 THEN 2020 END AS year FROM part""")
def snake_names(spark, sf):
    key = F.col("p_partkey")
    heading = F.when(key % 3 == 0, " Lat ").otherwise(F.concat(F.lit("("), F.col("p_type"), F.lit(") no.")))
    dates = F.when(key % 4 == 0, "2020-02-03").when(key % 4 == 1, "2020").otherwise("soon")
    return table(spark, sf, "part").select("p_partkey", cells.snake_cell(heading).alias("name"), F.year(cells.date_or_null(dates)).alias("year"))
