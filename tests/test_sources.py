import hashlib
import json

import pytest
from pyspark.sql import functions as F

from arealytics.sources import files, releases, sheets, sinks, tables
from shapes import box, polygons


def grid(spark, rows, sheet="s"):
    width = max(len(r) for r in rows)
    data = [("f", sheet, i + 1, [None if v is None else str(v) for v in r] + [None] * (width - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "file string, sheet string, row_no int, cells array<string>")


BANDS = ["Zero to less than $50k", "$50k to less than $200k", "$200k to less than $2m", "$2m to less than $5m", "$5m to less than $10m", "$10m or more", "Total"]


def business_rows(bands):
    return [["Counts"], ["note"], ["Industry", "Industry", "SA2", "SA2", *bands], [None, None, None, None, *["count"] * 7],
            ["C", "Making things", "117031330", "Northbank", 7, 3, 2, 1, 1, 0, 14], ["Y", "Other", "117031330", "Northbank", 2, 0, 0, 0, 0, 0, 2],
            ["C", "Making things", "305021114", "Elsewhere", 5, 0, 0, 0, 0, 0, 5]]


def test_business_sheet(spark):
    kept, dropped = sheets.clean_businesses(grid(spark, business_rows(BANDS)))
    assert [(r["industry_code"], r["SA2_CODE21"], r["0_to_50k_businesses"], r["total_businesses"]) for r in kept.collect()] == [("C", 117031330, 7, 14)]
    assert dropped.first()["dropped_rows"] == 1
    with pytest.raises(sheets.LayoutError, match="200k_to_2m"):
        sheets.clean_businesses(grid(spark, business_rows([*BANDS[:2], "$200k to less than $1m", *BANDS[3:]])))
    with pytest.raises(sheets.LayoutError, match="no sheet"):
        sheets.clean_businesses(grid(spark, [["nothing"]]))


def test_newest_turnover_sheet_and_titles(spark):
    both = grid(spark, [["by Turnover Size Ranges, June 2021"], ["x"]], "p").unionByName(grid(spark, [["note: June 2023"], ["Turnover Size Ranges, June 2022"]], "q"))
    assert tuple(sheets.newest_turnover_sheet(both).first()) == ("f", "q", 2022)
    assert [r["sheet"] for r in sheets.titled_sheets(both, ["june 2023", "turnover"], 2).collect()] == ["q"]
    old, new = business_rows(BANDS), business_rows(BANDS)
    old[0], new[0], new[4][4] = ["Turnover, June 2020"], ["Turnover, June 2024"], 99
    kept, _ = sheets.newest_businesses(grid(spark, old, "a").unionByName(grid(spark, new, "b")))
    assert [r["0_to_50k_businesses"] for r in kept.collect()] == [99]


def income_rows(order):
    titles = {"Earners": "Earners (persons)", "Median age": "Median age of earners", "Median (": "Median ($)", "Mean (": "Mean ($)"}
    values = {"Earners": ("812", "1,903"), "Median age": (44, 45), "Median (": ("51,200", "53,750"), "Mean (": ("n/a", "..")}
    head, years, row = [None, None], ["SA2", "Name"], ["118011339", "Hilltop"]
    for label in order:
        head += [titles[label], None]
        years += ["2017-18", "2018-19"]
        row += values[label]
    return [head, years, row, ["401011001", "Far", *[1] * 8]]


def test_income_sheets_each_by_their_own_header(spark):
    first, turned = list(sheets.INCOME_GROUPS), list(sheets.INCOME_GROUPS)[::-1]
    pile = grid(spark, income_rows(first), "a").unionByName(grid(spark, [["title"], ["x"], *income_rows(turned)], "b"))
    frame, year = sheets.clean_income(pile)
    assert year == "2018-19" and [tuple(r) for r in frame.collect()] == [(118011339, "Hilltop", 1903, 45, 53750, None)] * 2
    assert {r["median_age"] for r in sheets.clean_income(pile, "2017-18")[0].collect()} == {44}
    with pytest.raises(sheets.LayoutError, match="mean_income"):
        sheets.clean_income(grid(spark, income_rows(first[:3])))


def test_population_sheet(spark):
    from arealytics.functions.cells import AGE_BANDS
    heads = [b.replace("-and-over", " and over").replace("-", "–") for b in AGE_BANDS]
    rows = [["People"], [None, None, None, *heads, "Total persons"], ["GCCSA code", "SA2 code", "SA2 name", *["no."] * 19],
            ["1GSYD", "119041381", "Quayside", *range(5, 23), 243], ["1RNSW", "112021249", "Inland", *range(18), 153]]
    turned = [[r[2], r[0], r[1], *r[3:]] if len(r) > 3 else r for r in rows]
    turned[3][1:3], turned[3][0] = ["1GSYD", "119041382"], "Wharf"
    out = sheets.clean_population(grid(spark, rows).unionByName(grid(spark, turned, "t"))).orderBy("SA2_CODE21").collect()
    assert [(r["SA2_CODE21"], r["sa2_name"], r["85-and-over_people"], r["total_people"]) for r in out] == [(119041381, "Quayside", 22, 243), (119041382, "Wharf", 22, 243)]
    with pytest.raises(sheets.LayoutError, match="85-and-over"):
        sheets.clean_population(grid(spark, [rows[0], [*rows[1][:20], None, "Total"], *rows[2:]]))


def test_mesh_block_sheets_with_columns_in_another_order(spark):
    one = [["Table 9"], ["MB_CODE_2021", "MB_CATEGORY_NAME_2021", "AREA_ALBERS_SQKM", "Dwelling", "Person"], ["11205490000", "Parkland", 0.5, 3, 8], ["total", None, 0.5, 3, 8]]
    two = [["MB_CODE_2021", "Person", "Dwelling", "AREA_ALBERS_SQKM", "MB_CATEGORY_NAME_2021"], ["11205500000", 21, 9, 0.25, "Residential"]]
    found = sheets.clean_mesh_counts(grid(spark, one).unionByName(grid(spark, two, "t"))).orderBy("MB_CODE21").collect()
    assert [(r["MB_CODE21"], r["category"], r["dwellings"], r["persons"]) for r in found] == [(11205490000, "Parkland", 3, 8), (11205500000, "Residential", 9, 21)]
    places = [["MB_CODE_2021", "GCCSA_CODE_2021", "SA1_CODE_2021", "SA2_CODE_2021"], ["11205490000", "1GSYD", "11703132801", "117031328"], ["10205490000", "1RNSW", "10703132801", "107031328"]]
    assert [tuple(r) for r in sheets.clean_mesh_allocation(grid(spark, places)).collect()] == [(11205490000, 11703132801, 117031328)]
    with pytest.raises(sheets.LayoutError, match="no sheet"):
        sheets.clean_mesh_counts(grid(spark, [["some", "other", "sheet"]]))


def test_traffic_light_sheet(spark):
    rows = [["Traffic lights"], ["Equipment ID", "Asset Type", "Suburb", "Long", "Latitude", None, "Suburb", "Date Install"],
            ["7", "VEH", "SYDNEY ", "151.2", "-33.8", "z", "b", "2020-01-02"], [None] * 8, ["8", "Signal", "", "1501", "-33.8", None, "b", "soon"]]
    raw = sheets.table_from_header(grid(spark, rows), ["latitude", "longitude"], tables.cells.snake_name)
    assert raw.columns == ["equipment_id", "asset_type", "suburb", "longitude", "latitude", "col5", "date_install"]
    out = tables.dated_installs(tables.clean_traffic_lights(raw)).orderBy("equipment_id").collect()
    assert [(r["asset_type"], r["suburb"], r["lon"]) for r in out] == [("Vehicle", "SYDNEY", 151.2), ("Signal", None, None)]
    assert out[0]["date_install"].year == 2020 and out[1]["date_install"] is None


def test_titled_csv_and_polling_places(spark, tmp_path):
    head = [*tables.PLACE_NAMES, "Latitude", "Longitude"]
    rows = [["NSW", "1", "N", "10", "2", "P", "", "", "", "", "S", "2000", "-33.8", "151.2"], ["NSW", "1", "N", "11", "2", '"P, Q"', "", "", "", "", "S", "", "0", "0"],
            ["VIC", "1", "N", "12", "2", "P", "", "", "", "", "S", "3000", "-37.8", "145"]]
    text = "﻿2025 Federal Election [Event Generated:2025-06-12T10:00]\n" + "\n".join(",".join(r) for r in [head, *rows]) + "\n"
    path = tmp_path / "places.csv"
    path.write_text(text, encoding="utf-8")
    raw, release = files.read_titled_csv(spark, str(path), head)
    assert release.first()["release"] == "2025 Federal Election, generated 2025-06-12"
    out = {r["polling_place_id"]: r for r in tables.clean_polling_places(raw).collect()}
    assert sorted(out) == [10, 11] and out[10]["lon"] == 151.2 and out[11]["lon"] is None
    assert out[11]["polling_place_name"] == "P, Q" and out[11]["premises_post_code"] is None and out[10]["premises_name"] == ""


def test_stops_from_files_with_different_headers(spark, tmp_path):
    for folder, text in (("a", "stop_id,stop_name,stop_lat,stop_lon,location_type\n1,One,-33.8,151.2,\n2,Two,30,151.2,1\n"),
                         ("b", "stop_name,stop_id,stop_code,stop_lat,stop_lon\nLater,1,c1,-33.7,151.1\nThree,3,c3,-33.6,151\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "stops.txt").write_text("﻿" + text, encoding="utf-8")
        (tmp_path / folder / "feed_info.txt").write_text("feed_version,feed_start_date\n" + ("" if folder == "a" else "v2,20260101\n"))
    raw = files.read_csv_union(spark, str(tmp_path), "stops.txt")
    out = {r["stop_id"]: r for r in tables.clean_stops(files.first_stop_rows(raw)).collect()}
    assert sorted(out) == ["1", "2", "3"] and out["1"]["stop_name"] == "One" and out["3"]["stop_code"] == "c3"
    assert (out["1"]["location_type"], out["2"]["location_type"], out["2"]["lon"], out["3"]["location_type"]) == (0, 1, None, 0)
    assert files.feed_release(spark, str(tmp_path)).first()["release"] == "feed v2 20260101"


def features():
    return [{"type": "Feature", "properties": {"OBJECTID": 1, "No_Steps": 5}, "geometry": {"type": "Point", "coordinates": [151.2, -33.87]}},
            {"type": "Feature", "properties": {"OBJECTID": 2, "No_Steps": None}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {"type": "Feature", "properties": {"OBJECTID": 3, "No_Steps": 7}, "geometry": None}]


def test_csv_quotes_and_header_order(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,stop_lat,stop_lon\n1,"Pier ""B"" Rd, stand 4",-33,151\n')
    assert [tuple(r)[:4] for r in files.read_csv_union(spark, str(tmp_path), "stops.txt").collect()] == [("1", 'Pier "B" Rd, stand 4', "-33", "151")]
    lines = spark.createDataFrame([("Vote [Event Generated:2024-03-01T1]",), ("b,extra,a",), ('"x ""y"", z",,7',), (",,8",)], "value string")
    rows, release = files.titled_rows(lines, ["a", "b"])
    assert sorted(map(tuple, rows.collect())) == [("7", 'x "y", z'), ("8", "")] and release.first()[0] == "Vote, generated 2024-03-01"
    with pytest.raises(ValueError, match="no line names"):
        files.titled_rows(lines, ["a", "gone"])


@pytest.mark.parametrize("indent", [None, 1])
def test_geojson_layouts_lose_nothing(spark, tmp_path, indent):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features()}, indent=indent))
    (tmp_path / "b.geojson").write_text("\n".join(json.dumps(f) for f in features()))
    assert files.read_geojson(spark, str(tmp_path), {"objectid": "bigint"}).filter("objectid > 0").count() == 6


@pytest.mark.parametrize("whole", [True, False])
def test_geojson(spark, tmp_path, whole):
    path = tmp_path / "layer.geojson"
    items = [json.dumps(f) for f in features()]
    path.write_text('{"type": "FeatureCollection", "features": [' + ((", " if whole else ",\n").join(items) if whole else "\n" + ",\n".join(items) + "\n") + "]}\n")
    out = files.read_geojson(spark, str(path), {"objectid": "bigint", "no_steps": "bigint"}, whole=whole).orderBy("objectid").collect()
    assert [(r["objectid"], r["no_steps"], r["lon"]) for r in out] == [(1, 5, 151.2), (2, None, None), (3, 7, None)]
    assert [(p["x"], p["y"]) for p in out[1]["geom"][0][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_manifest_states(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "data.csv").write_text("a,b\n1,2\n")
    (raw / "other.csv").write_text("a,b\n1,3\n")
    right = hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    record = {n: {"release": "r", "url": "u", "retrieved_at": "2026-09-25T00:00:00Z", "files": {"main": {"path": f"{n}.csv", "sha256": right}}}
              for n in ("data", "other", "gone")}
    (tmp_path / "manifest.json").write_text(json.dumps({"schema": 1, "sources": record}))
    checked = files.check_files(spark, str(raw), files.read_manifest(spark, str(tmp_path / "manifest.json")))
    assert {r["source_id"]: r["status"] for r in checked.collect()} == {"data": "ok", "other": "changed", "gone": "missing"}
    refused = {r["source_id"]: r["refused"] for r in files.accepted_sources(checked).collect()}
    assert refused["data"] is None and "checksum" in refused["other"] and "missing" in refused["gone"]


def test_feature_scan_reaches_the_parquet_filter(spark, tmp_path):
    frame = spark.range(1000).selectExpr("id", "cast(id as double) minx", "cast(id as double) maxx", "0D miny", "0D maxy", "if(id % 2 = 0, 'trunk', 'track') highway")
    frame.write.parquet(str(tmp_path / "roads"))
    found = files.read_features(spark, str(tmp_path / "roads"), (10, -1, 20, 1), F.col("highway") == "trunk", ["id"])
    assert sorted(r["id"] for r in found.collect()) == [10, 12, 14, 16, 18, 20]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(maxx,10.0)" in plan and "EqualTo(highway,trunk)" in plan


def test_map_features(spark):
    points = spark.createDataFrame([("1", None, "WC", '"amenity"=>"toilets"', 151.0, -33.0), ("2", "crossing", None, '"crossing"=>"marked","crossing:markings"=>"zebra"', 151.0, -33.0),
                                    ("3", "crossing", None, None, 151.0, -33.0)], "osm_id string, highway string, name string, other_tags string, lon double, lat double")
    assert [tuple(r)[:2] for r in tables.clean_amenities(points).collect()] == [("1", "toilets")]
    assert [(r["osm_id"], r["is_zebra"]) for r in tables.clean_crossings(points).orderBy("osm_id").collect()] == [("2", True), ("3", False)]
    nodes = points.withColumn("other_tags", F.lit('"shop"=>"supermarket"')).limit(1)
    shape = polygons(spark, [(9, box(151.0, -33.01, 151.02, -33.0))]).selectExpr(
        "id osm_id", "cast(null as long) osm_way_id", "cast(null as string) shop", "'fuel' amenity", "'F' name", "cast(null as string) other_tags", "geom")
    shops = {r["osm_id"]: r for r in tables.clean_shops(nodes, shape).collect()}
    assert shops["n1"]["kind"] == "supermarket" and shops["r9"]["mapped_as"] == "area"
    assert abs(shops["r9"]["lon"] - 151.01) < 1e-4 and abs(shops["r9"]["lat"] + 33.005) < 1e-4


def test_staged_and_loaded_tables(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b"), (1, None)], "id long, name string")
    sinks.write_staged(frame, str(tmp_path), "one")
    sinks.write_staged(frame, str(tmp_path), "two", csv=True)
    assert files.read_staged(spark, str(tmp_path), "one").count() == 2
    assert files.read_staged(spark, str(tmp_path), "two").columns == ["id", "name"]
    assert files.read_staged(spark, str(tmp_path), "three") is None
    assert files.read_staged(spark, str(tmp_path), "three", {"three": frame}) is frame
    problems = sinks.load_tables({"loaded_one": frame, "bad name": frame}, {"loaded_one": sinks.table_comment("It's one", "r1", "2026-01-01T00", "CC")})
    assert list(problems) == ["bad name"] and spark.table("loaded_one").count() == 2
    sinks.write_sorted(frame, str(tmp_path / "sorted"), ["id"])
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "sorted")).collect()] == [1, 2]
    for day in (1, 2, 2):  # a run that is logged again replaces its own records
        sinks.append_quality(frame, str(tmp_path / "log"), f"2026-01-0{day} 00:00:00")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_flat_layer_splits_a_hot_tile(spark):
    points = spark.range(1000).selectExpr("id", "1.0D x", "2.0D y", "if(id % 10 = 0, 'near', 'counted') place")
    rows = sinks.flat_layer(points, 1.0, chunk=100).collect()
    assert sum(len(r["coordinates"]) for r in rows) == 2000 and max(len(r["coordinates"]) for r in rows) < 250
    assert sinks.outside_total(points).first()[0] == 100
    crowd = spark.range(5000).selectExpr("id", "if(id < 2500, 1.0D, id * 1.0D) x", "2.0D y", "'counted' place")
    rows = sinks.flat_layer(crowd, 1.0, chunk=100, slices=16).collect()
    assert sum(len(r["coordinates"]) for r in rows) == 10_000 and max(len(r["coordinates"]) for r in rows) == 200
    assert sorted((r["part"], len(r["coordinates"])) for r in rows if r["tile_col"] == 1) == [(i, 200) for i in range(25)]


def test_records_over_line_breaks_at_split_borders(spark, tmp_path):
    import csv
    import random
    rng = random.Random(3)
    want = {}
    for f, head in enumerate((["a", "b", "c"], ["c", "a"], ["b, x", "a"], ["a"])):
        rows = [["".join(rng.choice(["x", "é", ",", '"', "\n", "\r\n", " ", "long text "]) for _ in range(rng.randrange(0, 30))) for _ in head] for _ in range(60)]
        with open(tmp_path / f"f{f}.csv", "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\r\n" if f % 2 else "\n", quoting=csv.QUOTE_ALL if f == 3 else csv.QUOTE_MINIMAL).writerows([head, *rows])
        want[f] = [dict(zip(head, r)) for r in rows]
    (tmp_path / "none.csv").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = files.read_csv_union(spark, str(tmp_path), "*.CSV").collect()
            assert set(found[0].asDict()) == {"a", "b", "c", "b, x", *files.FILE_ORDER}
            for f, rows in want.items():
                own = sorted((r for r in found if r["file_path"].endswith(f"f{f}.csv")), key=lambda r: (r["file_block"], r["file_row"]))
                assert [{k: v for k, v in r.asDict().items() if k not in files.FILE_ORDER and v is not None} for r in own] == rows, (size, f)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_number_of_jobs_does_not_grow_with_the_files(spark, tmp_path):
    jobs = []
    for n in (2, 12):
        (tmp_path / str(n)).mkdir()
        for i in range(n):
            (tmp_path / str(n) / f"{i}.txt").write_text(f"a,b{i % 2}\n1,2\n")
        spark.sparkContext.setJobGroup(f"files {n}", "")
        assert files.read_csv_union(spark, str(tmp_path / str(n)), "*.txt").count() == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files {n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_a_failed_run_leaves_the_release_and_a_repeated_one_the_log(spark, tmp_path):
    frame, folder = spark.createDataFrame([(1, "a")], "id long, name string"), str(tmp_path / "out")
    assert releases.current_run(spark, folder) is None and releases.read_release(spark, folder, "one") is None
    releases.publish(spark, {"one": frame, "two": frame}, folder, "r1")
    broken = frame.select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        releases.publish(spark, {"one": frame.limit(0), "two": broken}, folder, "r2")
    assert releases.current_run(spark, folder) == "r1" and releases.read_release(spark, folder, "one").count() == 1
    releases.publish(spark, {"one": frame.limit(0), "two": frame}, folder, "r3")
    assert (releases.current_run(spark, folder), releases.read_release(spark, folder, "one").count()) == ("r3", 0)
    for run in ("r1", "r2", "r2"):
        releases.log_run(frame, str(tmp_path / "log"), run)
    assert sorted(r["run"] for r in releases.read_log(spark, str(tmp_path / "log")).collect()) == ["r1", "r2"]
    for wrong in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            releases.publish(spark, {"one": frame}, folder, wrong)


def test_features_of_one_long_line_over_many_splits(spark, tmp_path):
    import random
    rng = random.Random(1)
    tricky = ['}', '{', '"', '\\', '\\"}{', 'a } b', '{"type": "Feature"}', 'é {', "", '\\\\', "FeatureCollection"]
    made = {}
    for f in range(6):
        rows = [{"type": "Feature", "id": rng.choice(tricky), "properties": {"Code": 1000 * f + i, "name": "".join(rng.choice(tricky) for _ in range(3)), "deep": {"a": {"b": rng.choice(tricky)}}},
                 "geometry": rng.choice([None, {"type": "Point", "coordinates": [i, f]}])} for i in range(40)]
        made.update({r["properties"]["Code"]: r["properties"]["name"] for r in rows})
        if f < 4:
            document = {"type": "FeatureCollection", "name": "x } { y", "crs": {"type": "name", "properties": {"name": "c"}}, "features": rows, "after": {"k": "}"}}
            text = json.dumps(document, indent=f // 2 * 2 or None, ensure_ascii=f % 2 == 0) + ("\n" if f else "")
        else:
            text = "\n".join(json.dumps(r, indent=f % 2 or None) for r in rows)
        (tmp_path / f"{f}.geojson").write_text(("﻿" if f == 1 else "") + text, encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("301b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = files.read_geojson(spark, str(tmp_path), {"code": "bigint", "name": "string"}).collect()
            assert sorted(r["code"] for r in got) == sorted(made) and all(made[r["code"]] == r["name"] for r in got), size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_digests_of_files_cut_over_splits(spark, tmp_path):
    import os
    from arealytics.sources import pieces
    contents = {"a": b"", "b": b"\n", "c": b"x", "d": b"x\n", "e": b"\n\nx\r\n\n", "f": os.urandom(50_000), "g": b"long " * 40_000, "sub/h": b"\xff\xfe\n" * 3000}
    (tmp_path / "sub").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["path"].split(tmp_path.name + "/")[1]: r["sha256"] for r in pieces.file_digests(spark, str(tmp_path)).collect()}
            assert got == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
