from pyspark.sql import functions as F

from arealytics.operators import contracts, relate
from arealytics.operators.contracts import Check
from arealytics.plans.contracts import CONTRACTS, KEYS, TURNOVER_COUNTS
from arealytics.plans import source_checks
from shapes import polygons, box


def businesses(spark, codes=("A", "G"), last=9, rename=None):
    columns = ["industry_code", "industry_name", "SA2_CODE21", "sa2_name", *TURNOVER_COUNTS]
    rows = [(c, "Name", 101021007, "Braidwood", *([5 if i == 0 else 9] * 6), 5 if i == 0 else last) for i, c in enumerate(codes)]
    schema = ", ".join(f"`{c}` {'string' if 'name' in c or c == 'industry_code' else 'long'}" for c in columns)
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumnsRenamed(rename) if rename else frame


def record(name, frame):
    failures = contracts.contract_failures(frame, CONTRACTS[name], name)
    return contracts.contract_record(failures, contracts.profile(frame, name, KEYS.get(name, [])), name).first()


def lights(spark, types=("Vehicle", "Pedestrian"), lons=(151.2, 151.3), lats=(-33.8, -33.9)):
    rows = [(t, i + 1, "SYDNEY", lon, lat) for i, (t, lon, lat) in enumerate(zip(types, lons, lats))]
    return spark.createDataFrame(rows, "asset_type string, equipment_id long, suburb string, lon double, lat double")


def test_good_tables_pass(spark):
    assert record("businesses", businesses(spark))["status"] == "PASS"
    assert record("traffic_lights", lights(spark))["status"] == "PASS"  # publisher columns are kept


def test_broken_tables_fail_and_name_the_column(spark):
    for frame, column in ((businesses(spark, codes=("A", "T")), "industry_code"), (businesses(spark, last=-3), "total_businesses"),
                          (businesses(spark, rename={"total_businesses": "total"}), "total_businesses"), (businesses(spark, codes=("A", "A")), "unique industry_code")):
        found = record("businesses", frame)
        assert found["status"] == "FAIL" and column in found["notes"], found
    assert "asset_type" in record("traffic_lights", lights(spark, types=("Vehicle", "Signal")))["notes"]
    assert record("traffic_lights", lights(spark, lons=(151.2, -30.5), lats=(-33.8, 30.5)))["status"] == "FAIL"
    assert record("traffic_lights", lights(spark, lons=(151.2, None), lats=(-33.8, None)))["status"] == "PASS"


def test_suppressed_income_passes_and_implausible_income_fails(spark):
    schema = "SA2_CODE21 long, sa2_name string, earners long, median_age long, median_income long, mean_income long"
    rows = [(101021007, "Braidwood", 2467, 51, 46640, 68904), (101021008, "Karabar", None, None, None, None)]
    assert record("income", spark.createDataFrame(rows, schema))["status"] == "PASS"
    rows[0] = (101021007, "Braidwood", 2467, 51, 4_600_000, 68904)
    assert "median_income" in record("income", spark.createDataFrame(rows, schema))["notes"]


def test_stop_types_follow_the_specification(spark):
    schema = ("stop_id string, stop_name string, stop_code string, parent_station string, platform_code string, location_type long, "
              "wheelchair_boarding long, lon double, lat double")
    for kind, status in ((1, "PASS"), (9, "FAIL")):
        rows = [("a", "One", None, None, None, 0, 0, 151.2, -33.8), ("b", "Two", None, "a", None, kind, None, 151.3, -33.9)]
        assert record("stops", spark.createDataFrame(rows, schema))["status"] == status


def test_profile_counts_rows_empty_cells_and_duplicates(spark):
    twice = businesses(spark).unionByName(businesses(spark))
    found = contracts.profile(twice, "businesses", KEYS["businesses"]).first()
    assert (found["rows"], found["columns"], found["missing_values"], found["duplicate_keys"]) == (4, 11, 0, 2)
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "k string, v int")
    found = contracts.profile(nulls, "x", ["k"]).first()
    assert (found["missing_values"], found["duplicate_keys"]) == (3, 1)


def test_record_status_follows_the_worst_issue(spark):
    frame = businesses(spark)
    profiles = contracts.profile(frame, "businesses")

    def status(*levels):
        checks = [Check(F.count(F.lit(1)), f"{level} {{value}}", level=level, high=0) for level in levels]
        issues = contracts.run_checks(frame, "abs", checks) if checks else spark.createDataFrame([], contracts.ISSUE)
        return contracts.issue_record(issues, profiles, "abs").first()
    assert status()["status"] == "PASS" and status()["notes"] == "ok"
    assert status("warn")["status"] == "WARNING"
    worst = status("warn", "error")
    assert worst["status"] == "FAIL" and worst["notes"] == "warn 2; error 2"
    assert not contracts.passes(contracts.issue_record(contracts.run_checks(frame, "abs", [Check(F.count(F.lit(1)), "x", high=0)]), profiles, "abs"))


def test_share_of_unplaced_points(spark):
    frame = spark.range(200).select(F.when(F.col("id") > 0, 1.0).alias("lon"), F.lit(1.0).alias("lat"))
    assert contracts.placed_share(frame, "d", "stops").first()["level"] == "warn"
    assert contracts.placed_share(frame.limit(50), "d", "stops").first()["level"] == "error"
    assert contracts.placed_share(frame.filter("lon is not null"), "d", "stops").count() == 0


def test_reconcile_and_coverage(spark):
    frame = spark.createDataFrame([(1, 5, 5, 10), (2, 5, None, 12)], "id int, a int, b int, total int")
    assert [r["id"] for r in contracts.reconcile(frame, ["a", "b"], "total").collect()] == [2]
    found = relate.coverage(frame.select("id"), spark.createDataFrame([(2,), (3,), (4,)], "id int"), "id").first()
    assert (found["missing"], found["unknown"]) == (2, 1)


def test_future_rows_replace_current_ones(spark):
    schema = "k int, kind string, info string"
    current = spark.createDataFrame([(1, "P", "a"), (2, "P", "b"), (2, "S", "c"), (3, "S", "d")], schema)
    future = spark.createDataFrame([(2, None, "n1"), (2, "X", None), (9, "X", "z")], schema)
    out = relate.replace_by_key(current, future, "k", ["kind", "info"], [F.col("kind")])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "P", "a"), (2, "P", "n1"), (2, "X", "b"), (3, "S", "d")]


def test_source_checks_skip_coverage_without_boundaries(spark):
    issues = [(r["level"], r["message"]) for r in source_checks.check_businesses(businesses(spark), None).collect()]
    assert ("error", "the industry letters are not A to S") in issues and ("error", "too few areas of the state: 1") in issues
    assert any(level == "warn" and "coverage is unchecked" in m for level, m in issues)


def test_boundary_and_layer_checks(spark):
    layer = polygons(spark, [(101021007, box(151.0, -33.9, 151.1, -33.8)), (101021007, box(151.1, -33.9, 151.2, -33.8))], "SA2_CODE21")
    messages = [r["message"] for r in source_checks.check_boundaries(layer).collect()]
    assert messages == ["2 areas instead of 373", "duplicate area codes"]
    trees = spark.createDataFrame([(1, 151.2, -33.8), (2, 151.2, -33.8)], "objectid long, lon double, lat double")
    issues = source_checks.check_local_layer(trees, "cos_trees")
    assert ["too few cos_trees: 2"] == [r["message"] for r in issues.collect()]
    records = source_checks.assess("cos_trees", {"cos_trees": trees}, issues).collect()
    assert [(r["dataset"], r["status"]) for r in records] == [("cos_trees", "FAIL"), ("contract:cos_trees", "PASS")]


def test_a_failed_source_is_not_written(spark, tmp_path):
    from arealytics.sources import releases, sinks, tables
    frame = businesses(spark)
    profiles = contracts.profile(frame, "businesses")
    for limit, written in ((0, False), (9, True)):
        issues = contracts.run_checks(frame, "businesses", [Check(F.count(F.lit(1)), "{value} rows", high=limit)])
        assert sinks.gated_write(contracts.issue_record(issues, profiles, "businesses"), {"businesses": frame}, str(tmp_path)) is written
        assert (releases.read_release(spark, str(tmp_path), "businesses") is not None) is written
    metrics = relate.stack_tables(tables.source_metrics("abs", frame), tables.source_metrics("abs", frame, "industry_code"))
    assert sorted((r["metric"], r["value"]) for r in metrics.collect()) == [("industry_code=A", 1), ("industry_code=G", 1), ("rows", 2)]
    assert sinks.run_report(spark, [("abs", "ok", 1.5, None)]).first()["status"] == "ok"
