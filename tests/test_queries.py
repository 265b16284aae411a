"""Registered queries against DuckDB, and the shape of their plans."""
import pytest

import __spark_entry__ as entry
from arealytics.plans import registered
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
CHECKED = ["index_scores", "index_variants", "entropy_by_area", "quantile_values", "spearman", "histogram_bins", "equity_share", "points_to_areas",
           "assign_polygons", "street_intersections", "contiguity", "morans_global", "morans_p", "hotspot_labels", "contract_report", "profile_table",
           "replace_by_key", "to_int_cells", "hstore_tags", "clean_codes", "percent_rank_phrase", "two_level_header", "multi_sheet_mesh", "newest_sheet", "population_sheet", "titled_csv", "geojson_features", "manifest_pages", "points_nested_areas", "feature_json", "flat_layer"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_but_the_file_check_has_an_oracle():
    queries, oracle = registered()
    assert set(queries) - set(oracle) == {"manifest_check"} and len(queries) >= 90
    assert set(queries) <= set(entry.queries())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entropy_by_area", "points_to_areas", "street_intersections", "to_int_cells", "replace_by_key", "area_shares"])
def test_plans_have_no_python_no_cross_join_and_no_single_task(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text, bad


def test_a_global_rank_gathers_only_one_row_per_partition(spark):
    lines = plan(entry.queries()["global_rank_quintile"](spark, SF)).splitlines()
    gathered = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(gathered) == 1 and "HashAggregate(keys=[_part" in lines[gathered[0] + 1]


def test_points_are_not_shuffled_when_the_area_index_is_small(spark):
    text = plan(entry.queries()["points_to_areas"](spark, SF))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_box_filter_is_pushed_to_the_scan(spark):
    text = plan(entry.queries()["bbox_scan"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in text and "LessThanOrEqual(o_custkey,900)" in text
