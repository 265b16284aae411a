"""Work is dealt to tasks, big frames are not broadcast, and convex rings are told apart."""
import pytest
from pyspark.sql import functions as F

from arealytics.functions import geometry as geo
from arealytics.operators import spatial_stats, tiling
from arealytics.session import durable_rows
from shapes import box, polygons, ring


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_durable_rows_are_joined_by_shuffles_whatever_the_planner_guesses(spark):
    rows = durable_rows(spark.range(100).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(5)))))
    text = plan(spark.range(100).join(rows.filter("x > 2").select("id"), "id"))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_rings_and_edges_of_one_small_file_are_dealt_to_many_tasks(spark):
    layer = polygons(spark, [(i, box(i, 0, i + 1, 1)) for i in range(200)]).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, edges = tiling.tile_layer(layer, "id", "geom")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert edges.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("shape, convex", [
    (box(0, 0, 1, 1), True), ([[ring((0, 0), (0, 1), (1, 1), (1, 0))]], True), ([[ring((0, 0), (1, 0), (2, 0), (2, 2))]], True),
    ([[ring((0, 0), (2, 2), (2, 0), (0, 2))]], False), ([[ring((0, 0), (1, 1))]], False), ([[ring((0, 0), (4, 0), (4, 4), (2, 1))]], False),
    ([[ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1), (0, 1))]], False), ([[ring((0, 0), (3, 0), (1, 2), (0.5, -1), (2, 2.5))]], False),
    ([[ring((0, 0), (9, 0), (9, 9)), ring((5, 1), (6, 1), (6, 2))]], False), (box(0, 0, 1, 1) + box(0, 0, 1, 1), False), ([], False)])
def test_only_rings_that_turn_one_way_once_are_convex(spark, shape, convex):
    assert polygons(spark, [(1, shape)]).select(geo.is_convex(F.col("geom"))).first()[0] is convex


def test_places_of_all_replicates_are_worked_out_in_blocks_by_many_tasks(spark):
    n = 300
    places = spark.range(1, n + 1).select(F.col("id").alias("place"), (F.col("id") / 7).alias("z")).coalesce(1)
    keys = spatial_stats.replicate_keys(spark, 5, 3)
    drawn = spatial_stats._drawn(places, n, keys)
    assert "MapInArrow" in plan(drawn) and drawn.select(F.spark_partition_id()).distinct().count() > 4
    moved = spatial_stats.shuffled_place(F.col("place") - 1, n, F.col("keys")) + 1
    wanted = places.crossJoin(keys).select("rep", moved.alias("place"), "z")
    assert drawn.exceptAll(wanted).count() == 0 and drawn.count() == 5 * n
