"""What the step of polygon shares costs: short generated methods, no pieces where nothing can meet them, and the same shares."""
from pyspark.sql import functions as F

from arealytics.functions import geometry as geo
from arealytics.operators import areas, tiling

MOST_BYTES = 8000  # the JVM leaves longer methods uncompiled


def layers(spark):
    small = spark.range(40).select(F.col("id").alias("pid"), F.lit(1.0).alias("whole"), geo.rectangle(F.col("id") / 7, F.col("id") / 5, F.col("id") / 7 + 0.3, F.col("id") / 5 + 0.4).alias("geom"))
    large = spark.range(4).select(F.col("id").alias("code"), geo.rectangle(F.col("id") * 2, F.lit(0), F.col("id") * 2 + 2, F.lit(9)).alias("geom"))
    return small, large


def test_generated_methods_of_pieces_are_short_enough_to_be_compiled(spark):
    small, _ = layers(spark)
    pieces = areas.polygon_pieces(tiling.tile_layer(small, "pid", "geom", ["whole"]), "pid", [2], ["whole"])
    # Without adaptive planning the whole plan is there before it runs.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pieces.select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan)
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and max(sizes) < MOST_BYTES


def test_levels_that_the_other_layer_lacks_have_no_pieces(spark):
    small, large = layers(spark)
    left, right = tiling.tile_layer(small, "pid", "geom"), tiling.tile_layer(large, "code", "geom")
    (fine, coarse) = (tiling.levels_of(layer[0]) for layer in (left, right))
    assert max(fine) < min(coarse)
    made = areas.polygon_pieces(left, "pid", coarse, [], meeting=True)
    assert {r["level"] for r in made.select("level").distinct().collect()} == set(coarse)
    shares = {(r["pid"], r["area_code"]): r["area_share"] for r in areas.area_shares(small, large, "pid").collect()}
    want = {}
    for i in range(40):
        for c in range(4):
            wide = min(i / 7 + 0.3, 2 * c + 2) - max(i / 7, 2 * c)
            high = min(i / 5 + 0.4, 9) - i / 5
            if wide > 1e-9 and high > 1e-9:
                want[i, c] = wide * high / 0.12
    assert shares.keys() == want.keys() and all(abs(shares[k] - want[k]) < 1e-9 for k in want)


def test_features_without_an_extent_are_left_out(spark):
    frame = spark.createDataFrame([(1, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]), (2, [[[(3.0, 3.0), (3.0, 3.0), (3.0, 3.0), (3.0, 3.0)]]]), (3, None), (4, [])],
                                  f"id long, geom {geo.POLYGON_TYPE}")
    features, edges = tiling.tile_layer(frame, "id", "geom")
    assert [r["id"] for r in features.collect()] == [1] and {r["id"] for r in edges.collect()} == {1}
    assert [r["a"] for r in frame.orderBy("id").select(geo.polygon_area(F.col("geom")).alias("a")).collect()] == [0.5, 0.0, None, 0.0]
