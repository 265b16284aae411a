"""Shares that lie exactly between two rounded values."""
from pyspark.sql import functions as F


def test_a_trace_below_a_tie_does_not_decide_its_rounding(spark, monkeypatch):
    from arealytics.plans import spatial_queries as q
    shares = spark.createDataFrame([(1, 2, 0.0078125 - 1e-15), (1, 3, 0.0078125 + 1e-15)], "id long, area_code long, area_share double")
    monkeypatch.setattr(q.joins, "area_shares", lambda *a, **k: shares)
    rows = q.area_shares_crossed(spark, "/root/testdata/sf0.001").select(F.col("area_share")).collect()
    assert [r["area_share"] for r in rows] == [0.007813, 0.007813]
