import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from arealytics.functions import scores
from arealytics.operators import ranking, reports, scoring


def frame_of(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} double")


def test_entropy(spark):
    rows = [("even", 0.25)] * 4 + [("one", 1.0), ("one", 0.0), ("one", None), ("none", 0.0), ("none", float("nan")), ("skew", 3.0), ("skew", 1.0)]
    found = {r["a"]: r["entropy"] for r in scoring.normalised_entropy(spark.createDataFrame(rows, "a string, v double"), "a", "v", 4).collect()}
    assert found["even"] == pytest.approx(1) and found["one"] == 0 and found["none"] is None
    assert found["skew"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(4))
    assert scoring.normalised_entropy(spark.createDataFrame(rows[:1], "a string, v double"), "a", "v", 1).first()["entropy"] is None


def test_zscores_and_display_scores(spark):
    z = [r["v_z"] for r in scoring.zscores(frame_of(spark, [1.0, 2.0, 3.0, 4.0]), ["v"]).collect()]
    assert statistics.fmean(z) == pytest.approx(0) and statistics.pstdev(z) == pytest.approx(1)
    shown = [r["s"] for r in scoring.standardised_scores(frame_of(spark, [1.0, 2.0, 3.0, None]), {"v": "s"}).orderBy("id").collect()]
    assert shown[3] is None and statistics.fmean(shown[:3]) == pytest.approx(100) and statistics.pstdev(shown[:3]) == pytest.approx(10)
    flat = scoring.zscores(frame_of(spark, [2.0, 2.0]), ["v"]).collect()
    assert [r["v_z"] for r in flat] == [None, None]
    assert [r["v"] for r in scoring.scale_indicators(frame_of(spark, [2.0, 2.0]), ["v"], [], "minmax").collect()] == [None, None]
    with pytest.raises(ValueError, match="unknown scale"):
        scoring.scale_indicators(frame_of(spark, [1.0]), ["v"], [], "other")


def test_index_averages_the_pillars(spark):
    values = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 2.0, 3.0)], "code int, i1 double, d1 double, g1 double")
    out = scoring.score_index(values, {"intensity": ["i1"], "diversity": ["d1"], "design": ["g1"]}, ["i1", "g1"]).orderBy("code").collect()
    for name in ("i1", "intensity", "diversity", "design", "index_z"):
        assert [r[name] for r in out] == pytest.approx([-1, 1])


def test_place_types(spark):
    rows = [(110, 110, 95, "dense and diverse"), (110, 90, 105, "dense and less diverse"), (90, 110, 95, "less dense and diverse"),
            (90, 90, 95, "less dense and less diverse"), (None, 100, 100, None), (90, None, 95, "less dense and less diverse"),
            (100, 100, 100, "dense and diverse"), (99.9, 99.9, 99.9, "less dense and less diverse"), (96.7, 100.1, 103.4, "dense and diverse"),
            (96.7, 100.1, 102.9, "less dense and diverse")]
    rows = [tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows]
    frame = spark.createDataFrame(rows, "i double, d double, g double, want string")
    found = frame.select("want", scores.place_type(F.col("i"), F.col("d"), F.col("g")).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_total_behind_density(spark):
    frame = spark.createDataFrame([(6 / 7, 7.0), (None, 2.0)], "d double, a double")
    total = scores.total_behind_density(F.col("d"), F.col("a"))
    assert [r[0] for r in frame.select(total).collect()] == [6, None]
    with pytest.raises(Exception, match="not whole"):
        spark.createDataFrame([(0.3, 2.0)], "d double, a double").select(total).collect()


def test_ranks_with_one_hot_value_and_hot_group(spark):
    """Half of all rows share one value and one group; ranks must still be exact."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else f"g{i % 7}", 5.0 if rng.random() < 0.5 else float(rng.randrange(50))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, g string, v double").repartition(6)
    got = {r["id"]: r["rank"] for r in ranking.ranked(frame, [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == want
    got = {r["id"]: r["rank"] for r in ranking.ranked(frame, [F.col("v").desc(), F.col("id").asc()], by=["g"]).collect()}
    seen = {}
    for i, g, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_quantiles_and_medians(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(100)) for _ in range(501)]
    found = {round(r["q"], 2): r["value"] for r in ranking.quantiles(frame_of(spark, values), "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    cut = statistics.quantiles(values, n=4, method="inclusive")
    assert found == {0.0: min(values), 0.25: pytest.approx(cut[0]), 0.5: pytest.approx(cut[1]), 1.0: max(values)}
    assert ranking.upper_median(frame_of(spark, [1.0, 2.0, 3.0, 4.0]), "v").first()["upper_median"] == 3.0
    assert ranking.quantiles(frame_of(spark, [1.0, 2.0]), "v", [0.5]).first()["value"] == 1.5


def test_rank_class_gives_the_published_fifths(spark):
    frame = spark.range(1, 373).select(ranking.rank_class(F.col("id"), 372).alias("c")).groupBy("c").count()
    assert {r["c"]: r["count"] for r in frame.collect()} == {0: 74, 1: 74, 2: 75, 3: 74, 4: 75}


def test_spearman_with_ties(spark):
    pairs = [(1.0, 2.0), (2.0, 1.0), (2.0, 3.0), (3.0, 3.0), (None, 1.0), (5.0, 9.0)]
    got = reports.spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").first()
    rank_x, rank_y = [1, 2.5, 2.5, 4, 5], [2, 1, 3.5, 3.5, 5]
    assert got["n"] == 5 and got["spearman"] == pytest.approx(statistics.correlation(rank_x, rank_y))


def test_histogram_bins_and_colours(spark):
    values = [69.9, 70.0, 71.0, 71.5, 72.0, 100.0, 101.0, 101.5, 129.9, 130.0]
    rows = {r["bin_start"]: r for r in reports.histogram(frame_of(spark, values), "v").collect()}
    assert len(rows) == 30 and rows[70]["n"] == 3 and rows[72]["n"] == 1 and rows[100]["n"] == 3 and rows[128]["n"] == 1
    for start, r in rows.items():
        higher = sum(v > start + 1 for v in values)
        assert r["color_class"] == 4 - higher * 5 // len(values)


def test_income_groups_split_like_ntile(spark):
    grouped = reports.income_groups(frame_of(spark, [float(i) for i in range(8)] + [None]), "v", "id", ["low", "mid", "high"])
    found = {r["id"]: r["income_group"] for r in grouped.collect()}
    assert found == {0: "low", 1: "low", 2: "low", 3: "mid", 4: "mid", 5: "mid", 6: "high", 7: "high"}


def test_phrases(spark):
    row = spark.range(1)

    def text(c):
        return row.select(c).first()[0]
    assert text(scores.share_phrase(F.lit(199), F.lit(200))) == "higher than 99% of areas"
    assert text(scores.share_phrase(F.lit(1), F.lit(8))) == "lower than 88% of areas"  # 87.5 rounds up
    assert text(scores.zero_phrase(F.lit(1), F.lit(10))) == "none, as in no other area"
    assert text(scores.zero_phrase(F.lit(2), F.lit(400))) == "none, as in fewer than 1% of areas"
    shown = scores.display_value(F.lit(0.5), F.lit(1), 1, ("stop per km2", "stops per km2"), ("stop", "stops"))
    assert text(shown) == "1 stop in total"
    assert text(scores.display_value(F.lit(1234.5), F.lit(9), 1, ("stop", "stops"), ("a", "b"))) == "1,235 stops"


def test_top_overlap_and_bands(spark):
    ranks = spark.createDataFrame([(v, c, r) for v, order in (("Baseline", [1, 2, 3, 4]), ("x", [4, 3, 2, 1]), ("y", [2, 1, 3, 4])) for r, c in enumerate(order, 1)],
                                  "version string, code int, rank long")
    assert {r["version"]: r["top_overlap"] for r in scoring.top_overlap(ranks, "code", k=2).collect()} == {"x": 0, "y": 2}
    named = scoring.rank_ranges(ranks, "code").withColumn("area_name", F.concat(F.lit("a"), F.col("code").cast("string")))
    bands = {r["band"]: r for r in reports.rank_band_summary(named, 4, rank="baseline_rank").collect()}
    assert bands[0]["mover_name"] == "a1" and bands[0]["max_range"] == 2 and bands[0]["label"] == "Top quintile (1 areas)"
