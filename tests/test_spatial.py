import math
import random

import pytest
from pyspark.sql import functions as F

from arealytics.functions import geometry as geo
from arealytics.functions import projection
from arealytics.operators import areas, network, spatial_stats, tiling
from shapes import box, lines, polygons, ring, two_areas


def test_boundary_points_go_to_the_lower_code(spark):
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.5, 0.5), (3, 5.0, 5.0), (4, 1.0, 1.0), (5, 0.0, 0.0)], "id long, x double, y double")
    found = {r["id"]: r["area_code"] for r in areas.assign_points(points, two_areas(spark)).collect()}
    assert found == {1: 10, 2: 20, 3: None, 4: 10, 5: 20}


CASES = {1: (0.3, 0.2, 1.3, 0.8), 2: (-2, 0.2, 0.5, 0.8), 3: (0.5, 0.2, 1.5, 0.8), 4: (-0.8, 0.2, 0.2, 0.8), 5: (-0.2, 0.2, 1.3, 0.8),
         6: (5, 5, 6, 6), 7: (2, 0, 3, 1)}


def test_shares_and_assignment(spark):
    shapes = polygons(spark, [(i, box(*b)) for i, b in CASES.items()])
    shares = areas.area_shares(shapes, two_areas(spark)).cache()
    by = {(r["id"], r["area_code"]): r["area_share"] for r in shares.collect()}
    assert by[1, 20] == pytest.approx(0.7) and by[1, 10] == pytest.approx(0.3)
    assert by[4, 20] == pytest.approx(0.2) and (4, 10) not in by
    assert sum(v for (i, _), v in by.items() if i == 5) <= 1 + 1e-9
    assert not any(i in (6, 7) for i, _ in by)  # apart, and touching only
    got = {r["id"]: r for r in areas.assign_polygons(shapes, shares).collect()}
    assert [got[i]["assigned_area"] for i in (1, 2, 3, 6)] == [20, None, 10, None]
    assert got[2]["outside_share"] > got[2]["winner_share"]
    assert (got[6]["winner_share"], got[6]["outside_share"], got[6]["n_areas_touched"]) == (0.0, 1.0, 0)


def test_concave_overlap(spark):
    c = polygons(spark, [(1, [[ring((0, 0), (4, 0), (4, 4), (3, 1), (2, 4), (1, 1), (0, 4))]])])
    t = polygons(spark, [(2, [[ring((1, 0.5), (3.5, 2), (0.5, 3))]])], "code")
    assert areas.area_shares(c, t).first()["overlap"] == pytest.approx(2.18576388888889)


def star(rng, x, y, r, n):
    turn = rng.random()
    return [(x + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * (i + turn) / n),
             y + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * (i + turn) / n)) for i in range(n)]


def holds(corners, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("packed", [512, 0])
def test_points_in_many_shapes_match_brute_force(spark, monkeypatch, packed):
    """Shapes of very different sizes and vertex counts, both ring directions; also with every cell on the crowded route."""
    monkeypatch.setattr(areas, "MOST_PACKED", packed)
    rng = random.Random(3)
    stars = [(i, star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([1, 4, 20]), rng.choice([5, 40, 200]))) for i in range(25)]
    layer = polygons(spark, [(i, [[ring(*(reversed(s) if i % 2 else s))]]) for i, s in stars], "code")
    spots = [(k, rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(800)]
    got = {r["id"]: r["area_code"] for r in areas.assign_points(spark.createDataFrame(spots, "id long, x double, y double"), layer).collect()}
    want = {k: min([i for i, s in stars if holds(s, x, y)], default=None) for k, x, y in spots}
    assert got == want and len(set(want.values())) > 5


def test_pieces_add_up_to_the_area_at_every_cell_size(spark):
    rng = random.Random(5)
    shapes = [(i, [[ring(*star(rng, 3 * i, 0, 2, 30))]]) for i in range(6)]
    shapes.append((6, [[ring((0, 0), (9, 0), (9, 9), (0, 9)), ring((2, 2), (2, 5), (5, 5), (5, 2))]]))
    frame = polygons(spark, shapes, "pid")
    pieces = areas.polygon_pieces(tiling.tile_layer(frame, "pid", "geom"), "pid", [2, 4], [])
    sums = pieces.groupBy("pid", "level").agg(F.sum(F.expr("sign * (xb - xa) * (ha + hb) / 2")).alias("a"))
    rows = sums.join(frame.select("pid", geo.polygon_area(F.col("geom")).alias("b")), "pid").collect()
    assert len(rows) > 7 and all(r["a"] == pytest.approx(r["b"], rel=1e-9) for r in rows)
    assert {round(r["b"], 6) for r in rows if r["pid"] == 6} == {72.0}


def test_centroid_snap_and_multipolygon(spark):
    frame = polygons(spark, [(1, [[ring((0, 0), (2, 0), (2, 1), (0, 1))]])])
    c = frame.select(geo.polygon_centroid(F.col("geom")).alias("c")).first()["c"]
    assert (c["x"], c["y"]) == (1.0, 0.5)
    fine = polygons(spark, [(1, [[ring((0, 0), (1.04, 0), (0.98, 0.02), (1, 1), (0, 1))]])])
    snapped = fine.select(geo.snap_polygon(F.col("geom"), 0.1).alias("g")).first()["g"]
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in snapped[0][0]] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


def test_projection_round_trip_and_known_scale(spark):
    frame = spark.createDataFrame([(151.2073, -33.8678), (153.0, -30.0), (149.9, -34.4)], "lon double, lat double")
    there = frame.withColumn("m", projection.to_metres(F.col("lon"), F.col("lat")))
    rows = there.withColumn("b", projection.to_degrees(F.col("m.x"), F.col("m.y"))).collect()
    for r in rows:
        assert abs(r["b"]["x"] - r["lon"]) < 1e-9 and abs(r["b"]["y"] - r["lat"]) < 1e-9
    assert rows[1]["m"]["x"] == pytest.approx(500000.0, abs=1e-6)
    assert 333000 < rows[0]["m"]["x"] < 335000 and 6250000 < rows[0]["m"]["y"] < 6253000


ROADS = [(1, [[(0, 0), (1, 0), (2, 0)]]), (2, [[(1, 0), (1, 1)]]), (3, [[(3, 0), (3.5, 0), (4, 0)]]), (4, [[(3.5, -1), (3.5, 0), (3.5, 1)]]),
         (5, [[(5, 0), (5.5, 0.5), (6, 0)]]), (6, [[(7, 0), (8, 0)]]), (7, [[(8, 0), (9, 0)]])]


def test_intersections(spark):
    found = {(r["x"], r["y"]): r["legs"] for r in network.intersections_of_lines(lines(spark, ROADS)).collect()}
    assert found == {(1.0, 0.0): 3, (3.5, 0.0): 4}
    flat = [(i, k, float(x), float(y)) for i, parts in ROADS for k, (x, y) in enumerate(parts[0])]
    rows = spark.createDataFrame(flat, "id long, k int, x double, y double").repartition(5)
    again = network.intersections_of_vertices(rows, "id", [F.col("k")], F.col("x"), F.col("y"))
    assert {(r["x"], r["y"]): r["legs"] for r in again.collect()} == found


def test_neighbours_share_borders_corners_and_t_junctions(spark):
    layer = polygons(spark, [(1, box(0, 0, 2, 2)), (2, box(2, 0, 3, 1)), (3, box(2, 1, 3, 2)), (4, box(3, 2, 4, 3)), (5, box(8, 8, 9, 9)),
                             (6, box(0.5, 2, 1.5, 3))], "code")
    found = {(r["i"], r["j"]) for r in network.neighbours(layer).collect()}
    want = {(1, 2), (1, 3), (2, 3), (3, 4), (1, 6)}
    assert found == want | {(j, i) for i, j in want}
    weights = {(r["i"], r["j"]): r["w"] for r in network.row_weights(network.neighbours(layer)).collect()}
    assert weights[1, 2] == pytest.approx(1 / 3) and weights[4, 3] == 1.0


def chain(spark):
    return spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5), (3, 2, 0.5), (3, 4, 0.5), (4, 3, 1.0)], "i long, j long, w double")


def zs(spark, *values):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "code long, z double")


def test_moran_on_the_chain(spark):
    w = chain(spark)
    assert spatial_stats.global_moran(zs(spark, 1, 1, -1, -1), w).first()[0] == pytest.approx(0.5)
    assert spatial_stats.global_moran(zs(spark, 1, -1, 1, -1), w).first()[0] == pytest.approx(-1)
    local = spatial_stats.local_moran(zs(spark, 1, 1, -1, -1), w)
    rows = sorted((r["code"], r["neighbour_mean"], r["local_i"]) for r in local.collect())
    assert rows == [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, -1.0, 1.0)]
    p = {r["code"]: r["p_value"] for r in spatial_stats.local_moran_p(local, 9, 1).collect()}
    assert p == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}
    found = spatial_stats.global_moran_p(zs(spark, 1, 1, -1, -1), w, 99, 1).first()
    assert found["morans_i"] == pytest.approx(0.5) and 0.01 <= found["p_value"] <= 1


def test_moran_refuses_raw_scores(spark):
    for call in (spatial_stats.global_moran, spatial_stats.local_moran):
        with pytest.raises(ValueError, match="z-scores"):
            call(zs(spark, 101, 101, 99, 99), chain(spark))


def test_moran_identities_and_islands(spark):
    n = 30
    raw = [math.sin(i / 4) for i in range(n)]
    mean = sum(raw) / n
    sd = (sum((v - mean) ** 2 for v in raw) / n) ** 0.5
    values = zs(spark, *[(v - mean) / sd for v in raw])
    pairs = spark.createDataFrame([(i, j) for i in range(1, n + 1) for j in (i - 1, i + 1) if 1 <= j <= n], "i long, j long")
    w = network.row_weights(pairs)
    local = spatial_stats.local_moran(values, w)
    total = spatial_stats.global_moran(values, w).first()[0]
    assert local.agg(F.avg("local_i")).first()[0] == pytest.approx(total)
    slope = local.agg(F.sum(F.col("z") * F.col("neighbour_mean")) / F.sum(F.col("z") * F.col("z"))).first()[0]
    assert slope == pytest.approx(total)
    island = spatial_stats.local_moran(zs(spark, 1, 1, -1, -1), chain(spark).filter("i < 4 and j < 4"))
    row = spatial_stats.local_moran_p(island, 9, 1).filter("code = 4").first()
    assert (row["neighbours"], row["neighbour_mean"], row["p_value"]) == (0, 0.0, 1.0)


def test_hotspot_quadrants(spark):
    frame = spark.createDataFrame([(1, 1.0, 1.0, 0.01), (2, -1.0, -1.0, 0.01), (3, 1.0, -1.0, 0.01), (4, -1.0, 1.0, 0.01), (5, 0.0, 0.0, 0.01),
                                   (6, 1.0, 1.0, 0.05)], "code long, z double, neighbour_mean double, p_value double")
    found = [r["hotspot_class"] for r in spatial_stats.hotspots(frame).orderBy("code").collect()]
    assert found == ["high-high", "low-low", "high-low", "low-high", "high-high", "not significant"]


def test_ring_problems(spark):
    layer = polygons(spark, [(1, box(0, 0, 1, 1)), (2, [[ring((0, 0), (2, 1), (2, 0), (0, 2))]]),
                             (3, [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]])])
    found = sorted((r["id"], r["problem"]) for r in network.ring_problems(layer, "id").collect())
    assert found == [(2, "crossing"), (3, "open"), (3, "short")]


def test_points_outside_are_split_by_the_edge_margin(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.1, 0.5), (3, 9.0, 9.0)], "id long, x double, y double")
    split = areas.split_points(areas.assign_points(points, two_areas(spark)), two_areas(spark), "geom", 0.15)
    assert {r["id"]: r["place"] for r in split.collect()} == {1: "counted", 2: "near", 3: "far"}


@pytest.mark.parametrize("areas_at_one_spot", [3, 60])
@pytest.mark.parametrize("packed", [512, 0])
def test_repeated_and_missing_ids_get_the_same_areas(spark, monkeypatch, packed, areas_at_one_spot):
    monkeypatch.setattr(areas, "MOST_PACKED", packed)
    nested = polygons(spark, [(i, box(-i, -i, i, i)) for i in range(1, areas_at_one_spot + 1)], "code")
    spots = [(1, 0.5, 0.5), (1, 1.5, 0.0), (2, 2.5, 2.5), (None, 0.5, -0.5), (None, 2.0, 0.0)]
    got = areas.assign_points(spark.createDataFrame(spots, "id long, x double, y double"), nested).collect()
    assert sorted((r["x"], r["y"], r["area_code"]) for r in got) == sorted((x, y, max(1, math.ceil(max(abs(x), abs(y))))) for _, x, y in spots)


def test_a_border_point_off_by_rounding_still_touches(spark):
    layer = polygons(spark, [(1, [[ring((0, 0), (3, 1), (0, 3))]]), (2, [[ring((0.3, 0.1), (0.9, 0.3), (0.9, -1))]]), (3, [[ring((5, 5), (6, 5), (6, 6))]])], "code")
    assert {(r["i"], r["j"]) for r in network.neighbours(layer).collect()} == {(1, 2), (2, 1)}


def test_shares_with_one_large_feature_in_each_layer(spark):
    small = [(i, box(i, 0, i + 1, 1)) for i in range(1, 12)]
    shares = areas.area_shares(polygons(spark, [*small, (0, box(-50, -50, 50, 50))]), polygons(spark, [*small, (0, box(-40, -40, 60, 60))], "code"))
    got = {(r["id"], r["area_code"]): r["overlap"] for r in shares.collect()}
    want = {(i, i): 1.0 for i in range(1, 12)} | {(0, i): 1.0 for i in range(1, 12)} | {(i, 0): 1.0 for i in range(1, 12)} | {(0, 0): 8100.0}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_shuffles_are_bijections_with_inverses(spark, n):
    keys = spatial_stats.replicate_keys(spark, 20, 5)
    moved = spark.range(n).crossJoin(keys).withColumn("to", spatial_stats.shuffled_place(F.col("id"), n, F.col("keys")))
    moved = moved.withColumn("back", spatial_stats.shuffled_place(F.col("to"), n, F.reverse("keys"))).select("rep", "id", "to", "back").collect()
    by_rep = {}
    for r in moved:
        assert r["back"] == r["id"]
        by_rep.setdefault(r["rep"], {})[r["id"]] = r["to"]
    assert all(sorted(m.values()) == list(range(n)) for m in by_rep.values())
    if n == 1000:  # places spread evenly, and neighbours do not stay neighbours
        near = [abs(m[i] - m[i + 1]) == 1 for m in by_rep.values() for i in range(n - 1)]
        low = [m[i] < 500 for m in by_rep.values() for i in range(500)]
        assert sum(near) / len(near) < 0.006 and abs(sum(low) / len(low) - 0.5) < 0.02


def test_local_p_of_a_hub_with_two_thousand_neighbours(spark):
    n = 2101
    mean, sd = (n - 1) / 2, math.sqrt((n * n - 1) / 12)
    values = spark.createDataFrame([(i, (i - mean) / sd) for i in range(n)], "code long, z double")
    pairs = spark.range(1, 2001).selectExpr("0L i", "id j").unionByName(spark.range(1, 2001).selectExpr("id i", "0L j"))
    local = spatial_stats.local_moran(values, network.row_weights(pairs))
    got = {r["code"]: (r["neighbours"], r["p_value"]) for r in spatial_stats.local_moran_p(local, 19, 3).collect()}
    keys = {r["rep"]: r["keys"] for r in spatial_stats.replicate_keys(spark, 19, 3).collect()}

    def place(x, ks):
        for k in ks:
            other = (k - x) % n
            mixed = (max(x, other) + k) % spatial_stats.PRIME
            x = other if mixed * mixed % spatial_stats.PRIME >> 8 & 1 else x
        return x
    z = lambda i: (i - mean) / sd
    for code, k, seen in ((0, 2000, sum(z(i) for i in range(1, 2001)) / 2000), (7, 1, z(0))):
        sims = []
        for ks in keys.values():
            drawn = [a for a in (place(s, ks[::-1]) for s in range(k + 1)) if a != code][:k]
            sims.append(z(code) * sum(map(z, drawn)) / k)
        want = (1 + sum(round(abs(s), 9) >= round(abs(z(code) * seen), 9) for s in sims)) / 20
        assert got[code] == (k, pytest.approx(want))
