"""Self-crossing polygons against a grid count."""
import math
import random

import numpy as np
import pytest
from shapes import box, polygons, ring

from arealytics.operators import areas, even_odd, tiling

GRID = 600


def inside(rings, xs, ys):
    """Even-odd test of many points at once, edge by edge."""
    out = np.zeros(len(xs), bool)
    for r in rings:
        for a, b in zip(r, r[1:]):
            spans = (a["y"] > ys) != (b["y"] > ys)
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= spans & (xs < a["x"] + (ys - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))
    return out


def grid_shares(geom, cells):
    rings = [r for part in geom for r in part]
    x = [p["x"] for r in rings for p in r]
    y = [p["y"] for r in rings for p in r]
    side = np.linspace(0, 1, GRID, endpoint=False) + 0.5 / GRID
    xs, ys = (v.ravel() for v in np.meshgrid(min(x) + side * (max(x) - min(x)), min(y) + side * (max(y) - min(y))))
    held = inside(rings, xs, ys)
    return {code: (held & (xs >= x0) & (xs < x1) & (ys >= y0) & (ys < y1)).sum() / held.sum() for code, (x0, y0, x1, y1) in cells.items()}


def shapes():
    rng = random.Random(12)
    star = [(3 + 2.5 * math.cos(4 * math.pi * i / 5), 3 + 2.5 * math.sin(4 * math.pi * i / 5)) for i in range(5)]
    out = {
        1: [[ring((0.3, 0.2), (3.7, 2.9), (3.1, 0.4), (0.6, 2.2))]],  # a tilted bow tie
        2: [[ring(*star)]],  # its middle is wound twice
        3: [[ring((1, 1), (5, 1), (5, 5), (1, 5), (1, 1), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (1, 1))]],  # twice round in one ring
        4: [[ring((0, 0), (3, 0), (3, 3), (0, 3)), ring((4, 4), (5, 4), (5, 5), (4, 5))]],  # a hole outside its shell
        5: [box(0.5, 0.5, 3.5, 3.5)[0], box(2.2, 2.4, 5.1, 5.3)[0]],  # overlapping parts
        6: [[ring((0, 0), (4, 1), (3, 5)), ring((1, 1), (2, 1.4), (1.9, 2.2))]],  # sound, with a hole
    }
    for i in range(7, 12):
        out[i] = [[ring(*[(rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(rng.randrange(5, 14))])]]
    return out


def test_shares_follow_the_even_odd_rule(spark):
    cells = {10 * i + j: (1.5 * i, 2.0 * j, 1.5 * i + 1.5, 2.0 * j + 2.0) for i in range(4) for j in range(3)}
    layer = polygons(spark, list(shapes().items()))
    found = areas.area_shares(layer, polygons(spark, [(c, box(*b)) for c, b in cells.items()], "code")).collect()
    for i, geom in shapes().items():
        got = {r["area_code"]: r["area_share"] for r in found if r["id"] == i}
        want = grid_shares(geom, cells)
        assert sum(got.values()) == pytest.approx(1, abs=1e-9), i
        assert all(got.get(c, 0) == pytest.approx(want[c], abs=0.004) for c in cells), i


def test_exact_areas(spark):
    whole = polygons(spark, [(1, box(-100, -100, 100, 100))], "code")
    found = {r["id"]: r["overlap"] for r in areas.area_shares(polygons(spark, list(shapes().items())), whole).collect()}
    assert (found[3], found[4]) == (pytest.approx(12), pytest.approx(10))
    assert found[5] == pytest.approx(9 + 2.9 * 2.9 - 2 * 1.3 * 1.1)
    twice = areas.area_shares(polygons(spark, [(1, [[ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1), (0, 1))]]), (2, box(0, 0, 1, 1))]), whole)
    assert [(r["id"], r["overlap"]) for r in twice.collect()] == [(2, pytest.approx(1))]  # every place is wound twice or not at all


def test_only_faulty_features_are_cut_again(spark):
    layer = tiling.tile_layer(polygons(spark, list(shapes().items())), "id", "geom")
    bad = even_odd.faulty(areas.polygon_pieces(layer, "id", [], []), "id", ["id", "own", *tiling.CELL])
    kept = {r["id"] for r in bad.collect()}
    assert {1, 2, 3, 4, 5} <= kept and 6 not in kept
