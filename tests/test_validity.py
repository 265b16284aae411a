"""Ring faults against pairs of edges and exact containment."""
import random

import pytest
from shapes import box, polygons, ring

from arealytics.operators import network


def crosses(p, q):
    def side(a, b, c):
        v = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
        return (v > 0) - (v < 0)
    return side(*p, q[0]) * side(*p, q[1]) < 0 and side(*q, p[0]) * side(*q, p[1]) < 0


def edges(r):
    return list(zip(r, r[1:]))


def test_crossings_equal_all_pairs_of_edges(spark):
    rng, layer, self_crossing, between = random.Random(4), [], set(), set()
    for i in range(160):
        snapped = i % 2
        point = (lambda: (rng.randrange(8), rng.randrange(8))) if snapped else (lambda: (rng.uniform(0, 8), rng.uniform(0, 8)))
        parts = [[ring(*[point() for _ in range(rng.randrange(3, 7))]) for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 3))]
        layer.append((i, parts))
        rings = [r for p in parts for r in p]
        bad = [any(crosses(a, b) for n, a in enumerate(edges(r)) for b in edges(r)[n + 1:]) for r in rings]
        if any(bad):
            self_crossing.add(i)
        sound = [r for r, b in zip(rings, bad) if not b]
        if any(crosses(a, b) for n, r in enumerate(sound) for s in sound[n + 1:] for a in edges(r) for b in edges(s)):
            between.add(i)
    found = [(r["id"], r["problem"]) for r in network.ring_problems(polygons(spark, layer), "id").collect()]
    assert len(set(found)) == len(found)
    assert {i for i, p in found if p == "crossing"} == self_crossing and {i for i, p in found if p == "rings_cross"} == between
    assert 20 < len(self_crossing) < 150 and len(between) > 20


@pytest.mark.parametrize("scale, dx", [(1, 0), (0.37, -3.1), (1000, 12345.6)])
def test_places_of_rings(spark, scale, dx):
    def at(x0, y0, x1, y1):
        return ring(*[(x * scale + dx, y * scale) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    shell, hole, small = at(0, 0, 6, 6), at(1, 1, 5, 5), at(2, 2, 3, 3)
    layer = {1: [[shell, hole], [small]], 2: [[shell, at(7, 7, 8, 8)]], 3: [[shell, hole, small]], 4: [[shell], [small]], 5: [[shell, hole], [at(-2, -2, 9, 9)]],
             6: [[shell, small, at(3.5, 3.5, 4, 4)], [at(6, 0, 9, 6)]], 7: [[shell], [at(5, 5, 9, 9)]]}
    found = sorted((r["id"], r["problem"]) for r in network.ring_problems(polygons(spark, list(layer.items())), "id").collect())
    assert found == [(2, "hole_outside"), (3, "hole_in_hole"), (4, "parts_overlap"), (5, "parts_overlap"), (7, "rings_cross")]


def test_many_edges_through_one_cell(spark):
    comb = [(i / 100, 0.0 if i % 2 else 5.0) for i in range(2000)] + [(20.0, -1.0), (0.0, -1.0)]
    layer = [(1, [[ring(*comb)]]), (2, [[ring(*comb[:-2], (20.0, 2.5), (-1.0, 2.5))]]), (3, box(0, 0, 1, 1))]
    assert sorted((r["id"], r["problem"]) for r in network.ring_problems(polygons(spark, layer), "id").collect()) == [(2, "crossing")]
