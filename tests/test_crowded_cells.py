"""Cells that very many areas share are cut into smaller ones where the points are."""
import random

from arealytics.operators import areas
from shapes import box, polygons, ring


def test_spots_in_crowded_cells_meet_few_entries_and_find_the_lowest_code(spark, monkeypatch):
    rng = random.Random(4)
    boxes = {k: (-(k + 1) / 16, -(k + 1) / 8, (k + 1) / 16, (k + 1) / 16) for k in range(200)}
    layer = polygons(spark, [(199 - k if k % 3 else k + 1000, box(*b)) for k, b in boxes.items()] + [(5000, [[ring((-90, 0), (0, -90), (90, 0), (0, 90))]])], "code")
    codes = {(199 - k if k % 3 else k + 1000): b for k, b in boxes.items()}
    spots = [(rng.randrange(-40, 41) / 16, rng.randrange(-40, 41) / 16) for _ in range(300)]
    monkeypatch.setattr(areas, "MOST_PACKED", 64)
    met, plain = [], areas._refined

    def counted(places, entries):
        out = plain(places, entries)
        met.append((entries.count(), out[1].count()))
        return out
    monkeypatch.setattr(areas, "_refined", counted)
    points = spark.createDataFrame(spots, "x double, y double")
    got = sorted((r["x"], r["y"], r["area_code"]) for r in areas.assign_points(points, layer).collect())

    def lowest(x, y):
        return min([c for c, (a, b, d, e) in codes.items() if a <= x <= d and b <= y <= e] + ([5000] if abs(x) + abs(y) <= 90 else []), default=None)
    assert got == sorted((x, y, lowest(x, y)) for x, y in spots)
    assert met and min(after for _, after in met) < met[0][0]
