"""Small helpers to write geometries in tests."""
from arealytics.functions.geometry import LINE_TYPE, POLYGON_TYPE


def ring(*points):
    points = list(points)
    if points[0] != points[-1]:
        points.append(points[0])
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def polygons(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, geom {POLYGON_TYPE}")


def lines(spark, rows):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in part] for part in parts]) for i, parts in rows],
                                 f"id long, line {LINE_TYPE}")


def two_areas(spark):
    """Two adjacent unit squares with the higher code on the left."""
    return polygons(spark, [(20, box(0, 0, 1, 1)), (10, box(1, 0, 2, 1))], "code")
