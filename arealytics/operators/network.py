"""Street intersections and area neighbours."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..session import durable
from . import tiling
from .validity import ring_problems as ring_problems


def intersections_of_lines(lines: DataFrame, geom: str = "line", digits: int = 7, min_legs: int = 3) -> DataFrame:
    """Vertices where at least `min_legs` segment ends meet, from line features held as arrays of parts."""
    parts = lines.select(F.explode(geom).alias("part")).select(F.size("part").alias("n"), F.posexplode("part").alias("at", "p"))
    legs = F.when((F.col("at") == 0) | (F.col("at") == F.col("n") - 1), 1).otherwise(2)
    return _meet(parts.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), legs.alias("legs")), digits, min_legs)


def intersections_of_vertices(vertices: DataFrame, line: str, order: Sequence[Column], x: Column, y: Column,
                              digits: int = 7, min_legs: int = 3) -> DataFrame:
    """The same from one row per vertex, in any row order.

    A vertex inside a line has two legs and an end has one. So every vertex counts two, and one is taken off at each line's first and
    last vertex; these come from a min and a max per line, which need no sorted window over a long line.
    """
    points = vertices.select(F.col(line).alias("line"), x.alias("x"), y.alias("y"), F.struct(*order).alias("at"))
    inner = points.select("x", "y", F.lit(2).alias("legs"))
    place = F.struct("at", "x", "y")
    ends = points.groupBy("line").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
    firsts = ends.select("a.x", "a.y", F.lit(-1).alias("legs"))
    lasts = ends.filter("n > 1").select("b.x", "b.y", F.lit(-1).alias("legs"))
    return _meet(inner.unionByName(firsts).unionByName(lasts), digits, min_legs)


def _meet(legs: DataFrame, digits: int, min_legs: int) -> DataFrame:
    return (legs.groupBy(F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))
            .agg(F.sum("legs").alias("legs")).filter(F.col("legs") >= min_legs))


def neighbours(areas: DataFrame, code: str = "code", geom: str = "geom", digits: int = 7) -> DataFrame:
    """Ordered pairs (i, j) of areas that share a border or a corner.

    Shared vertices are found by an equi-join on the rounded vertex; a vertex that lies on the middle of another area's edge by
    a join on cells. The result holds each pair once, so its size is that of the answer.
    """
    features, edges = tiling.tile_layer(areas.select(F.col(code).alias("code"), F.col(geom).alias("geom")), "code", "geom")
    ends = edges.select("code", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                                                  F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    points = durable(ends.select("code", "p.x", "p.y").distinct())
    rounded = points.select("code", F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).distinct()
    same = (rounded.alias("a").join(rounded.alias("b"), ["x", "y"]).filter(F.col("a.code") != F.col("b.code"))
            .select(F.col("a.code").alias("i"), F.col("b.code").alias("j")).distinct())

    levels = F.array(*[F.lit(v) for v in tiling.levels_of(features)]).cast("array<int>")
    size = tiling.cell_size(F.col("level"))
    placed = (points.select(F.col("code").alias("i"), "x", "y", F.explode(levels).alias("level"))
              .withColumn("row", F.floor(F.col("y") / size)).withColumn("col", F.floor(F.col("x") / size)))
    held = tiling.cell_edges(edges).withColumnRenamed("code", "j")
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    touching = (placed.join(held.drop("size", "way"), tiling.CELL)
                .filter((F.col("i") != F.col("j")) & tiling.near_edge(F.col("x"), F.col("y"), e, 10.0 ** -digits)).select("i", "j").distinct())
    both = touching.unionByName(touching.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return same.unionByName(both).distinct()


def row_weights(pairs: DataFrame) -> DataFrame:
    """Row-standardised weights: each of an area's k neighbours weighs 1 / k."""
    k = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(k, "i").select("i", "j", (F.lit(1.0) / F.col("k")).alias("w"))
