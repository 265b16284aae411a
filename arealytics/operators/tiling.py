"""Cut polygon edges over square cells, so that every spatial join is an equi-join on a cell.

Cell sizes are powers of four, so cell corners are exact doubles. Each feature picks its own size from its extent and its number of
edges (about the square root of the edge count per side, 64 at most), so a feature with very many edges is spread over many
cells and a very large one never turns into more than some thousands of cells. Only a few sizes ("levels") occur in a layer.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..session import dealt, durable_rows

_MOST_CELLS_PER_SIDE = 64.0
CELL = ["level", "row", "col"]


def cell_size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def with_levels(features: DataFrame, geom: str) -> DataFrame:
    """Add `bounds` and `level` from the feature's own row; the level of a feature without an extent is missing."""
    def measured(points):
        return geo.once(geo.bounds(points), lambda b: F.struct(b.alias("bounds"), F.size(points).alias("edges"), F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"]).alias("extent")))
    size = F.col("_size")
    per_side = F.least(F.lit(_MOST_CELLS_PER_SIDE), F.sqrt(size["edges"].cast("double")))
    level = F.when(size["extent"] > 0, (F.ceil(F.log2(size["extent"] / per_side) / 2) * 2).cast("int"))
    return features.withColumn("_size", geo.once(geo.vertices(F.col(geom)), measured)).withColumn("bounds", size["bounds"]).withColumn("level", level).drop("_size")


def levels_of(features: DataFrame) -> list[int]:
    """The sizes in use: a handful of powers of four, whatever the number of features."""
    return sorted(r["level"] for r in features.select("level").distinct().collect())


def tile_layer(frame: DataFrame, key: str, geom: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A layer's features (key, level, bounds) and edges, both durable.

    Every join below reads them more than once, and this way the geometry itself is read, dealt and measured only here. Features without
    an extent go after that: a condition on the geometry would be moved before the dealing, into the few tasks that read the file.
    """
    dealt_out = dealt(frame.select(key, *keep, F.col(geom).alias("geom")), key)
    sized = durable_rows(with_levels(dealt_out, "geom")).filter("level IS NOT NULL")
    return sized.drop("geom").hint("merge"), durable_rows(explode_edges(sized, "geom", [key, *keep]))


def at_levels(frame: DataFrame, others: list[int], meeting: bool = False) -> DataFrame:
    """Repeat each feature or edge at its own level and at each coarser one of another layer; `own` keeps its own level.

    With `meeting`, the own level is left out where no feature of the other layer comes: all of them are coarser.
    """
    own = F.array("own") if not meeting else F.when(F.col("own") >= min(others), F.array("own")).otherwise(F.array().cast("array<int>")) if others else F.array().cast("array<int>")
    coarser = [F.when(F.col("own") < x, F.array(F.lit(x))).otherwise(F.array().cast("array<int>")) for x in others]
    spread = frame.withColumnRenamed("level", "own").withColumn("level", F.explode(F.concat(own, *coarser)))
    return spread.withColumn("size", cell_size(F.col("level"))) if "size" in frame.columns else spread


def _line_x(y: Column) -> Column:
    """x of the edge (x1, y1)-(x2, y2) at height y."""
    return F.col("x1") + F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))


def explode_edges(features: DataFrame, geom: str, keep: list[str]) -> DataFrame:
    """One row per edge, written from its lower to its upper end (a level edge from left to right).

    `way` is 1 when the inside is on the left of the edge as written and -1 when it is on the right, whichever way the
    publisher drew the rings.
    """
    rings = (features.select(*keep, "level", F.explode(F.col(geom)).alias("part"))
             .select(*keep, "level", F.posexplode("part").alias("nth", "ring"))
             .select(*keep, "level", "ring", F.when((geo.ring_area(F.col("ring")) > 0) == (F.col("nth") == 0), 1).otherwise(-1).alias("turned")))
    edges = (rings.select(*keep, "level", "turned", F.explode(geo.ring_edges(F.col("ring"))).alias("e"))
             .withColumn("kept", (F.col("e.y1") < F.col("e.y2")) | ((F.col("e.y1") == F.col("e.y2")) & (F.col("e.x1") < F.col("e.x2")))))
    return edges.select(
        *keep, "level",
        F.when(F.col("kept"), F.col("e.x1")).otherwise(F.col("e.x2")).alias("x1"), F.least("e.y1", "e.y2").alias("y1"),
        F.when(F.col("kept"), F.col("e.x2")).otherwise(F.col("e.x1")).alias("x2"), F.greatest("e.y1", "e.y2").alias("y2"),
        F.when(F.col("kept"), F.col("turned")).otherwise(-F.col("turned")).alias("way"),
        cell_size(F.col("level")).alias("size"))


def cut_rows(edges: DataFrame) -> DataFrame:
    """One row per edge and cell row it touches, with the x range `lo`..`hi` of that part."""
    rows = F.sequence(F.floor(F.col("y1") / F.col("size")), F.floor(F.col("y2") / F.col("size")))
    cut = edges.withColumn("row", F.explode(rows))
    bottom = F.greatest("y1", F.col("row") * F.col("size"))
    top = F.least("y2", (F.col("row") + 1) * F.col("size"))
    cut = (cut.withColumn("xa", F.coalesce(_line_x(bottom), F.col("x1")))
           .withColumn("xb", F.coalesce(_line_x(top), F.col("x2"))))
    slack = F.col("size") * 1e-9
    return (cut.withColumn("lo", F.greatest(F.least("x1", "x2"), F.least("xa", "xb") - slack))
            .withColumn("hi", F.least(F.greatest("x1", "x2"), F.greatest("xa", "xb") + slack)).drop("xa", "xb"))


def cell_edges(edges: DataFrame) -> DataFrame:
    """One row per edge and cell it touches."""
    return across(cut_rows(edges))


def across(rows: DataFrame) -> DataFrame:
    """One row per cell for edges cut into cell rows."""
    cols = F.sequence(F.floor(F.col("lo") / F.col("size")), F.floor(F.col("hi") / F.col("size")))
    return rows.withColumn("col", F.explode(cols)).drop("lo", "hi")


def right_of(px: Column, py: Column, e) -> Column:
    """Is the point to the right of the edge, seen from its lower to its upper end?

    A point on the edge is treated as moved up a little, and then (much less) to the right, so every test that shares a
    point gives the same answer.
    """
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return (cross < 0) | ((cross == 0) & (e["x2"] <= e["x1"]))


def _above(px: Column, py: Column, e) -> Column:
    return F.when(e["y1"] == e["y2"], py >= e["y1"]).otherwise((e["x2"] <= e["x1"]) == right_of(px, py, e))


def _right_in_range(px: Column, py: Column, e) -> Column:
    return (F.when((e["x1"] > px) & (e["x2"] > px), False)
            .when((e["x1"] <= px) & (e["x2"] <= px), True)
            .otherwise(right_of(px, py, e)))


def path_crossings(px: Column, py: Column, left: Column, bottom: Column, e) -> Column:
    """How often the path from a cell's lower left corner up to the point's height and across to the point meets the edge."""
    spans_left = (e["x1"] > left) != (e["x2"] > left)
    spans_y = (e["y1"] > py) != (e["y2"] > py)
    climbs = spans_left & (_above(left, bottom, e) != _above(left, py, e))
    crosses = spans_y & (_right_in_range(left, py, e) != _right_in_range(px, py, e))
    return climbs.cast("int") + crosses.cast("int")


def on_edge(px: Column, py: Column, e) -> Column:
    # The cheap comparisons come first: they settle nearly all edges of a cell.
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return ((py >= e["y1"]) & (py <= e["y2"]) & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
            & (cross == 0))


def near_edge(px: Column, py: Column, e, within: float) -> Column:
    """Is the point at most `within` from the edge?"""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = F.least(F.greatest(F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - e["x1"] - along * dx, py - e["y1"] - along * dy) <= within


def line_events(edges: DataFrame) -> DataFrame:
    """Where edges meet the lower lines of cell rows: `col` is the first cell whose corner is to the right of the edge.

    `turn` is the change of the winding number when passing the edge to the right; `at` is where it meets the line, and `at_corner` says
    that the first corner is not beyond that place.
    """
    first, last = F.ceil(F.col("y1") / F.col("size")), F.ceil(F.col("y2") / F.col("size")) - 1
    met = edges.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    line = F.col("row") * F.col("size")
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    met = met.withColumn("at", _line_x(line)).withColumn("_k", F.floor(F.col("at") / F.col("size")))
    met = met.withColumn("at_corner", _right_in_range(F.col("_k") * F.col("size"), line, e))
    col = (F.when(F.col("at_corner"), F.col("_k"))
           .when(_right_in_range((F.col("_k") + 1) * F.col("size"), line, e), F.col("_k") + 1)
           .otherwise(F.col("_k") + 2))
    return met.withColumn("col", col).withColumn("turn", -F.col("way")).drop("_k")


def corner_flags(features: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose lower left corner is inside a feature: running sums of the crossings along each cell row.

    A cell row of one feature has at most some dozens of cells, because crossings are counted per cell first.
    """
    size = cell_size(F.col("level"))
    rows = F.sequence(F.floor(F.col("bounds.miny") / size), F.floor(F.col("bounds.maxy") / size))
    cols = F.sequence(F.floor(F.col("bounds.minx") / size), F.floor(F.col("bounds.maxx") / size))
    cells = (features.select(*keys, "level", "bounds", F.explode(rows).alias("row"))
             .select(*keys, "level", "row", F.explode(cols).alias("col"), F.lit(0).alias("crossings"), F.lit(0).alias("turn")))
    # One shuffle serves both the counts and the running sums.
    counted = (cells.unionByName(events.select(*keys, *CELL, F.lit(1).alias("crossings"), "turn")).repartition(keys[0], "level", "row")
               .groupBy(*keys, *CELL).agg(F.sum("crossings").alias("crossings"), F.sum("turn").alias("turn")))
    along = Window.partitionBy(*keys, "level", "row").orderBy("col")
    return (counted.withColumn("odd", F.sum("crossings").over(along) % 2 == 1)
            .withColumn("winding", F.sum("turn").over(along)).drop("crossings", "turn"))
