"""Why polygons are not valid: faults of single rings, and of rings to each other.

Crossings are found by a sweep inside cells: the edges of a group are cut at each other's ends into slabs and sorted by height at a slab's left
side. If two of them cross in the slab, two neighbours of that order have changed places at its right side, so only neighbours are compared.
Rings that cross nothing are placed by one point each: the middle of their first edge is counted against the other rings in its cell.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..session import dealt, durable_rows
from . import tiling
from .areas import edge_pieces
from .even_odd import slabs
from .tiling import CELL

RING = ["key", "pno", "rno"]
_NEAR = 1e-9


def _rings(features: DataFrame) -> DataFrame:
    return (features.select("key", F.posexplode("geom").alias("pno", "rings"))
            .select("key", "pno", F.posexplode("rings").alias("rno", "ring")))


def _changed_places(cut: DataFrame, group: list[str]) -> DataFrame:
    """Neighbours of a slab that cross in it: a ring and the ring of the edge below."""
    up = Window.partitionBy(*group, "x0").orderBy("h0", "h1")
    below = F.lag(F.struct("pno", "rno", "h0", "h1")).over(up)
    found = cut.withColumn("below", below).filter((F.col("below.h1") > F.col("h1") + F.col("near")) & (F.col("below.h0") < F.col("h0") - F.col("near")))
    return found.select(*RING, F.col("below.pno").alias("opno"), F.col("below.rno").alias("orno"))


def _met_at_borders(cut: DataFrame, group: list[str]) -> DataFrame:
    """Edges that pass straight through a common point on the side of a slab or cell, where no slab sees them change places."""
    size = tiling.cell_size(F.col("level"))
    slope = (F.col("hb") - F.col("ha")) / (F.col("xb") - F.col("xa"))
    points = None
    for x, h in (("x0", "h0"), ("x1", "h1")):
        y = F.round(F.col("row") + F.col(h) / size, 9)
        one = cut.filter((F.col("least") + F.col("near") < F.col(x)) & (F.col(x) + F.col("near") < F.col("most"))).select(*RING, "level", F.col(x).alias("x"), y.alias("y"), slope.alias("slope"))
        points = one if points is None else points.unionByName(one)
    flatter = F.lag(F.struct("pno", "rno", "slope")).over(Window.partitionBy(*group, "level", "x", "y").orderBy("slope"))
    found = points.withColumn("flatter", flatter).filter(F.col("slope") - F.col("flatter.slope") > (F.abs("slope") + 1) * _NEAR)
    return found.select(*RING, F.col("flatter.pno").alias("opno"), F.col("flatter.rno").alias("orno"))


def _upright(edges: DataFrame) -> DataFrame:
    """Upright edges in the cells they pass; one on a border between cells is in the left one, where slabs end at it."""
    size = F.col("size")
    rows = F.sequence(F.floor(F.col("y1") / size), F.floor(F.col("y2") / size))
    return edges.filter("x1 = x2").withColumn("row", F.explode(rows)).withColumn("col", F.ceil(F.col("x1") / size) - 1)


def _through_upright(edges: DataFrame, cut: DataFrame, cells: list[str]) -> DataFrame:
    """Upright edges and the edges of their group that pass through them between their ends, met where a slab ends at the edge's x."""
    bottom = F.col("row") * F.col("size")
    upright = _upright(edges).select(*cells, (F.col("x1") + 0.0).alias("x1"), F.col("pno").alias("opno"), F.col("rno").alias("orno"),
                                     (F.col("y1") - bottom).alias("low"), (F.col("y2") - bottom).alias("high"))
    met = cut.filter("least + near < x1 AND x1 + near < most").join(upright, [*cells, "x1"])
    return met.filter((F.col("h1") > F.col("low") + F.col("near")) & (F.col("h1") < F.col("high") - F.col("near"))).select(*RING, "opno", "orno")


def crossing_rings(edges: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of rings (key, pno, rno, opno, orno) with edges that cross inside a group, both ways round."""
    whole = edges.withColumns({"least": F.least("x1", "x2"), "most": F.greatest("x1", "x2")})
    pieces, cells = edge_pieces(whole, [*RING, "least", "most"]), [*group, *CELL]
    # Upright edges end slabs as well, so that whatever passes through one has a height there.
    marks = _upright(edges).select(*cells, (F.col("x1") + 0.0).alias("x"))
    cut = durable_rows(slabs(pieces, cells, marks).withColumn("near", tiling.cell_size(F.col("level")) * _NEAR))
    pairs = _changed_places(cut, cells).unionByName(_met_at_borders(cut, group)).unionByName(_through_upright(edges, cut, cells)).distinct()
    other = pairs.select("key", F.col("opno").alias("pno"), F.col("orno").alias("rno"), F.col("pno").alias("opno"), F.col("rno").alias("orno"))
    return pairs.unionByName(other).distinct()


def ring_places(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, pno, rno, opno, orno): every ring with the other rings of its feature that it lies in, by one point of it."""
    sized = rings.withColumn("bounds", geo.bounds(F.col("ring")))
    flags = tiling.corner_flags(sized, tiling.line_events(edges), RING).filter("odd")
    e = ["x1", "y1", "x2", "y2"]
    held = tiling.cell_edges(edges).select(*RING, *CELL, F.lit(0).alias("odd"), *e).unionByName(
        flags.select(*RING, *CELL, F.lit(1).alias("odd"), *[F.lit(None).cast("double").alias(c) for c in e]))
    held = held.withColumnsRenamed({"pno": "opno", "rno": "orno"})
    first = F.get(geo.ring_edges(F.col("ring")), F.lit(0))
    size = tiling.cell_size(F.col("level"))
    probes = sized.select(*RING, "level", ((first["x1"] + first["x2"]) / 2).alias("px"), ((first["y1"] + first["y2"]) / 2).alias("py"))
    probes = probes.withColumn("row", F.floor(F.col("py") / size)).withColumn("col", F.floor(F.col("px") / size))
    crossings = F.coalesce(tiling.path_crossings(F.col("px"), F.col("py"), F.col("col") * size, F.col("row") * size, {c: F.col(c) for c in e}), F.lit(0))
    met = probes.join(held, ["key", *CELL]).filter((F.col("pno") != F.col("opno")) | (F.col("rno") != F.col("orno")))
    return met.groupBy(*RING, "opno", "orno").agg((F.sum(crossings + F.col("odd")) % 2 == 1).alias("inside")).filter("inside").drop("inside")


def ring_problems(features: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """Why a feature's rings are not valid, one row per feature and problem.

    Of one ring: `open`, `short`, `flat`, `crossing` (itself). Of rings that do not cross themselves: `rings_cross`. Of rings that cross nothing:
    `hole_outside` its shell, `hole_in_hole`, and `parts_overlap` (a part that lies in another one).
    """
    # Written first: every step below reads the geometry, and none should carry the expressions that made it.
    features = durable_rows(dealt(features.select(F.col(key).alias("key"), F.col(geom).alias("geom")), "key"))
    rings = _rings(features)
    first, last = F.get("ring", F.lit(0)), F.get("ring", F.size("ring") - 1)
    simple = rings.select("key", F.explode(F.filter(F.array(
        F.when(first != last, F.lit("open")),
        F.when(F.size("ring") < 4, F.lit("short")),
        F.when(geo.ring_area(F.col("ring")) == 0, F.lit("flat"))), lambda p: p.isNotNull())).alias("problem"))

    sized = tiling.with_levels(features, "geom").filter("level IS NOT NULL").select("key", "level", F.posexplode("geom").alias("pno", "rings"))
    placed = durable_rows(sized.select("key", "level", "pno", F.posexplode("rings").alias("rno", "ring")).filter(F.size("ring") > 0))
    edges = durable_rows(tiling.explode_edges(placed.withColumn("geom", F.array(F.array("ring"))), "geom", RING))
    own = durable_rows(crossing_rings(edges, RING).select(*RING).distinct())
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    sound = edges.join(own, RING, "left_anti").join(several, "key", "left_semi")
    met = durable_rows(crossing_rings(sound, ["key"]))
    loose = placed.join(several, "key", "left_semi").join(own.unionByName(met.select(*RING)).distinct(), RING, "left_anti")
    places = durable_rows(ring_places(loose, edges.join(loose.select(*RING), RING, "left_semi")))

    shells = loose.filter("rno > 0").join(loose.filter("rno = 0").select("key", "pno"), ["key", "pno"])
    outside = shells.join(places.filter("pno = opno AND orno = 0"), RING, "left_anti")
    in_part = places.filter("rno = 0 AND pno <> opno").groupBy(*RING, "opno").agg(F.count_if(F.col("orno") == 0).alias("shell"), F.count_if(F.col("orno") > 0).alias("holes"))
    kinds = {"crossing": own, "rings_cross": met, "hole_outside": outside, "hole_in_hole": places.filter("pno = opno AND rno > 0 AND orno > 0"),
             "parts_overlap": in_part.filter("shell > 0 AND holes = 0")}
    out = simple
    for problem, found in kinds.items():
        out = out.unionByName(found.select("key", F.lit(problem).alias("problem")))
    return out.distinct().withColumnRenamed("key", key)
