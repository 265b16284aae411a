"""Joins of points and polygons to areas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..session import broadcast_if_small, dealt, durable, durable_rows, only_row
from . import even_odd, tiling
from .tiling import CELL

_EDGE = ["x1", "y1", "x2", "y2"]
MOST_PACKED = 512  # entries of one cell that are kept together in one row; fuller cells are joined entry by entry
_HOME = ["home", *CELL]
_MOST_CUTS = 10  # a cell is cut to a millionth of its side; entries that still share it are tested one by one
MOST_BROADCAST = 1_000_000  # entries (of about 50 bytes) of one cell size that are sent to every executor; more are shuffled


def area_index(areas: DataFrame, code: str, geom: str) -> tuple[DataFrame, list[int]]:
    """Entries (cell, code, odd, edge): every edge of every cell it touches, and one entry per cell corner inside an area."""
    features, edges = tiling.tile_layer(areas.select(F.col(code).alias("code"), F.col(geom).alias("geom")), "code", "geom")
    levels = tiling.levels_of(features)
    flags = tiling.corner_flags(features, tiling.line_events(edges), ["code"]).filter("odd")
    entries = tiling.cell_edges(edges).select("code", *CELL, F.lit(False).alias("odd"), *_EDGE).unionByName(
        flags.select("code", *CELL, "odd", *[F.lit(None).cast("double").alias(c) for c in _EDGE]))
    return durable(entries), levels


def _cell_of(x: Column, y: Column, level: int) -> tuple[Column, Column, float]:
    size = 2.0 ** level
    return F.floor(y / size), F.floor(x / size), size


def _packed_hit(x: Column, y: Column, size: float, held: Column) -> Column:
    left, bottom = F.floor(x / size) * size, F.floor(y / size) * size

    def holds(area):
        # Two short walks: one that carries both answers was measured at half the speed.
        crossings = F.aggregate(area["edges"], area["odd"].cast("int"),
                                lambda n, e: n + tiling.path_crossings(x, y, left, bottom, e))
        return (crossings % 2 == 1) | F.exists(area["edges"], lambda e: tiling.on_edge(x, y, e))
    return F.array_min(F.transform(F.filter(held, holds), lambda area: area["code"]))


def assign_points(points: DataFrame, areas: DataFrame, x: str = "x", y: str = "y",
                  code: str = "code", geom: str = "geom", name: str = "area_code") -> DataFrame:
    """Add the area that holds each point (its boundary included); the lowest code wins a tie, outside is missing.

    Each point meets at most one index row per cell size, so the points keep their rows and, when the index is small enough
    to broadcast, are not shuffled at all. Points in cells with very many edges take a second route with one row per
    edge, which no cell can overfill.
    """
    entries, levels = area_index(areas, code, geom)
    loads = durable(entries.groupBy(*CELL).agg(F.count(F.lit(1)).alias("load")))
    held = {r["level"]: r["n"] for r in loads.groupBy("level").agg(F.sum("load").alias("n")).collect()}  # a few cell sizes
    full = durable(loads.filter(F.col("load") > MOST_PACKED).select(*CELL))
    any_full = bool(full.limit(1).count())
    edge = F.when(F.col("x1").isNotNull(), F.struct(*_EDGE))
    light = entries.join(full, CELL, "left_anti") if any_full else entries
    packed = (light.groupBy(*CELL, "code").agg(F.max("odd").alias("odd"), F.collect_list(edge).alias("edges"))
              .groupBy(*CELL).agg(F.collect_list(F.struct("code", "odd", "edges")).alias("held"))
              .withColumn("full", F.lit(False)))
    if any_full:
        packed = packed.unionByName(full.withColumn("full", F.lit(True)), allowMissingColumns=True)
    packed = durable(packed)

    px, py = F.col(x), F.col(y)
    joined, hits, fulls = points, [], []
    for i, level in enumerate(levels):
        row, col, size = _cell_of(px, py, level)
        cells = packed.filter(F.col("level") == level).select(
            F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("held").alias(f"_held{i}"), F.col("full").alias(f"_full{i}"))
        if held.get(level, 0) <= MOST_BROADCAST:
            cells = F.broadcast(cells)
        joined = joined.join(cells, (row == F.col("_row")) & (col == F.col("_col")), "left").drop("_row", "_col")
        hits.append(_packed_hit(px, py, size, F.col(f"_held{i}")))
        fulls.append(F.coalesce(F.col(f"_full{i}"), F.lit(False)))
    kept = [F.col(c) for c in points.columns]
    area_type = entries.schema["code"].dataType
    if not hits:
        return points.withColumn(name, F.lit(None).cast(area_type))
    best = F.least(*hits) if len(hits) > 1 else hits[0]
    if not any_full:
        return joined.select(*kept, best.alias(name))
    crowded = fulls[0]
    for other in fulls[1:]:
        crowded = crowded | other
    simple = joined.filter(~crowded).select(*kept, best.alias(name))
    # Rows are told apart by a number of their own, fixed by the write, so repeated and missing ids do not matter.
    hard = durable(joined.filter(crowded).select(*kept, F.monotonically_increasing_id().alias("_row")))
    return simple.unionByName(_assign_by_entry(hard, entries, levels, x, y, name).drop("_row"))


def _refined(places: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step into crowded cells: places and entries of their quarter-sided cells that hold places.

    A new cell's corner flag is the old one changed by the edges on the way. Of the areas that hold a whole new cell only the lowest code
    can win, and no area with a higher one.
    """
    old, size = tiling.cell_size(F.col("level")), tiling.cell_size(F.col("level") - 2)
    deeper = places.withColumn("r", F.floor(F.col("_y") / size)).withColumn("c", F.floor(F.col("_x") / size))
    cells = deeper.select(*_HOME, "r", "c").distinct()
    e = {c: F.col(c) for c in _EDGE}
    left, bottom = F.col("c") * size, F.col("r") * size
    crossings = F.coalesce(tiling.path_crossings(left, bottom, F.col("col") * old, F.col("row") * old, e), F.lit(0))
    touches = F.coalesce((F.greatest("x1", "x2") >= left) & (F.least("x1", "x2") <= left + size) & (F.col("y2") >= bottom) & (F.col("y1") <= bottom + size), F.lit(False))
    new = [F.col("home"), (F.col("level") - 2).alias("level"), F.col("r").alias("row"), F.col("c").alias("col")]
    met = cells.join(entries.hint("merge"), _HOME)
    held = (met.groupBy(*new, "code").agg((F.sum(crossings + F.col("odd").cast("int")) % 2 == 1).alias("odd"),
                                          F.collect_list(F.when(touches, F.struct(*_EDGE))).alias("edges")))
    whole = held.filter(F.col("odd") & (F.size("edges") == 0)).groupBy(*_HOME).agg(F.min("code").alias("best"))
    held = held.join(whole.hint("merge"), _HOME, "left").filter((F.col("odd") | (F.size("edges") > 0)) & (F.col("best").isNull() | (F.col("code") <= F.col("best"))))
    flag = F.when(F.col("odd"), F.array(F.struct(F.lit(True).alias("odd"), *[F.lit(None).cast("double").alias(c) for c in _EDGE]))).otherwise(F.array())
    rows = F.concat(flag, F.transform("edges", lambda v: F.struct(F.lit(False).alias("odd"), *[v[c].alias(c) for c in _EDGE])))
    return (deeper.select("_id", "_x", "_y", *new), held.select(*_HOME, "code", F.explode(rows).alias("e")).select(*_HOME, "code", "e.*"))


def _assign_by_entry(points: DataFrame, entries: DataFrame, levels: list[int], x: str, y: str, name: str) -> DataFrame:
    """The same test with one row per spot and entry, summed per spot and area. Crowded cells are first cut into smaller ones where the spots are."""
    level = F.explode(F.array(*[F.lit(v) for v in levels])).alias("level")
    size = tiling.cell_size(F.col("level"))
    spots = durable_rows(points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct().withColumn("_id", F.monotonically_increasing_id()))
    places = (spots.select("_id", "_x", "_y", level).withColumn("home", F.col("level"))
              .withColumn("row", F.floor(F.col("_y") / size)).withColumn("col", F.floor(F.col("_x") / size)))
    places = durable_rows(places)
    entries = durable_rows(entries.withColumn("home", F.col("level")).join(places.select(*_HOME).distinct(), _HOME, "left_semi"))
    for _ in range(_MOST_CUTS):
        crowded = durable_rows(entries.groupBy(*_HOME).agg(F.count(F.lit(1)).alias("load")).filter(F.col("load") > MOST_PACKED).select(*_HOME))
        if not crowded.limit(1).count():
            break
        in_places, in_entries = _refined(places.join(crowded, _HOME, "left_semi"), entries.join(crowded, _HOME, "left_semi"))
        places = durable_rows(places.join(crowded, _HOME, "left_anti").unionByName(in_places))
        entries = durable_rows(entries.join(crowded, _HOME, "left_anti").unionByName(in_entries, allowMissingColumns=True))
    size = tiling.cell_size(F.col("level"))
    e = {c: F.col(c) for c in _EDGE}
    px, py = F.col("_x"), F.col("_y")
    crossings = F.coalesce(tiling.path_crossings(px, py, F.col("col") * size, F.col("row") * size, e), F.lit(0))
    inside = (places.join(entries, _HOME)
              .groupBy("_id", "code")
              .agg((F.sum(crossings + F.col("odd").cast("int")) % 2 == 1).alias("odd"),
                   F.max(F.coalesce(tiling.on_edge(px, py, e), F.lit(False))).alias("edge"))
              .filter(F.col("odd") | F.col("edge"))
              .groupBy("_id").agg(F.min("code").alias(name)))
    found = spots.join(inside, "_id").select(F.col("_x"), F.col("_y"), name)
    return points.join(found, (points[x] == found["_x"]) & (points[y] == found["_y"]), "left").drop("_x", "_y")


def edge_pieces(edges: DataFrame, ids: list[str]) -> DataFrame:
    """Parts of edges inside cells, as x ranges with the heights above the cell's bottom at both ends; upright edges have none."""
    size = F.col("size")
    # A level edge that lies on a cell line belongs to the row below, where it has height.
    wide = edges.filter("x1 <> x2")
    level_edges = wide.filter("y1 = y2").withColumn("row", F.ceil(F.col("y1") / size) - 1).withColumn("lo", F.col("x1")).withColumn("hi", F.col("x2"))
    bottom, left = F.col("row") * size, F.col("col") * size

    def clamp(value):
        return F.least(F.greatest(value, F.lit(0.0)), size)

    def in_cells(rows):
        # The cuts belong to a cell row. Made before the cells, they are not repeated in the condition on the ends; with them the generated
        # method passed the 8000 bytes above which the JVM leaves methods uncompiled.
        return tiling.across(rows.withColumn("slope", (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
                             .withColumn("cut0", F.col("x1") + F.try_divide(bottom - F.col("y1"), F.col("slope")))
                             .withColumn("cut1", F.col("cut0") + F.try_divide(size, F.col("slope"))))
    return (in_cells(tiling.cut_rows(wide.filter("y1 < y2"))).unionByName(in_cells(level_edges))
             .withColumn("xa", F.greatest(F.least("x1", "x2"), left, F.least("cut0", "cut1")))
             .withColumn("xb", F.least(F.greatest("x1", "x2"), left + size, F.greatest("cut0", "cut1")))
             .filter("xa < xb")
             .withColumn("ha", clamp(F.col("y1") + (F.col("xa") - F.col("x1")) * F.col("slope") - bottom))
             .withColumn("hb", clamp(F.col("y1") + (F.col("xb") - F.col("x1")) * F.col("slope") - bottom))
             .select(*ids, *CELL, "xa", "xb", "ha", "hb",
                     F.when(F.col("x2") > F.col("x1"), -F.col("way")).otherwise(F.col("way")).alias("sign")))


def polygon_pieces(layer: tuple[DataFrame, DataFrame], key: str, other_levels: list[int], keep: list[str], meeting: bool = False) -> DataFrame:
    """A feature as signed trapezoids inside cells: x range, heights above the cell's bottom at both ends, and sign.

    Inside one cell the feature's area is the sum of its pieces. A piece is either a part of an edge or a stretch of the cell's
    top side that is inside the feature, so no piece depends on edges outside its cell. With `meeting`, only levels that the other layer
    also has are made.
    """
    spread, edges = (tiling.at_levels(frame, other_levels, meeting) for frame in layer)
    ids = [key, "own", *keep]
    size = F.col("size")
    parts = edge_pieces(edges, ids)

    # Stretches of the top side: the corner flag of the cell above, changed where edges cross the line.
    events = tiling.line_events(edges)
    flags = tiling.corner_flags(spread, events, ids).filter("winding <> 0").withColumn("size", tiling.cell_size(F.col("level")))
    tops = flags.select(*ids, "level", (F.col("row") - 1).alias("row"), "col", (F.col("col") * size).alias("xa"),
                        ((F.col("col") + 1) * size).alias("xb"), size.alias("ha"), size.alias("hb"), F.col("winding").alias("sign"))
    # Where the first corner is not beyond the crossing, nothing is left of the cell's top side.
    crossed = events.filter("NOT at_corner").withColumn("col", F.col("col") - 1).select(
        *ids, "level", (F.col("row") - 1).alias("row"), "col",
        F.least(F.greatest(F.col("at"), F.col("col") * size), (F.col("col") + 1) * size).alias("xa"),
        ((F.col("col") + 1) * size).alias("xb"), size.alias("ha"), size.alias("hb"), F.col("turn").alias("sign"))
    return parts.unionByName(tops).unionByName(crossed)


def _shared_integrals(pairs: DataFrame) -> DataFrame:
    """Add `part`: the signed integral of the lower one of two straight heights over the x range both pieces have.

    Each step is a projection of its own, so no long expression is repeated in the generated code.
    """
    def height(p, x):
        xa, xb, ha, hb = (F.col(f"{p}_{c}") for c in ("xa", "xb", "ha", "hb"))
        return ha + F.try_divide((F.col(x) - xa) * (hb - ha), xb - xa)
    steps = (pairs.withColumn("x0", F.greatest("p_xa", "a_xa")).withColumn("x1", F.least("p_xb", "a_xb"))
             .withColumns({"p0": height("p", "x0"), "p1": height("p", "x1"), "a0": height("a", "x0"), "a1": height("a", "x1")})
             .withColumns({"d0": F.col("p0") - F.col("a0"), "d1": F.col("p1") - F.col("a1")})
             .withColumn("spread", F.abs("d0") + F.abs("d1")))
    crossing = F.try_divide(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1"), F.col("spread") * 2)
    gap = F.when(F.col("d0") * F.col("d1") >= 0, F.col("spread") / 2).otherwise(crossing)
    mean = (F.col("p0") + F.col("p1") + F.col("a0") + F.col("a1")) / 2
    return steps.withColumn("part", F.col("p_sign") * F.col("a_sign") * (F.col("x1") - F.col("x0")) / 2 * (mean - gap))


def area_shares(polygons: DataFrame, areas: DataFrame, polygon_id: str = "id", polygon_geom: str = "geom",
                code: str = "code", geom: str = "geom") -> DataFrame:
    """One row per polygon and area with a positive overlap: `polygon_id`, `area_code`, `overlap`, `area_share`.

    Overlaps are found cell by cell: an equi-join on the cell, a closed-form integral per pair of pieces, and one sum
    that is combined before the shuffle. Coordinates must be metric. Polygons whose rings cross, wind twice or lie outside each other are
    measured by the even-odd rule; the areas must be valid.
    """
    whole = geo.polygon_area(F.col("geom")).alias("whole")
    plain = geo.is_convex(F.col("geom")).alias("plain")
    shapes = dealt(polygons.select(F.col(polygon_id).alias("pid"), F.col(polygon_geom).alias("geom")), "pid").select("*", whole, plain)
    left = tiling.tile_layer(shapes, "pid", "geom", ["whole", "plain"])
    right = tiling.tile_layer(areas.select(F.col(code).alias("area_code"), F.col(geom).alias("geom")), "area_code", "geom")
    levels = tiling.levels_of(right[0])
    p = None
    doubted = tuple(frame.filter("NOT plain") for frame in left)
    if doubted[0].limit(1).count():
        bad = durable_rows(even_odd.faulty(polygon_pieces(doubted, "pid", [], ["whole"]), "pid", ["pid", "own", *CELL]))
        if bad.limit(1).count():
            listed = broadcast_if_small(bad)
            sound, faulty = (tuple(frame.join(listed, "pid", kind) for frame in left) for kind in ("left_anti", "left_semi"))
            p = polygon_pieces(sound, "pid", levels, ["whole"], meeting=True).unionByName(
                even_odd.mended(polygon_pieces(faulty, "pid", levels, ["whole"]), "pid", listed, "whole"))
    if p is None:
        p = polygon_pieces(left, "pid", levels, ["whole"], meeting=True)
    a = polygon_pieces(right, "area_code", tiling.levels_of(left[0]), [], meeting=True)
    shape = ["own", "xa", "xb", "ha", "hb", "sign"]
    p, a = (f.withColumnsRenamed({c: f"{n}_{c}" for c in shape}) for f, n in ((p, "p"), (a, "a")))
    # Pieces meet at the coarser of their two levels: a polygon at its own level meets every area there, a repeated one only areas that
    # are at home there. With the role in the key no other pair is made.
    home = F.lit("home")
    p = p.withColumn("role", F.when(F.col("p_own") == F.col("level"), home).otherwise(F.lit("guest")))
    a = a.withColumn("role", F.explode(F.when(F.col("a_own") == F.col("level"), F.array(home, F.lit("guest"))).otherwise(F.array(home))))
    pairs = p.join(a.hint("merge"), [*CELL, "role"]).filter((F.col("p_xa") < F.col("a_xb")) & (F.col("a_xa") < F.col("p_xb")))
    return (_shared_integrals(pairs).groupBy("pid", "area_code")
            .agg(F.sum("part").alias("overlap"), F.max("whole").alias("whole"))
            # Sums of floats leave a trace where polygons only touch.
            .filter((F.col("whole") > 0) & (F.col("overlap") > F.col("whole") * 1e-12))
            .select(F.col("pid").alias(polygon_id), "area_code", "overlap", (F.col("overlap") / F.col("whole")).alias("area_share")))


def assign_polygons(polygons: DataFrame, shares: DataFrame, polygon_id: str = "id") -> DataFrame:
    """The area with the largest share of each polygon (ties: the lower code), unless more of it lies outside all areas."""
    tie = F.round(F.col("area_share"), 12)
    won = (shares.groupBy(polygon_id)
           .agg(F.min(F.struct((-tie).alias("down"), F.col("area_code"), F.col("area_share"))).alias("win"),
                F.sum("area_share").alias("inside"), F.count(F.lit(1)).alias("touched")))
    joined = polygons.select(polygon_id).join(won, polygon_id, "left")
    winner = F.coalesce(F.col("win.area_share"), F.lit(0.0))
    outside = F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("inside"), F.lit(0.0)))
    return joined.select(
        polygon_id, F.when(outside <= winner + 1e-12, F.col("win.area_code")).alias("assigned_area"),
        winner.alias("winner_share"), outside.alias("outside_share"),
        F.coalesce(F.col("touched"), F.lit(0)).alias("n_areas_touched"))


def school_group(catch_type: Column) -> Column:
    """The catchment group of a type: infants, primary or high."""
    text = F.upper(catch_type)
    return (F.when(text.contains("INFANT"), "infants").when(text.contains("PRIMARY"), "primary")
            .when(text.contains("HIGH"), "high"))


def fractional_counts(shares: DataFrame, groups: DataFrame, polygon_id: str, group: str, names: list[str]) -> DataFrame:
    """Per area and group, the sum of the polygons' area shares, one column per group; 0 where a group has none."""
    summed = (shares.join(groups.select(polygon_id, group), polygon_id)
              .groupBy("area_code").agg(*[F.sum(F.when(F.col(group) == n, F.col("area_share")).otherwise(0.0)).alias(n) for n in names]))
    return summed


def feature_counts(areas: DataFrame, code: str, layers: dict[str, DataFrame], area_code: str = "area_code") -> DataFrame:
    """Features per area and layer, 0 for areas with none.

    All layers are stacked and counted in one pass, so every layer is combined before the one shuffle.
    """
    stacked = None
    for name, frame in layers.items():
        one = frame.filter(F.col(area_code).isNotNull()).select(F.col(area_code).alias(code), F.lit(name).alias("_layer"))
        stacked = one if stacked is None else stacked.unionByName(one)
    counts = stacked.groupBy(code).agg(*[F.count_if(F.col("_layer") == n).alias(n) for n in layers])
    return areas.join(counts, code, "left").fillna(0, subset=list(layers))


def split_points(assigned: DataFrame, areas: DataFrame, geom: str, margin: float, x: str = "x", y: str = "y",
                 area_code: str = "area_code") -> DataFrame:
    """Label assigned points `counted`, `near` (outside, within `margin` of the areas' total bounds) or `far`."""
    box = only_row(total_bounds(areas, geom))
    near = (F.col(x).between(box["minx"] - margin, box["maxx"] + margin)
            & F.col(y).between(box["miny"] - margin, box["maxy"] + margin))
    return assigned.withColumn("place", F.when(F.col(area_code).isNotNull(), "counted").when(near, "near").otherwise("far"))


def total_bounds(features: DataFrame, geom: str) -> DataFrame:
    """One row with the bounds of all features together."""
    box = features.select(geo.bounds(geo.vertices(F.col(geom))).alias("b"))
    return box.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"),
                   F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
