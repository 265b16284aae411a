"""Registered queries of the spatial operators, on a strip of supplier squares with order points and part rectangles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import projection, scores
from ..operators import areas as joins
from ..operators import network, reports, scoring, spatial_stats
from ..session import durable
from . import areas
from .areas import SCORED_SQL, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


SQUARES_SQL = """sq AS (SELECT s_suppkey AS code, s_name AS area_name, s_suppkey % 7 + 1 AS area_km2, s_suppkey % 10 AS c, s_suppkey // 10 AS r FROM supplier)"""
SITES_SQL = """site AS (SELECT o_orderkey AS id, o_orderstatus, (o_custkey * 37 % 441) / 40.0::DOUBLE - 0.5 AS x,
    (o_orderkey * 91 % ((SELECT count(*) FROM supplier) * 4 + 41)) / 40.0::DOUBLE - 0.5 AS y FROM orders)"""
ASSIGN_SQL = f"""{SQUARES_SQL}, {SITES_SQL}, asg AS (SELECT id, min(code) AS area_code, any_value(o_orderstatus) AS o_orderstatus, any_value(x) AS x, any_value(y) AS y
    FROM site LEFT JOIN sq ON x >= c AND x <= c + 1 AND y >= r AND y <= r + 1 GROUP BY id)"""
BLOCKS_SQL = """corner AS (SELECT p_partkey AS id, p_type, (p_partkey * 7 % 88) / 8.0::DOUBLE - 0.5 AS x0, (p_partkey * 11 % (SELECT count(*) FROM supplier)) / 8.0::DOUBLE - 0.5 AS y0,
    (p_partkey % 5 + 1) / 4.0::DOUBLE AS w, (p_partkey % 3 + 1) / 4.0::DOUBLE AS h FROM part), blk AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM corner)"""
SHARES_SQL = f"""{SQUARES_SQL}, {BLOCKS_SQL}, shr AS (SELECT id, code AS area_code, p_type,
    (least(x1, c + 1) - greatest(x0, c)) * (least(y1, r + 1) - greatest(y0, r)) AS overlap,
    (least(x1, c + 1) - greatest(x0, c)) * (least(y1, r + 1) - greatest(y0, r)) / (w * h) AS area_share
    FROM blk JOIN sq ON least(x1, c + 1) > greatest(x0, c) AND least(y1, r + 1) > greatest(y0, r))"""


def _assigned(spark, sf):
    return joins.assign_points(areas.sites(spark, sf), areas.squares(spark, sf))


def _shares(spark, sf):
    return joins.area_shares(areas.blocks(spark, sf), areas.squares(spark, sf))


@query("points_to_areas", f"WITH {ASSIGN_SQL} SELECT id, area_code FROM asg")
def points_to_areas(spark, sf):
    return _assigned(spark, sf).select("id", "area_code")


@query("area_densities", f"""WITH {ASSIGN_SQL}, n AS (SELECT code, any_value(area_name) AS area_name, any_value(area_km2) AS area_km2,
    count(id) FILTER (WHERE o_orderstatus = 'F') AS filled, count(id) FILTER (WHERE o_orderstatus = 'O') AS open,
    count(id) FILTER (WHERE o_orderstatus = 'P') AS pending FROM sq LEFT JOIN asg ON area_code = code GROUP BY code)
    SELECT code, CASE WHEN code % 9 = 0 THEN 'area ' || code ELSE area_name END AS name, filled, open, pending,
    round(filled::DOUBLE / area_km2, 6) AS filled_per_km2, filled > 0 OR open > 0 AS scored FROM n""")
def area_densities(spark, sf):
    placed = _assigned(spark, sf)
    layers = {n: placed.filter(F.col("o_orderstatus") == s) for n, s in (("filled", "F"), ("open", "O"), ("pending", "P"))}
    counted = joins.feature_counts(areas.squares(spark, sf).drop("geom"), "code", layers)
    own_name = F.when(F.col("code") % 9 != 0, F.col("area_name"))
    return counted.select(
        "code", F.coalesce(own_name, F.concat(F.lit("area "), F.col("code").cast("string"))).alias("name"), "filled", "open", "pending",
        F.round(scores.density(F.col("filled"), F.col("area_km2")), 6).alias("filled_per_km2"),
        scores.scored_flag(F.col("filled"), F.col("open")).alias("scored"))


@query("density_total_check", """SELECT s_suppkey AS code, count(l_suppkey) AS total FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def density_total_check(spark, sf):
    wide = areas.indicators(spark, sf)
    return wide.select("code", scores.total_behind_density(F.col("lines_per_km2"), F.col("area_km2")).alias("total"))


@query("counted_outside", f"""WITH {ASSIGN_SQL}, b AS (SELECT min(c) AS x0, min(r) AS y0, max(c) + 1 AS x1, max(r) + 1 AS y1 FROM sq),
    p AS (SELECT CASE WHEN area_code IS NOT NULL THEN 'counted' WHEN x BETWEEN x0 - 0.3 AND x1 + 0.3 AND y BETWEEN y0 - 0.3 AND y1 + 0.3 THEN 'near' ELSE 'far' END AS place FROM asg, b)
    SELECT place, count(*) AS n FROM p GROUP BY place""")
def counted_outside(spark, sf):
    split = joins.split_points(_assigned(spark, sf), areas.squares(spark, sf), "geom", 0.3)
    return split.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("area_shares", f"WITH {SHARES_SQL} SELECT id, area_code, round(area_share, 6) AS area_share FROM shr")
def area_shares(spark, sf):
    return _shares(spark, sf).select("id", "area_code", F.round("area_share", 6).alias("area_share"))


@query("area_shares_crossed", """WITH k AS (SELECT count(*) AS n FROM supplier), p AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, (p_partkey * 13 % (n * 8)) / 4.0::DOUBLE AS cx,
    (p_partkey % 5 + 1) / 2.0::DOUBLE AS a, (p_partkey % 3 + 1) / 2.0::DOUBLE AS b FROM part, k),
    m AS (SELECT id, s_suppkey AS area_code, kind, a, b, least(greatest((s_suppkey - 1) * 2 - cx, -a), a) AS t0, least(greatest(s_suppkey * 2 - cx, -a), a) AS t1 FROM p
      JOIN supplier ON (s_suppkey - 1) * 2 < cx + a AND s_suppkey * 2 > cx - a),
    t AS (SELECT id, area_code, kind, a, b, unnest([t0, t1]) AS t, unnest([-1, 1]) AS way FROM m),
    c AS (SELECT id, area_code, way, CASE kind WHEN 0 THEN (a + sign(t) * t * t / a) / (2 * a) WHEN 1 THEN (2 * (t + a) - least(greatest(t + a / 2, 0), a)) / (3 * a)
      ELSE CASE WHEN t < 0 THEN (a + t) * (a + t) / (2 * a * a) ELSE 1 - (a - t) * (a - t) / (2 * a * a) END END AS upto FROM t)
    SELECT id, area_code, round(sum(way * upto), 6) AS area_share FROM c GROUP BY id, area_code HAVING sum(way * upto) > 1e-9""")
def area_shares_crossed(spark, sf):
    """Bow ties, rings that wind twice round their middle, tilted squares and hourglasses over vertical strips."""
    n = table(spark, sf, "supplier").count()
    key = F.col("p_partkey")
    cx, a, b = key * 13 % (n * 8) / F.lit(4.0), (key % 5 + 1) / F.lit(2.0), (key % 3 + 1) / F.lit(2.0)

    def ring(*corners):
        return F.array(*[F.struct((F.col("cx") + F.col("a") * u).alias("x"), (F.col("b") * v).alias("y")) for u, v in corners])
    outer, inner = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)]
    kind = F.col("kind")
    shape = (F.when(kind == 0, ring((-1, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))).when(kind == 1, ring(*outer, *inner, (-1, -1)))
             .when(kind == 2, ring((-1, 0), (0, -1), (1, 0), (0, 1), (-1, 0))).otherwise(ring((-1, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))))
    shapes = table(spark, sf, "part").select(key.alias("id"), (key % 4).alias("kind"), cx.alias("cx"), a.alias("a"), b.alias("b"))
    shapes = durable(shapes.select("id", F.array(F.array(shape)).alias("geom")))
    edge = (F.col("s_suppkey") - 1) * F.lit(2.0)
    strips = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), geo.rectangle(edge, F.lit(-4.0), edge + 2, F.lit(4.0)).alias("geom"))
    shares = joins.area_shares(shapes, strips).filter("area_share > 1e-9")
    # Shares of a bow tie may lie exactly between two rounded values; the first rounding takes the trace that sums of floats leave there.
    return shares.select("id", "area_code", F.round(F.round("area_share", 9), 6).alias("area_share"))


@query("assign_polygons", f"""WITH {SHARES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area_share DESC, area_code) AS k FROM shr),
    g AS (SELECT id, max(area_share) AS win, sum(area_share) AS inside, count(*) AS n, max(CASE WHEN k = 1 THEN area_code END) AS code FROM k GROUP BY id)
    SELECT p_partkey AS id, CASE WHEN greatest(0, 1 - inside) <= win + 1e-12 THEN code END AS assigned_area, round(coalesce(win, 0), 6) AS winner_share,
    round(greatest(0, 1 - coalesce(inside, 0)), 6) AS outside_share, coalesce(n, 0) AS n_areas_touched FROM part LEFT JOIN g ON id = p_partkey""")
def assign_polygons(spark, sf):
    out = joins.assign_polygons(areas.blocks(spark, sf), _shares(spark, sf))
    return out.select("id", "assigned_area", F.round("winner_share", 6).alias("winner_share"),
                      F.round("outside_share", 6).alias("outside_share"), "n_areas_touched")


@query("fractional_counts", f"""WITH {SHARES_SQL} SELECT area_code, round(coalesce(sum(area_share) FILTER (WHERE p_type = 'ECONOMY'), 0), 6) AS primary,
    round(coalesce(sum(area_share) FILTER (WHERE p_type = 'SMALL'), 0), 6) AS high, round(coalesce(sum(area_share) FILTER (WHERE p_type = 'PROMO'), 0), 6) AS infants
    FROM shr GROUP BY area_code""")
def fractional_counts(spark, sf):
    blocks = areas.blocks(spark, sf)
    kinds = F.when(F.col("p_type") == "ECONOMY", "CENTRAL_PRIMARY").when(F.col("p_type") == "SMALL", "HIGH_COED").when(F.col("p_type") == "PROMO", "INFANTS")
    groups = blocks.select("id", joins.school_group(kinds).alias("school_group"))
    names = ["primary", "high", "infants"]
    counts = joins.fractional_counts(_shares(spark, sf), groups, "id", "school_group", names)
    return counts.select("area_code", *[F.round(n, 6).alias(n) for n in names])


@query("hover_totals", f"""WITH {SHARES_SQL}, f AS (SELECT area_code, round(coalesce(sum(area_share) FILTER (WHERE p_type = 'ECONOMY'), 0), 4) AS "primary" FROM shr GROUP BY area_code),
    n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT code, coalesce(n, 0) AS lines, "primary" FROM sq LEFT JOIN f ON area_code = code LEFT JOIN n ON l_suppkey = code""")
def hover_totals(spark, sf):
    groups = areas.blocks(spark, sf).select("id", F.when(F.col("p_type") == "ECONOMY", "primary").alias("school_group"))
    fractions = joins.fractional_counts(_shares(spark, sf), groups, "id", "school_group", ["primary"])
    return reports.hover_totals(areas.indicators(spark, sf), "code", {"lines": "lines_per_km2"}, "area_km2", fractions, ["primary"], digits=4)


@query("street_intersections", """WITH v AS (SELECT l_partkey AS x, l_suppkey AS y,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    g AS (SELECT x, y, sum(CASE WHEN k = 1 OR k = n THEN 1 ELSE 2 END) AS legs FROM v GROUP BY x, y)
    SELECT x::DOUBLE AS x, y::DOUBLE AS y, legs FROM g WHERE legs >= 3""")
def street_intersections(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return network.intersections_of_vertices(lines, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")],
                                             F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"))


@query("centroid_area", f"WITH {BLOCKS_SQL} SELECT id, round(w * h, 6) AS area, round((x0 + x1) / 2, 6) AS x, round((y0 + y1) / 2, 6) AS y FROM blk")
def centroid_area(spark, sf):
    blocks = areas.blocks(spark, sf)
    c = geo.polygon_centroid(F.col("geom"))
    return blocks.select("id", F.round(geo.polygon_area(F.col("geom")), 6).alias("area"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))


@query("total_bounds", f"WITH {BLOCKS_SQL} SELECT min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM blk")
def total_bounds(spark, sf):
    return joins.total_bounds(areas.blocks(spark, sf), "geom")


@query("snap_vertices", f"""WITH {BLOCKS_SQL}, v AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS k, unnest([x0, x1, x1, x0, x0]) AS x, unnest([y0, y0, y1, y1, y0]) AS y FROM blk),
    s AS (SELECT id, k, round(x / 0.5) * 0.5 AS x, round(y / 0.5) * 0.5 AS y FROM v), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY id ORDER BY k)),
    n AS (SELECT id, count(*) FILTER (WHERE px IS NULL OR px <> x OR py <> y) AS n FROM l GROUP BY id)
    SELECT id, CASE WHEN n >= 4 THEN n ELSE 0 END AS vertices FROM n""")
def snap_vertices(spark, sf):
    blocks = areas.blocks(spark, sf)
    return blocks.select("id", F.size(geo.vertices(geo.snap_polygon(F.col("geom"), 0.5))).alias("vertices"))


def _tm_sql():
    """The forward series spelled out as SQL over columns lon and lat."""
    import math
    n = projection.MGA56.third
    e = 2 * math.sqrt(n) / (1 + n)
    terms = list(enumerate(projection._forward_terms(n), start=1))
    east = " + ".join([f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in terms])
    north = " + ".join([f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in terms])
    return f"""t0 AS (SELECT id, sin(radians(lat)) AS s, radians(lon - 153.0) AS l FROM pts),
    t1 AS (SELECT id, l, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM t0),
    t2 AS (SELECT id, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t1),
    t3 AS (SELECT id, {projection.MGA56.reach!r} * (eta + {east}) + 500000.0 AS x, {projection.MGA56.reach!r} * (xi + {north}) + 10000000.0 AS y FROM t2)"""


@query("reproject", f"""WITH pts AS (SELECT c_custkey AS id, 150 + (c_custkey % 200) / 100.0::DOUBLE AS lon, -34.5 + (c_custkey // 200 % 200) / 100.0::DOUBLE AS lat FROM customer),
    {_tm_sql()} SELECT id, round(x, 3) AS x, round(y, 3) AS y, 0.0::DOUBLE AS round_trip_error FROM t3""")
def reproject(spark, sf):
    key = F.col("c_custkey")
    points = table(spark, sf, "customer").select(
        key.alias("id"), (key % 200 / F.lit(100.0) + 150).alias("lon"), (F.floor(key / 200) % 200 / F.lit(100.0) - 34.5).alias("lat"))
    metres = points.withColumn("m", projection.to_metres(F.col("lon"), F.col("lat")))
    back = metres.withColumn("b", projection.to_degrees(F.col("m.x"), F.col("m.y")))
    error = F.greatest(F.abs(F.col("b.x") - F.col("lon")), F.abs(F.col("b.y") - F.col("lat")))
    return back.select("id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round(error, 7).alias("round_trip_error"))


PAIRS_SQL = f"""{SQUARES_SQL}, pr AS (SELECT a.code AS i, b.code AS j FROM sq a JOIN sq b ON a.code <> b.code AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1),
    wt AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM pr)"""
Z_SQL = f"z AS (SELECT code, {areas.z_sql('index_z')} AS z FROM idx)"


def _weights(spark, sf):
    return durable(network.row_weights(network.neighbours(areas.squares(spark, sf))))


def _z(spark, sf):
    layer = scoring.score_index(durable(areas.indicators(spark, sf)), areas.PILLARS, areas.DENSITIES)
    return durable(scoring.zscores(layer, ["index_z"]).select("code", F.col("index_z_z").alias("z")))


@query("contiguity", f"WITH {PAIRS_SQL} SELECT i, j, round(w, 6) AS w FROM wt")
def contiguity(spark, sf):
    return _weights(spark, sf).select("i", "j", F.round("w", 6).alias("w"))


MORAN_SQL = f"""{SCORED_SQL}, {Z_SQL}, {PAIRS_SQL}, lg AS (SELECT a.code, a.z, coalesce(sum(w * b.z), 0) AS nm, count(b.z) AS k FROM z a
    LEFT JOIN wt ON wt.i = a.code LEFT JOIN z b ON b.code = wt.j GROUP BY a.code, a.z)"""


@query("morans_global", f"WITH {MORAN_SQL} SELECT round(count(*) / sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) * sum(z * nm) / sum(z * z), 6) AS morans_i FROM lg")
def morans_global(spark, sf):
    return spatial_stats.global_moran(_z(spark, sf), _weights(spark, sf)).select(F.round("morans_i", 6).alias("morans_i"))


@query("morans_local", f"WITH {MORAN_SQL} SELECT code, round(nm, 6) AS neighbour_mean, round(z * nm, 6) AS local_i, k AS neighbours FROM lg")
def morans_local(spark, sf):
    local = spatial_stats.local_moran(_z(spark, sf), _weights(spark, sf))
    return local.select("code", F.round("neighbour_mean", 6).alias("neighbour_mean"), F.round("local_i", 6).alias("local_i"), "neighbours")


REPS, SEED = 999, 20260926
# The shuffles spelled out: the keys of every replicate and, per area, where its place goes.
SHUFFLE_SQL = f"""pl AS (SELECT code, z, row_number() OVER (ORDER BY code) - 1 AS pos FROM z), nn AS (SELECT count(*) AS n FROM z),
    ky AS (SELECT rep, list(('0x' || substr(md5('{SEED}:' || rep || ':' || r), 1, 7))::BIGINT ORDER BY r) AS ks
      FROM (SELECT unnest(range(1, {REPS + 1})) AS rep) a, (SELECT unnest(range(1, {spatial_stats.ROUNDS + 1})) AS r) b GROUP BY rep),
    sh AS (SELECT rep, code, z, n, list_reduce(list_prepend(pos, ks), lambda x, k: CASE WHEN ((((greatest(x, ((k - x) % n + n) % n) + k) % {spatial_stats.PRIME})
      * ((greatest(x, ((k - x) % n + n) % n) + k) % {spatial_stats.PRIME})) % {spatial_stats.PRIME} >> 8) & 1 = 1 THEN ((k - x) % n + n) % n ELSE x END) AS slot FROM pl, ky, nn)"""


@query("morans_p", f"""WITH {MORAN_SQL}, {SHUFFLE_SQL},
    wp AS (SELECT a.pos AS pi, b.pos AS pj, w FROM wt JOIN pl a ON a.code = i JOIN pl b ON b.code = j),
    st AS (SELECT a.rep, sum(w * a.z * b.z) AS cross FROM wp JOIN sh a ON a.slot = pi JOIN sh b ON b.slot = pj AND a.rep = b.rep GROUP BY a.rep),
    ob AS (SELECT sum(w * a.z * b.z) AS cross FROM wp JOIN pl a ON a.pos = pi JOIN pl b ON b.pos = pj),
    sc2 AS (SELECT count(*) / sum(z * z) / (SELECT sum(w) FROM wt) AS f FROM z)
    SELECT round(any_value(ob.cross * f), 6) AS morans_i, (1 + count(*) FILTER (WHERE round(abs(st.cross * f), 9) >= round(abs(ob.cross * f), 9))) / {REPS + 1} AS p_value FROM st, ob, sc2""")
def morans_p(spark, sf):
    return spatial_stats.global_moran_p(_z(spark, sf), _weights(spark, sf), REPS, SEED).select(F.round("morans_i", 6).alias("morans_i"), "p_value")


@query("hotspot_labels", f"""WITH {MORAN_SQL}, {SHUFFLE_SQL}, ord AS (SELECT rep, code, z, slot + 1 AS slot FROM sh),
    dr AS (SELECT l.code, o.rep, o.z, row_number() OVER (PARTITION BY l.code, o.rep ORDER BY o.slot) AS d, l.k, l.z AS own, l.z * l.nm AS li
      FROM lg l JOIN ord o ON o.code <> l.code AND o.slot <= l.k + 1),
    sm AS (SELECT code, rep, own * sum(z) / any_value(k) AS sim, any_value(li) AS li FROM dr WHERE d <= k GROUP BY code, rep, own),
    pv AS (SELECT code, (1 + count(*) FILTER (WHERE round(abs(sim), 9) >= round(abs(li), 9))) / {REPS + 1} AS p FROM sm GROUP BY code)
    SELECT lg.code, coalesce(p, 1.0) AS p_value, CASE WHEN coalesce(p, 1.0) >= 0.05 THEN 'not significant' ELSE
      (CASE WHEN z >= 0 THEN 'high' ELSE 'low' END) || '-' || (CASE WHEN nm >= 0 THEN 'high' ELSE 'low' END) END AS hotspot_class,
    round(100 + 10 * nm, 6) AS neighbour_average_score FROM lg LEFT JOIN pv USING (code)""")
def hotspot_labels(spark, sf):
    local = durable(spatial_stats.local_moran(_z(spark, sf), _weights(spark, sf)))
    labelled = spatial_stats.hotspots(spatial_stats.local_moran_p(local, REPS, SEED))
    return labelled.select("code", "p_value", "hotspot_class", F.round("neighbour_average_score", 6).alias("neighbour_average_score"))


@query("chance_positions", """SELECT s_suppkey AS code FROM supplier QUALIFY row_number() OVER (ORDER BY md5('20261001:' || s_suppkey), s_suppkey)
    <= round_even(0.05 * (SELECT count(*) FROM supplier), 0)""")
def chance_positions(spark, sf):
    return spatial_stats.chance_positions(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code")))


@query("ring_problems", """SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 0 THEN ['open'] WHEN 1 THEN ['crossing'] WHEN 2 THEN ['flat', 'short'] ELSE [] END) AS problem FROM part""")
def ring_problems(spark, sf):
    """Rings made from the parts: open squares, tilted bow ties, two-point lines there and back, and sound squares."""
    key = F.col("p_partkey")
    x, y = (key % 97).cast("double"), (key % 89).cast("double")

    def ring(*corners):
        return F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners])
    kind = key % 4
    shape = (F.when(kind == 0, ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0.5)))
             .when(kind == 1, ring((0, 0), (2, 1), (2, 0), (0, 2), (0, 0)))
             .when(kind == 2, ring((0, 0), (1, 1), (0, 0)))
             .otherwise(ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    rings = table(spark, sf, "part").select(key.alias("id"), F.array(F.array(shape)).alias("geom"))
    return network.ring_problems(rings, "id")


@query("ring_relations", """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 1 THEN 'hole_outside' WHEN 2 THEN 'rings_cross' WHEN 3 THEN 'hole_in_hole' WHEN 4 THEN 'parts_overlap' WHEN 5 THEN 'rings_cross'
    ELSE 'crossing' END AS problem FROM part WHERE p_partkey % 7 <> 0""")
def ring_relations(spark, sf):
    """Shells with sound holes, holes outside, over the border or in each other, parts in and over each other, and a ring through its own upright side."""
    key = F.col("p_partkey")
    x, y, size = (key % 97).cast("double") / 3, (key % 89).cast("double") / 7, (key % 5 + 1).cast("double")

    def ring(*corners):
        return F.array(*[F.struct((F.col("x") + F.col("size") * a).alias("x"), (F.col("y") + F.col("size") * b).alias("y")) for a, b in corners])

    def square(a, b, c, d):
        return ring((a, b), (c, b), (c, d), (a, d), (a, b))
    shell, tilted = square(0, 0, 6, 6), ring((1, 3), (3, 1), (5, 3), (3, 5), (1, 3))
    kind = F.col("kind")
    shape = (F.when(kind == 0, F.array(F.array(shell, tilted), F.array(square(7, 0, 8, 1)), F.array(square(2.5, 2.5, 3.5, 3.5)))).when(kind == 1, F.array(F.array(shell, square(7, 7, 8, 8))))
             .when(kind == 2, F.array(F.array(shell, square(4, 4, 8, 5)))).when(kind == 3, F.array(F.array(shell, tilted, square(2.5, 2.5, 3.5, 3.5))))
             .when(kind == 4, F.array(F.array(shell), F.array(tilted))).when(kind == 5, F.array(F.array(tilted), F.array(square(0, 2.5, 9, 3))))
             .otherwise(F.array(F.array(ring((0, 0), (6, 0), (6, 6), (7, 3), (4, 3), (0, 6), (0, 0))))))
    shapes = table(spark, sf, "part").select(key.alias("id"), (key % 7).alias("kind"), x.alias("x"), y.alias("y"), size.alias("size"))
    return network.ring_problems(shapes.select("id", shape.alias("geom")), "id")
