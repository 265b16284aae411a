"""Registered queries of the index: scores, versions, ranks and report tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import ranking, reports, scoring
from ..session import durable, only_row
from . import areas
from .areas import DENSITIES, PILLARS, SCORED_SQL, table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


SCORE_COLUMNS = ("intensity_score", "diversity_score", "design_score", "score")


@query("index_scores", f"WITH {SCORED_SQL} SELECT code, area_name, {r6_sql(*SCORE_COLUMNS)}, rank, quintile FROM final")
def index_scores(spark, sf):
    return areas.scored(spark, sf).select("code", "area_name", *r6(*SCORE_COLUMNS), "rank", "quintile")


@query("entropy_by_area", f"WITH {areas.INDICATORS_SQL} SELECT code, round(flag_mix, 6) AS flag_mix, round(month_mix, 6) AS month_mix FROM ind")
def entropy_by_area(spark, sf):
    return areas.indicators(spark, sf).select("code", *r6("flag_mix", "month_mix"))


@query("zscore_minmax", f"""SELECT p_partkey, round({areas.z_sql('p_retailprice')}, 6) AS price_z,
    round((ln(1 + p_size) - min(ln(1 + p_size)) OVER ()) / nullif(max(ln(1 + p_size)) OVER () - min(ln(1 + p_size)) OVER (), 0), 6) AS size_scaled FROM part""")
def zscore_minmax(spark, sf):
    parts = scoring.zscores(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice"])
    scaled = scoring.scale_indicators(parts, ["p_size"], ["p_size"], scale="minmax")
    return scaled.select("p_partkey", F.round("p_retailprice_z", 6).alias("price_z"), F.round("p_size", 6).alias("size_scaled"))


VERSIONS = scoring.standard_versions(PILLARS) + [scoring.Version("intensity twice", weights={"intensity": 2.0})]


def _version_ranks(spark, sf):
    wide = areas.indicators(spark, sf)
    return scoring.version_ranks(scoring.version_scores(wide, "code", PILLARS, DENSITIES, VERSIONS), "code")


def _version_sql():
    """All versions as one UNION over raw, logged and rescaled indicators."""
    columns = [c for names in PILLARS.values() for c in names]

    def logged(c):
        return f"ln(1 + {c})" if c in DENSITIES else c

    def minmax(e):
        return f"(({e} - min({e}) OVER ()) / nullif(max({e}) OVER () - min({e}) OVER (), 0))"
    forms = [f"{areas.z_sql(logged(c))} AS {c}_z" for c in columns] + [f"{areas.z_sql(c)} AS {c}_r" for c in columns] + [
        f"{minmax(logged(c))} AS {c}_m" for c in columns]
    branches = []
    for v in VERSIONS:
        suffix = "m" if v.scale == "minmax" else "z" if v.log_densities else "r"
        live = {p: [f"{c}_{suffix}" for c in names if c not in v.drop] for p, names in PILLARS.items()}
        if v.pooled:
            score = areas.mean_sql(*[c for names in live.values() for c in names])
        else:
            means = {p: f"({areas.mean_sql(*names)})" for p, names in live.items() if names}
            top = " + ".join(f"coalesce({m} * {v.weights.get(p, 1.0)}, 0)" for p, m in means.items())
            low = " + ".join(f"(CASE WHEN {m} IS NULL THEN 0 ELSE {v.weights.get(p, 1.0)} END)" for p, m in means.items())
            score = f"({top}) / nullif({low}, 0)"
        branches.append(f"SELECT '{v.name}' AS version, code, {score} AS score FROM forms")
    return f"""WITH {areas.INDICATORS_SQL}, forms AS (SELECT code, {', '.join(forms)} FROM ind),
versions AS ({' UNION ALL '.join(branches)}),
ranks AS (SELECT version, code, score, row_number() OVER (PARTITION BY version ORDER BY score DESC, code) AS rank FROM versions WHERE score IS NOT NULL)"""


VERSION_SQL = _version_sql()
RANGE_SQL = VERSION_SQL + """, ranges AS (SELECT code, max(CASE WHEN version = 'Baseline' THEN rank END) AS baseline_rank,
    min(CASE WHEN version <> 'Baseline' THEN rank END) AS rank_min, max(CASE WHEN version <> 'Baseline' THEN rank END) AS rank_max FROM ranks GROUP BY code)"""


@query("index_variants", VERSION_SQL + " SELECT version, code, round(score, 6) AS score, rank FROM ranks")
def index_variants(spark, sf):
    return _version_ranks(spark, sf).select("version", "code", *r6("score"), "rank")


@query("rank_ranges", RANGE_SQL + " SELECT code, baseline_rank, rank_min, rank_max, rank_max - rank_min AS rank_range FROM ranges")
def rank_ranges(spark, sf):
    return scoring.rank_ranges(_version_ranks(spark, sf), "code")


@query("top_k_overlap", VERSION_SQL + """ SELECT r.version, count(b.code) AS top_overlap FROM ranks r
    LEFT JOIN ranks b ON b.code = r.code AND b.version = 'Baseline' AND b.rank <= 25
    WHERE r.version <> 'Baseline' AND r.rank <= 25 GROUP BY r.version""")
def top_k_overlap(spark, sf):
    return scoring.top_overlap(_version_ranks(spark, sf), "code")


@query("rank_band_summary", RANGE_SQL + """, b AS (SELECT r.*, s_name AS name, rank_max - rank_min AS rr,
    (baseline_rank - 1) * 5 // (SELECT count(*) FROM ranges) AS band FROM ranges r JOIN supplier ON s_suppkey = code),
movers AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rr DESC, baseline_rank, name) AS k FROM b)
SELECT band, ['Top quintile','Second quintile','Middle quintile','Fourth quintile','Bottom quintile'][band + 1] || ' (' || count(*) || ' areas)' AS label,
    count(*) AS areas, round(median(rr), 6) AS median_range, round(avg(rr), 6) AS mean_range, max(rr) AS max_range,
    max(CASE WHEN k = 1 THEN name END) AS mover_name, max(CASE WHEN k = 1 THEN rank_min END) AS mover_rank_min,
    max(CASE WHEN k = 1 THEN rank_max END) AS mover_rank_max FROM movers GROUP BY band""")
def rank_band_summary(spark, sf):
    ranges = durable(scoring.rank_ranges(_version_ranks(spark, sf), "code"))
    named = ranges.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("area_name")), "code")
    return (reports.rank_band_summary(named, ranges.count(), rank="baseline_rank")
            .withColumns({"median_range": F.round("median_range", 6), "mean_range": F.round("mean_range", 6)}))


@query("weighted_score", f"""WITH {SCORED_SQL} SELECT code, round((coalesce(3 * intensity_score, 0) + coalesce(diversity_score, 0) + coalesce(0.5 * design_score, 0))
    / nullif((CASE WHEN intensity_score IS NULL THEN 0 ELSE 3 END) + (CASE WHEN diversity_score IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN design_score IS NULL THEN 0 ELSE 0.5 END), 0), 6) AS weighted_score FROM final""")
def weighted_score(spark, sf):
    weights = {"intensity_score": 3.0, "diversity_score": 1.0, "design_score": 0.5}
    return scoring.weighted_scores(areas.scored(spark, sf), weights).select("code", *r6("weighted_score"))


@query("place_types", f"WITH {SCORED_SQL} SELECT code, place_type, round((intensity_score + design_score) / 2, 1) AS density FROM final")
def place_types(spark, sf):
    return areas.scored(spark, sf).select(
        "code", "place_type", F.round(scores.combined_density(F.col("intensity_score"), F.col("design_score")), 1).alias("density"))


@query("place_type_summary", f"""WITH {SCORED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY place_type ORDER BY rank) AS place FROM final WHERE place_type IS NOT NULL)
    SELECT place_type, count(*) AS areas, sum(quantity) AS residents, string_agg(area_name, ', ' ORDER BY rank) FILTER (WHERE place <= 3) AS best_ranked_examples
    FROM k GROUP BY place_type""")
def place_type_summary(spark, sf):
    return reports.place_type_summary(durable(areas.scored(spark, sf)).withColumnRenamed("quantity", "residents"))


PLACE_LIST = ", ".join(f"({i}, '{p}')" for i, p in enumerate(scores.PLACE_TYPES))


@query("place_type_counts", f"""WITH {SCORED_SQL} SELECT position, l.place_type, count(f.code) AS n FROM (VALUES {PLACE_LIST}) AS l(position, place_type)
    LEFT JOIN final f ON f.place_type = l.place_type GROUP BY position, l.place_type""")
def place_type_counts(spark, sf):
    return reports.class_counts(areas.scored(spark, sf), "place_type", scores.PLACE_TYPES)


@query("global_rank_quintile", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank,
    4 - (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) * 5 // count(*) OVER () AS rank_class FROM orders""")
def global_rank_quintile(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    placed = ranking.ranked(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return placed.select("o_orderkey", "rank", ranking.rank_class(F.col("rank"), orders.count()).alias("rank_class"))


@query("rank_within_group", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def rank_within_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.ranked(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], by=["o_orderpriority"]).select("o_orderkey", "rank")


@query("quantile_values", """SELECT l_returnflag, unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS q,
    round(unnest(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])), 6) AS value FROM lineitem GROUP BY l_returnflag""")
def quantile_values(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return ranking.quantiles(lines, "l_extendedprice", [0.2, 0.4, 0.6, 0.8], by=["l_returnflag"]).select("l_returnflag", "q", *r6("value"))


@query("quantile_labels", """WITH c AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS v FROM orders)
    SELECT unnest([0, 1, 2, 3, 4]) AS position, unnest([format('Top quintile: {:.1f} and above', v[4]), format('Second quintile: {:.1f} to under {:.1f}', v[3], v[4]),
    format('Middle quintile: {:.1f} to under {:.1f}', v[2], v[3]), format('Fourth quintile: {:.1f} to under {:.1f}', v[1], v[2]),
    format('Bottom quintile: under {:.1f}', v[1])]) AS label FROM c""")
def quantile_labels(spark, sf):
    return reports.quantile_labels(table(spark, sf, "orders").select("o_totalprice"), "o_totalprice")


@query("upper_median", """SELECT o_orderpriority, o_totalprice AS upper_median, n FROM (SELECT o_orderpriority, o_totalprice,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k = n // 2 + 1""")
def upper_median(spark, sf):
    return ranking.upper_median(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", by=["o_orderpriority"])


@query("histogram_bins", """WITH v AS (SELECT 60 + floor(o_totalprice / 2500) / 2 AS v FROM orders), bins AS (SELECT unnest(range(30)) AS b)
    SELECT 70 + 2 * b AS bin_start, count(v) FILTER (WHERE v >= 70 + 2 * b AND v < 72 + 2 * b) AS n,
    4 - count(v) FILTER (WHERE v > 71 + 2 * b) * 5 // count(v) AS color_class FROM bins, v GROUP BY b""")
def histogram_bins(spark, sf):
    values = table(spark, sf, "orders").select((F.floor(F.col("o_totalprice") / 2500) / 2 + 60).alias("v"))
    return reports.histogram(values, "v")


@query("group_share", f"""WITH {SCORED_SQL} SELECT count(*) AS areas, round(sum(CASE WHEN quintile = 5 THEN area_km2 ELSE 0 END) / sum(area_km2), 6) AS area_km2_share,
    round(sum(CASE WHEN quintile = 5 THEN quantity ELSE 0 END) / sum(quantity), 6) AS quantity_share FROM final WHERE score IS NOT NULL""")
def group_share(spark, sf):
    layer = areas.scored(spark, sf).filter(F.col("score").isNotNull())
    return reports.group_share(layer, F.col("quintile") == 5, ["area_km2", "quantity"]).select("areas", *r6("area_km2_share", "quantity_share"))


GROUPS = ["lower-income areas", "middle-income areas", "higher-income areas"]


@query("equity_share", f"""WITH {SCORED_SQL}, g AS (SELECT *, ntile(3) OVER (ORDER BY balance, code) AS k FROM final WHERE balance IS NOT NULL)
    SELECT ['lower-income areas', 'middle-income areas', 'higher-income areas'][k] AS income_group, sum(quantity) AS residents,
    round(sum(CASE WHEN quintile = 5 THEN quantity ELSE 0 END) / sum(quantity), 6) AS top_quintile_share,
    round(sum(CASE WHEN quintile = 1 THEN quantity ELSE 0 END) / sum(quantity), 6) AS bottom_quintile_share FROM g GROUP BY k""")
def equity_share(spark, sf):
    layer = durable(areas.scored(spark, sf))
    grouped = reports.income_groups(layer, "balance", "code", GROUPS)
    return reports.equity(grouped, "income_group", "quantity").select(
        "income_group", "residents", *r6("top_quintile_share", "bottom_quintile_share"))


@query("spearman")
def spearman(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return reports.spearman(lines, "l_quantity", "l_extendedprice", by=["l_returnflag"]).select("l_returnflag", "n", *r6("spearman"))


ORACLE["spearman"] = """WITH r AS (SELECT l_returnflag,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY l_returnflag"""

CORR = ["lines_per_km2", "quantity_per_km2", "parts_per_km2", "flag_mix", "month_mix", "value_per_km2", "balance"]


@query("corr_matrix", f"WITH {areas.INDICATORS_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM ind" for i, a in enumerate(CORR) for b in CORR[i:]))
def corr_matrix(spark, sf):
    return reports.correlation_matrix(areas.indicators(spark, sf), CORR).select("a", "b", *r6("corr"))


@query("percent_rank_phrase", """WITH v AS (SELECT c_custkey, greatest(c_acctbal, 0) / 1000 AS v, c_custkey % 4 AS total FROM customer),
    s AS (SELECT *, (SELECT count(*) FROM v) AS n, count(*) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below,
      (SELECT count(*) FROM v WHERE v = 0) AS zeros, (SELECT max(v) FROM v) AS top FROM v),
    p AS (SELECT *, CASE WHEN below * 2 >= n THEN 'higher than ' || least(99, floor(below / n * 100 + 0.5)::BIGINT) || '% of areas'
      ELSE 'lower than ' || least(99, floor((n - below) / n * 100 + 0.5)::BIGINT) || '% of areas' END AS phrase FROM s)
    SELECT c_custkey, CASE WHEN v < 1 THEN total || CASE WHEN total = 1 THEN ' stop' ELSE ' stops' END || ' in total'
      ELSE floor(v + 0.5)::BIGINT || CASE WHEN floor(v + 0.5) = 1 THEN ' stop per km2' ELSE ' stops per km2' END END AS display,
    CASE WHEN v = 0 THEN CASE WHEN zeros = 1 THEN 'none, as in no other area' WHEN zeros / n * 100 < 1 THEN 'none, as in fewer than 1% of areas'
      ELSE 'none, as in ' || floor(zeros / n * 100 + 0.5)::BIGINT || '% of areas' END
      WHEN v < 1 THEN 'density ' || phrase WHEN v >= top THEN 'the highest of ' || n || ' areas' ELSE phrase END AS comparison FROM p""")
def percent_rank_phrase(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", (F.greatest("c_acctbal", F.lit(0.0)) / 1000).alias("v"), (F.col("c_custkey") % 4).alias("total"))
    stats = only_row(rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == 0).alias("zeros"), F.max("v").alias("top")))
    placed = reports.percent_positions(rows, "v")
    v = F.col("v")
    return placed.select(
        "c_custkey", scores.display_value(v, F.col("total"), 1, ("stop per km2", "stops per km2"), ("stop", "stops")).alias("display"),
        scores.comparison_phrase(v, F.col("at_or_below"), F.lit(stats["zeros"]), F.lit(stats["top"]), F.lit(stats["n"]), 1).alias("comparison"))


DISTANCE_SQL = SCORED_SQL + """, far AS (SELECT *, sqrt((code % 10 + 0.5 - 2) ** 2 + (code // 10 + 0.5 - 3) ** 2) * 4 AS distance FROM final)"""


def _with_distance(spark, sf):
    from ..functions import geometry as geo
    layer = areas.scored(spark, sf).join(areas.squares(spark, sf).select("code", geo.polygon_centroid(F.col("geom")).alias("c")), "code")
    return layer.withColumn("distance", F.hypot(F.col("c.x") - 2, F.col("c.y") - 3) * 4)


@query("distance_bands", f"""WITH {DISTANCE_SQL}, bands(position, lo, hi, band) AS (VALUES (0, 0, 5, 'Within 5 km'), (1, 5, 10, '5 to 10 km'), (2, 10, 20, '10 to 20 km'),
    (3, 20, 40, '20 to 40 km'), (4, 40, 1e300, 'Over 40 km')),
    k AS (SELECT position, score, row_number() OVER (PARTITION BY position ORDER BY score) AS k, count(*) OVER (PARTITION BY position) AS n
      FROM far JOIN bands ON distance >= lo AND distance < hi)
    SELECT b.position, band, coalesce(n, 0) AS n, round(score, 6) AS upper_median FROM bands b LEFT JOIN k ON k.position = b.position AND k.k = n // 2 + 1""")
def distance_bands(spark, sf):
    return reports.distance_bands(durable(_with_distance(spark, sf)), "distance", "score").withColumn("upper_median", F.round("upper_median", 6))


@query("far_exceptions", f"WITH {DISTANCE_SQL} SELECT code, round(distance, 6) AS distance, round(score, 6) AS score FROM far WHERE distance > 10 ORDER BY score DESC, code LIMIT 3")
def far_exceptions(spark, sf):
    return reports.far_exceptions(_with_distance(spark, sf), "distance", "score", "code").select("code", *r6("distance", "score"))


@query("top_names_per_quintile", f"""WITH {SCORED_SQL} SELECT quintile, place, area_name FROM (SELECT quintile, area_name,
    row_number() OVER (PARTITION BY quintile ORDER BY score DESC, code) AS place FROM final WHERE score IS NOT NULL) WHERE place <= 3""")
def top_names_per_quintile(spark, sf):
    some = areas.scored(spark, sf).filter(F.col("score").isNotNull())
    return reports.top_per_group(some, "quintile", [F.col("score").desc(), F.col("code").asc()], 3).select("quintile", "place", "area_name")


@query("score_middle_share", f"""WITH {SCORED_SQL} SELECT round(avg(CASE WHEN score >= 90 AND score < 110 THEN 1.0 ELSE 0 END), 6) AS middle_share,
    count(*) FILTER (WHERE score < 70) AS below_axis, round(min(score) FILTER (WHERE score < 70), 6) AS lowest FROM final WHERE score IS NOT NULL""")
def score_middle_share(spark, sf):
    return reports.share_within(areas.scored(spark, sf), "score", 90, 110).select(*r6("middle_share"), "below_axis", *r6("lowest"))


@query("area_cards", f"""WITH {SCORED_SQL} SELECT code, area_name, rank, greatest(70, least(130, round(intensity_score, 6))) AS intensity,
    greatest(70, least(130, round(diversity_score, 6))) AS diversity, greatest(70, least(130, round(design_score, 6))) AS design,
    floor(lines_per_km2 + 0.5)::BIGINT AS lines_shown, round(lines_per_km2 * area_km2)::BIGINT AS lines_total FROM final""")
def area_cards(spark, sf):
    def clip(name):
        return F.greatest(F.lit(70.0), F.least(F.lit(130.0), F.round(f"{name}_score", 6))).alias(name)
    layer = areas.scored(spark, sf)
    return layer.select("code", "area_name", "rank", clip("intensity"), clip("diversity"), clip("design"),
                        scores.half_up(F.col("lines_per_km2")).alias("lines_shown"),
                        scores.total_behind_density(F.col("lines_per_km2"), F.col("area_km2")).alias("lines_total"))


@query("layer_extremes", f"""WITH {SCORED_SQL} SELECT min(area_km2) AS smallest, max(area_km2) AS largest, min_by(area_name, (diversity_score, area_name)) AS lowest_name,
    min_by(lines, (diversity_score, area_name)) AS lowest_businesses, round(avg(CASE WHEN lines % 5 = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share FROM final""")
def layer_extremes(spark, sf):
    layer = areas.scored(spark, sf).withColumn("fifth", F.col("lines") % 5)
    return reports.extremes(layer, "area_km2", "diversity_score", "area_name", "lines", "fifth").withColumn("zero_share", F.round("zero_share", 6))


@query("axis_range", f"WITH {SCORED_SQL} SELECT (floor((min(score) - 4) / 10) * 10)::BIGINT AS lower, (ceil((max(score) + 4) / 10) * 10)::BIGINT AS upper FROM final")
def axis_range(spark, sf):
    return reports.axis_range(areas.scored(spark, sf), "score")


EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def _wide_sql():
    days = {"weekday": "BETWEEN 1 AND 5", "weekend": "IN (0, 6)"}
    sums = ", ".join(f"sum(value) FILTER (WHERE event_type = '{k}' AND dayofweek(ts) {days[d]}) AS {k}_{d}" for k in EVENT_TYPES for d in days)
    rows = " UNION ALL ".join(f"SELECT site, area, '{d}' AS day_type, {k}_{d} AS c FROM wide" for k in EVENT_TYPES for d in days)
    return f"wide AS (SELECT user_id AS site, user_id % 20 AS area, {sums} FROM events GROUP BY user_id),\n  long AS ({rows}),\n"


WIDE_SQL = _wide_sql() + """  site_avg AS (SELECT site, area, day_type, avg(c) AS a FROM long WHERE c IS NOT NULL GROUP BY ALL),
  area_avg AS (SELECT area, day_type, avg(a) AS area_average, count(*) AS sites FROM site_avg GROUP BY ALL)"""


def _site_averages(spark, sf):
    weekend = F.dayofweek("ts").isin(1, 7)

    def total(kind, day):
        return F.sum(F.when((F.col("event_type") == kind) & (weekend if day == "weekend" else ~weekend), F.col("value"))).alias(f"{kind}_{day}")
    names = [(k, d) for k in EVENT_TYPES for d in ("weekday", "weekend")]
    wide = (table(spark, sf, "events").groupBy(F.col("user_id").alias("site")).agg(*[total(k, d) for k, d in names])
            .withColumn("area", F.col("site") % 20))
    return reports.site_averages(wide, "site", "area", {f"{k}_{d}": d for k, d in names})


@query("unpivot_site_average", f"WITH {WIDE_SQL} SELECT area, day_type, round(area_average, 6) AS area_average, sites FROM area_avg")
def unpivot_site_average(spark, sf):
    return _site_averages(spark, sf).select("area", "day_type", *r6("area_average"), "sites")


@query("walking_check", f"""WITH {WIDE_SQL}, {SCORED_SQL}, j AS (SELECT day_type, score, area_average FROM area_avg JOIN final ON code = area),
    r AS (SELECT day_type, rank() OVER (PARTITION BY day_type ORDER BY score) + (count(*) OVER (PARTITION BY day_type, score) - 1) / 2 AS x,
      rank() OVER (PARTITION BY day_type ORDER BY area_average) + (count(*) OVER (PARTITION BY day_type, area_average) - 1) / 2 AS y FROM j)
    SELECT day_type, count(*) AS n, round(corr(x, y), 6) AS spearman FROM r GROUP BY day_type""")
def walking_check(spark, sf):
    joined = _site_averages(spark, sf).join(areas.scored(spark, sf).select(F.col("code").alias("area"), "score"), "area")
    return reports.spearman(durable(joined), "score", "area_average", by=["day_type"]).select("day_type", "n", *r6("spearman"))


@query("scored_table_export", f"""WITH {SCORED_SQL} SELECT code, area_name, round(score, 6) AS score, rank FROM final WHERE area_name LIKE '%1%' AND score BETWEEN 90 AND 120""")
def scored_table_export(spark, sf):
    layer = areas.scored(spark, sf).filter(F.col("area_name").contains("1") & F.col("score").between(90, 120))
    return layer.select("code", "area_name", *r6("score"), "rank").orderBy(F.col("score").desc(), "code")
