"""The worked index: supplier areas scored from their order lines, on a strip of unit squares ten wide.

Every supplier is one area (code = supplier key), so the number of areas, points and edges grows with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scores
from ..operators import scoring
from ..session import durable

PILLARS = {
    "intensity": ["lines_per_km2", "quantity_per_km2", "parts_per_km2"],
    "diversity": ["flag_mix", "month_mix"],
    "design": ["value_per_km2", "balance"],
}
DENSITIES = ["lines_per_km2", "quantity_per_km2", "parts_per_km2", "value_per_km2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def squares(spark: SparkSession, sf: str) -> DataFrame:
    """The areas: `code`, `geom`, their column and row, and a nominal `area_km2`."""
    key = F.col("s_suppkey")
    col, row = key % 10, F.floor(key / 10)
    return table(spark, sf, "supplier").select(
        key.alias("code"), F.col("s_name").alias("area_name"), (key % 7 + 1).alias("area_km2"), col.alias("col"), row.alias("row"),
        geo.rectangle(col, row, col + 1, row + 1).alias("geom"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as points: x from the customer, y from the order, in steps of 1/40, so some lie exactly on borders."""
    suppliers = table(spark, sf, "supplier").count()
    x = (F.col("o_custkey") * 37 % 441) / F.lit(40.0) - 0.5
    y = (F.col("o_orderkey") * 91 % (suppliers * 4 + 41)) / F.lit(40.0) - 0.5
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"), y.alias("y"), "o_orderstatus")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as rectangles that cross area borders; all corners are binary fractions."""
    key = F.col("p_partkey")
    suppliers = table(spark, sf, "supplier").count()
    x0 = (key * 7 % 88) / F.lit(8.0) - 0.5
    y0 = (key * 11 % suppliers) / F.lit(8.0) - 0.5
    x1, y1 = x0 + (key % 5 + 1) / F.lit(4.0), y0 + (key % 3 + 1) / F.lit(4.0)
    return table(spark, sf, "part").select(
        key.alias("id"), "p_type", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), geo.rectangle(x0, y0, x1, y1).alias("geom"))


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """One row per area with its totals and seven indicators.

    The lines are reduced twice before they meet the areas: by part (which also counts distinct parts) and by mix.
    """
    lines = table(spark, sf, "lineitem")
    by_part = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("value"))
    totals = by_part.groupBy(F.col("l_suppkey").alias("code")).agg(
        F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("parts"))
    mix = lines.groupBy(F.col("l_suppkey").alias("code"), "l_returnflag", F.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    flags = scoring.normalised_entropy(mix.groupBy("code", "l_returnflag").agg(F.sum("n").alias("n")), "code", "n", 3, "flag_mix")
    months = scoring.normalised_entropy(mix.groupBy("code", "month").agg(F.sum("n").alias("n")), "code", "n", 12, "month_mix")
    base = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("area_name"), (F.col("s_suppkey") % 7 + 1).alias("area_km2"),
        F.when(F.col("s_acctbal") >= 1000, F.col("s_acctbal")).alias("balance"))
    wide = base.join(totals, "code", "left").join(flags, "code", "left").join(months, "code", "left")
    wide = wide.fillna(0, subset=["lines", "quantity", "value", "parts"])
    return wide.withColumns({f"{c}_per_km2": scores.density(F.col(c), F.col("area_km2")) for c in ("lines", "quantity", "parts", "value")})


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The scored layer: pillar and overall scores on the 100-centred scale, rank, quintile and place type."""
    # One row per area from here on: the order lines are read once, and each later pass reads this small table.
    wide = durable(indicators(spark, sf))
    facts = ["code", "area_name", "area_km2", "lines", "quantity", "balance", "lines_per_km2"]
    kept = {f"fact_{c}": F.col(c) for c in ("balance", "lines_per_km2")}
    pillars = scoring.score_index(wide.withColumns(kept), PILLARS, DENSITIES).drop("balance", "lines_per_km2")
    pillars = pillars.withColumnsRenamed({f"fact_{c}": c for c in ("balance", "lines_per_km2")})
    final = scoring.standardised_scores(
        pillars.select(*facts, "intensity", "diversity", "design", "index_z"),
        {"intensity": "intensity_score", "diversity": "diversity_score", "design": "design_score", "index_z": "score"})
    final = final.withColumn("place_type", scores.place_type(F.col("intensity_score"), F.col("diversity_score"), F.col("design_score")))
    return scoring.ranked_scores(final, "score", "code")


# The same layer for the oracle, written independently as window and set SQL.
INDICATORS_SQL = """
flag_mix AS (SELECT code, -sum(p * ln(p)) / ln(3) AS flag_mix FROM (
    SELECT l_suppkey AS code, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS p
    FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY code),
month_mix AS (SELECT code, -sum(p * ln(p)) / ln(12) AS month_mix FROM (
    SELECT l_suppkey AS code, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) AS p
    FROM lineitem GROUP BY l_suppkey, month(l_shipdate)) GROUP BY code),
totals AS (SELECT l_suppkey AS code, count(*) AS lines, sum(l_quantity) AS quantity, sum(l_extendedprice) AS value,
    count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey),
ind AS (SELECT s_suppkey AS code, s_name AS area_name, s_suppkey % 7 + 1 AS area_km2,
    CASE WHEN s_acctbal >= 1000 THEN s_acctbal END AS balance, coalesce(lines, 0) AS lines, coalesce(quantity, 0) AS quantity,
    coalesce(value, 0) AS value, coalesce(parts, 0) AS parts, flag_mix, month_mix,
    coalesce(lines, 0)::DOUBLE / (s_suppkey % 7 + 1) AS lines_per_km2, coalesce(quantity, 0)::DOUBLE / (s_suppkey % 7 + 1) AS quantity_per_km2,
    coalesce(parts, 0)::DOUBLE / (s_suppkey % 7 + 1) AS parts_per_km2, coalesce(value, 0)::DOUBLE / (s_suppkey % 7 + 1) AS value_per_km2
    FROM supplier LEFT JOIN totals ON s_suppkey = totals.code LEFT JOIN flag_mix ON s_suppkey = flag_mix.code
    LEFT JOIN month_mix ON s_suppkey = month_mix.code)"""


def z_sql(expr: str) -> str:
    return f"(CASE WHEN stddev_pop({expr}) OVER () > 0 THEN ({expr} - avg({expr}) OVER ()) / stddev_pop({expr}) OVER () END)"


def mean_sql(*parts: str) -> str:
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    count = " + ".join(f"(CASE WHEN {p} IS NULL THEN 0 ELSE 1 END)" for p in parts)
    return f"({total}) / nullif({count}, 0)"


SCORED_SQL = INDICATORS_SQL + f""",
zs AS (SELECT code, {z_sql('ln(1 + lines_per_km2)')} AS z1, {z_sql('ln(1 + quantity_per_km2)')} AS z2, {z_sql('ln(1 + parts_per_km2)')} AS z3,
    {z_sql('flag_mix')} AS z4, {z_sql('month_mix')} AS z5, {z_sql('ln(1 + value_per_km2)')} AS z6, {z_sql('balance')} AS z7 FROM ind),
pil AS (SELECT code, {mean_sql('z1', 'z2', 'z3')} AS intensity, {mean_sql('z4', 'z5')} AS diversity, {mean_sql('z6', 'z7')} AS design FROM zs),
idx AS (SELECT *, {mean_sql('intensity', 'diversity', 'design')} AS index_z FROM pil),
sc AS (SELECT code, 100 + 10 * {z_sql('intensity')} AS intensity_score, 100 + 10 * {z_sql('diversity')} AS diversity_score,
    100 + 10 * {z_sql('design')} AS design_score, 100 + 10 * {z_sql('index_z')} AS score FROM idx),
scored AS (SELECT sc.*, ind.area_name, ind.area_km2, ind.lines, ind.quantity, ind.balance, ind.lines_per_km2,
    CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, sc.code) END AS rank,
    count(score) OVER () AS n_scored,
    CASE WHEN intensity_score IS NULL OR design_score IS NULL THEN NULL ELSE
      (CASE WHEN (intensity_score + design_score) / 2 >= 100 THEN 'dense' ELSE 'less dense' END) || ' and ' ||
      (CASE WHEN diversity_score >= 100 THEN 'diverse' ELSE 'less diverse' END) END AS place_type
    FROM sc JOIN ind USING (code)),
final AS (SELECT *, 5 - (rank - 1) * 5 // n_scored AS quintile FROM scored)"""
