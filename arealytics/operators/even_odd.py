"""Areas of self-crossing polygons, whichever way their rings turn: a place is inside when a line to it meets the rings an odd number of times.

Works on the signed pieces of `areas.polygon_pieces`. Inside a cell, pieces are cut at each other's ends into slabs; in a slab they are sorted by
height, and every second stretch is inside. Nothing leaves its cell, so a group is what one feature has in one cell.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable_rows
from .tiling import CELL, cell_size

_NEAR = 1e-9  # heights closer than this share of the cell are the same


def _height(x: Column) -> Column:
    return F.col("ha") + (x - F.col("xa")) * (F.col("hb") - F.col("ha")) / (F.col("xb") - F.col("xa"))


def slabs(pieces: DataFrame, group: list[str], marks: DataFrame | None = None) -> DataFrame:
    """The pieces cut at all piece ends of their group, and at its marks (group, x): x0, x1 and the heights h0, h1 there."""
    # Adding zero makes -0.0 and 0.0 one number, so that ends are found again.
    clean = pieces.filter("xa < xb").withColumns({c: F.col(c) + 0.0 for c in ("xa", "xb")})
    every = clean.select(*group, F.array("xa", "xb").alias("x"))
    if marks is not None:
        every = every.unionByName(marks.select(*group, F.array("x").alias("x")))
    ends = every.groupBy(*group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("x")))).alias("xs"))
    at = F.explode(F.sequence(F.array_position("xs", F.col("xa")).cast("int"), F.array_position("xs", F.col("xb")).cast("int") - 1))
    cut = clean.join(ends.hint("merge"), group).withColumn("at", at)
    cut = cut.withColumn("x0", F.element_at("xs", F.col("at"))).withColumn("x1", F.element_at("xs", F.col("at") + 1)).drop("xs", "at")
    return cut.withColumn("h0", _height(F.col("x0"))).withColumn("h1", _height(F.col("x1")))


def faulty(pieces: DataFrame, key: str, group: list[str]) -> DataFrame:
    """The keys of features whose signed pieces do not add up to 0 outside and 1 inside: crossing, doubly wound or misplaced rings."""
    size = cell_size(F.col("level"))
    cut = slabs(pieces.filter("sign <> 0"), group).withColumn("size", size).withColumn("mid", F.round((F.col("h0") + F.col("h1")) / (F.col("size") * 2), 9))
    slab = Window.partitionBy(*group, "x0")
    down = slab.orderBy(F.desc("mid"), F.desc("h0"), F.desc("h1"))
    near = F.col("size") * (2 * _NEAR)
    crossed = (F.lag("h0").over(down) < F.col("h0") - near) | (F.lag("h1").over(down) < F.col("h1") - near)
    inside = F.sum("sign").over(slab.orderBy(F.desc("mid")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("crossed", F.coalesce(crossed, F.lit(False))).withColumn("inside", inside).filter(F.col("crossed") | ~F.col("inside").isin(0, 1)).select(key).distinct()


def crossings(cut: DataFrame, group: list[str]) -> DataFrame:
    """(group, x0, xs): where pieces of one slab cross. Only pieces that change places between the slab's sides meet in a pair."""
    one = cut.select(*group, "x0", "x1", "h0", "h1")
    other = cut.select(*group, "x0", F.col("h0").alias("o0"), F.col("h1").alias("o1"))
    met = one.join(other.hint("merge"), [*group, "x0"]).filter("h0 > o0 AND h1 < o1")
    fall = F.col("h0") - F.col("o0")
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * fall / (fall + F.col("o1") - F.col("h1"))
    return met.groupBy(*group, "x0").agg(F.collect_set(at).alias("xs"))


def resigned(pieces: DataFrame, group: list[str]) -> DataFrame:
    """The pieces cut at their ends and crossings, with signs by the even-odd rule: from the top down, every second one ends the inside."""
    columns = pieces.columns
    cut = durable_rows(slabs(pieces.filter(F.abs("sign") % 2 == 1), group))
    found = cut.join(crossings(cut, group), [*group, "x0"], "left")
    inner = F.filter(F.coalesce("xs", F.array().cast("array<double>")), lambda x: (x > F.col("x0")) & (x < F.col("x1")))
    found = found.withColumn("xs", F.array_sort(F.concat(F.array("x0", "x1"), inner)))
    found = found.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("xs") - 1)))
    found = found.withColumn("left", F.element_at("xs", F.col("at"))).withColumn("right", F.element_at("xs", F.col("at") + 1)).filter(F.col("left") < F.col("right"))
    found = found.select(*[c for c in columns if c not in ("xa", "xb", "ha", "hb", "sign")], F.col("left").alias("xl"), F.col("right").alias("xr"), _height(F.col("left")).alias("hl"), _height(F.col("right")).alias("hr"))
    down = Window.partitionBy(*group, "xl").orderBy(F.desc(F.col("hl") + F.col("hr")), F.desc("hl"))
    found = found.withColumn("sign", F.when(F.row_number().over(down) % 2 == 1, 1).otherwise(-1))
    return found.withColumnsRenamed({"xl": "xa", "xr": "xb", "hl": "ha", "hr": "hb"}).select(columns)


def mended(pieces: DataFrame, key: str, bad: DataFrame, whole: str) -> DataFrame:
    """The pieces of the bad features with even-odd signs, and `whole` as the area they then have."""
    group = [key, "own", *CELL]
    fixed = durable_rows(resigned(pieces.join(bad, key, "left_semi"), group))
    sizes = fixed.filter("level = own").groupBy(key).agg(F.sum(F.col("sign") * (F.col("xb") - F.col("xa")) * (F.col("ha") + F.col("hb")) / 2).alias(whole))
    return fixed.drop(whole).join(sizes, key).select(pieces.columns)
