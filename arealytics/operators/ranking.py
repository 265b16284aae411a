"""Global and grouped ranks, prefix sums, average ranks and exact quantiles without a single-task window.

A frame is range-partitioned on its full sort key (so one hot value, or one hot group, is cut over several partitions),
sorted inside each partition and made durable together with each row's place. Only the per-partition totals, at most one
row per partition and group, are then summed up and joined back.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable, only_row

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _placed(frame: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    keys = [F.col(c).asc() for c in by] + list(order)
    ordered = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    # Both columns are fixed by the write, so a re-run of a lost task cannot move a row to another place.
    return durable(
        ordered.withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", _PLACE_BITS))
        .withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_place"))


def _with_offsets(placed: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the running total of the earlier partitions (`_before`) to every row of a placed frame."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    if not by:  # one row per partition at most
        return placed.join(F.broadcast(offsets), "_part")
    names = ["_part", *by]
    offsets = durable(offsets.select(*[F.col(c).alias(f"_o_{c}") for c in names],
                                     *[c for c in offsets.columns if c not in names]))
    match = placed["_part"] == offsets["_o__part"]
    for c in by:
        match = match & placed[c].eqNullSafe(offsets[f"_o_{c}"])
    return placed.join(broadcast_if_small(offsets), match).drop(*[f"_o_{c}" for c in names])


def ranked(frame: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add 1..n in the given order (within each group of `by`). The order must be total for a repeatable result."""
    placed = _placed(frame, order, by)
    totals = placed.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_total"))
    joined = _with_offsets(placed, totals, by)
    return (joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
            .drop("_part", "_at", "_first", "_before"))


def prefix_sums(frame: DataFrame, order: Sequence[Column], weight: str, by: Sequence[str] = (),
                name: str = "below") -> DataFrame:
    """Add the sum of `weight` over all earlier rows of the group, the row itself excluded."""
    placed = _placed(frame, order, by)
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    totals = placed.groupBy("_part", *by).agg(F.sum(weight).alias("_total"))
    joined = _with_offsets(placed, totals, by)
    return joined.withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_at", "_inner", "_before")


def value_ranks(frame: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-missing value: `n` rows hold it, `below` rows are smaller, `avg_rank` is their mean rank.

    Counting first means a value shared by a third of the rows costs one row from here on.
    """
    counts = frame.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    summed = prefix_sums(counts, [F.col(column).asc()], "n", by)
    return summed.withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / 2)


def _sized(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the number of rows of each group (`_size`), a missing group included. Sizes are one row per group; when they are counted few
    they are broadcast, so that a group that holds most values is not brought to one task."""
    sizes = values.groupBy(*by).agg(F.sum("n").alias("_size"))
    if not by:
        return values.withColumn("_size", F.lit(only_row(sizes)["_size"]))
    sizes = broadcast_if_small(durable(sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], "_size")))
    match = F.lit(True)
    for c in by:
        match = match & values[c].eqNullSafe(sizes[f"_s_{c}"])
    return values.join(sizes, match).drop(*[f"_s_{c}" for c in by])


def quantiles(frame: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group and probability (`q`, `value`)."""
    sized = _sized(value_ranks(frame, column, by), by)
    points = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("q")
    spots = (sized.select("*", points)
             .withColumn("_h", (F.col("_size") - 1) * F.col("q"))
             .withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h")))

    def holds(position: str) -> Column:
        return (F.col(position) >= F.col("below")) & (F.col(position) < F.col("below") + F.col("n"))

    return (spots.filter(holds("_lo") | holds("_hi"))
            .groupBy(*by, "q")
            .agg(F.max(F.when(holds("_lo"), F.col(column))).alias("_v0"),
                 F.max(F.when(holds("_hi"), F.col(column))).alias("_v1"),
                 F.max(F.col("_h") - F.col("_lo")).alias("_f"))
            .select(*by, "q", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_f")).alias("value")))


def upper_median(frame: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The sorted values' item at position floor(n / 2), counted from 0: the upper one of two middle values."""
    sized = _sized(value_ranks(frame, column, by), by)
    middle = F.floor(F.col("_size") / 2)
    return (sized.filter((middle >= F.col("below")) & (middle < F.col("below") + F.col("n")))
            .select(*by, F.col(column).alias("upper_median"), F.col("_size").alias("n")))


def rank_class(rank: Column, size: Column | int) -> Column:
    """Fifth of a rank from 4 (top) to 0: 4 - floor((rank - 1) * 5 / n); a missing rank stays missing."""
    return (F.lit(4) - F.floor((rank - 1) * 5 / size)).cast("int")
