"""Key joins and set operations on tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ascending order, as an aggregate that is combined before the shuffle."""
    rest = [c for c in frame.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    first = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_row"))
    return first.select(*keys, "_row.*").select(*frame.columns)


def replace_by_key(current: DataFrame, future: DataFrame, key: str, fill: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Current rows without a future row, and the future rows of known keys.

    A missing attribute of a future row takes the value of the key's first current row. All future rows of a known key stay;
    those of unknown keys go.
    """
    kept = current.join(future.select(key).distinct(), key, "left_anti")
    first = first_per_key(current.select(key, *fill, F.struct(*order).alias("_order")), [key], [F.col("_order")])
    held = first.select(key, *[F.col(c).alias(f"_{c}") for c in fill])
    used = future.join(held, key)
    filled = used.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fill else F.col(c) for c in future.columns])
    return kept.unionByName(filled.select(*current.columns))


def coverage(table: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Keys missing from the table, and keys the reference does not know: one row with both counts."""
    sides = (table.select(key, F.lit(1).alias("t"), F.lit(0).alias("r"))
             .unionByName(reference.select(key, F.lit(0).alias("t"), F.lit(1).alias("r"))))
    # One shuffle of both key columns answers both questions.
    seen = sides.groupBy(key).agg(F.max("t").alias("t"), F.max("r").alias("r"))
    return seen.agg(F.count_if((F.col("t") == 0) & (F.col("r") == 1)).alias("missing"),
                    F.count_if((F.col("t") == 1) & (F.col("r") == 0)).alias("unknown"))


def stack_tables(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
