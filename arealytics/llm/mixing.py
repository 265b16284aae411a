"""Mixing sources to target weights, in DataFrame functions only: temperature mixing realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are), normalised. The exponent is
bisected: to the largest one whose weights reach a target entropy (a fraction of the log of the number of sources), and never below the
smallest one that keeps every source within the repetition limit. Each bisection job evaluates the midpoints of five steps at once over
the table of sources; only its one row of sums reaches the driver.

Budgets: weight times the total. Without a total, the total is the one at which no source is used less than once, so no document is lost.
A source of r repeats gives all its documents floor(r) times, each time in another order, and then as many of one more order as fit the
rest of its budget. The stream is cut into blocks; block b takes from every source the copies in [b, b+1) of its own stream, so each
block has the target weights, and a block's copies are permuted by hash. Orders come from row hashes, so they do not depend on partitions.

Running token sums go over slices of the hash range (square root of a source's rows each way), so that a source with a third of all rows
never stands in one window. Documents themselves are not shuffled by `mixed`.

Defined results: a NULL source is a source of its own; tokens are white-space separated words, and a text without any (or NULL) counts as
one; rows that repeat are separate copies; one source alone keeps its rows; an empty table gives no rows; extra columns stay in `mixed`.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

STEPS, JOBS = 5, 8


def tokens(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent (sum of p**a, sum of p**a * ln p) over all sources, in one job of one row."""
    p = F.col("p")
    row = shares.agg(*[x for a in exponents for x in (F.sum(F.pow(p, a)), F.sum(F.pow(p, a) * F.log(p)))]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def _bisected(shares: DataFrame, good, low: float, high: float) -> float:
    """The border between exponents that are good (towards high) and those that are not; good(exponent, z, s) must be monotone."""
    for _ in range(JOBS):
        grid = [low + (high - low) * i / 2 ** STEPS for i in range(1, 2 ** STEPS)]
        got = [good(a, *zs) for a, zs in zip(grid, _sums(shares, grid))]
        first = next((i for i, ok in enumerate(got) if ok), len(grid))
        low, high = (grid[first - 1] if first else low), (grid[first] if first < len(grid) else high)
    return high


def weights(sizes: DataFrame, entropy: float | None = None, max_repeats: float | None = None, total: float | None = None) -> DataFrame:
    """(source, had, docs, weight, repeats) of the narrow table (key, source, size)."""
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("had"), F.count("*").alias("docs")))
    everything = totals.agg(F.sum("had").alias("t"), F.count("*").alias("n"), F.min("had").alias("least"), F.max("had").alias("most")).first()
    if not everything["n"]:
        return totals.selectExpr("source", "had", "docs", "0D AS weight", "0D AS repeats")
    all_tokens, n, small, large = everything["t"], everything["n"], everything["least"], everything["most"]
    shares = totals.withColumn("p", F.col("had") / F.lit(float(all_tokens)))
    exponent = 1.0
    if entropy is not None and n > 1:
        goal = min(entropy, 1.0) * math.log(n)
        # Entropy falls as the exponent grows: the largest exponent that still reaches the goal.
        exponent = _bisected(shares, lambda a, z, s: math.log(z) - a * s / z < goal - 1e-12, 0.0, 1.0)
        exponent = exponent if exponent < 1.0 else 1.0
    elif max_repeats is not None:
        exponent = 0.0

    def repeats(a: float, z: float) -> float:
        if total is None:
            return (large / small) ** (1 - a)
        return (small / all_tokens) ** (a - 1) * total / (all_tokens * z)

    if max_repeats is not None:
        [(z, _)] = _sums(shares, [exponent])
        if repeats(exponent, z) > max_repeats * (1 + 1e-12):
            exponent = _bisected(shares, lambda a, z, s: repeats(a, z) <= max_repeats, exponent, 1.0)
    [(z, _)] = _sums(shares, [exponent])
    weight = F.pow("p", exponent) / z
    budget = F.lit(float(total)) if total is not None else F.lit(float(all_tokens * z * (large / all_tokens) ** (1 - exponent)))
    # The source that is used least is used exactly once when no total is given; rounding must not take its last document.
    times = weight * budget / F.col("had")
    return written(shares.select("source", "had", "docs", weight.alias("weight"), F.when(F.abs(times - F.round(times)) < 1e-9, F.round(times)).otherwise(times).alias("repeats")))


def _narrow(documents: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return written(documents.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), tokens(F.col(text)).alias("size")))


def _order(key: Column, epoch: Column) -> Column:
    return F.xxhash64(F.lit("mixing"), key, epoch)


def placements(sizes: DataFrame, plan: DataFrame, block_tokens: int = 1_000_000) -> DataFrame:
    """(doc_id, key, source, size, epoch, hash, block, position): every copy that the budgets take, and its place in the stream."""
    copies = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(sizes["*"], plan["had"], plan["docs"], plan["repeats"])
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats") - 1, F.lit(0)).cast("int"))))
    copies = copies.withColumn("hash", _order(F.col("key"), F.col("epoch")))
    copies = copies.withColumn("slice", F.floor((F.col("hash") / F.lit(2.0 ** 64) + 0.5) * F.ceil(F.sqrt("docs"))).cast("long"))
    copies = written(copies)
    slices = copies.groupBy("source", "epoch", "slice").agg(F.sum("size").alias("own"))
    along = Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "epoch", "slice", F.coalesce(F.sum("own").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "epoch", "slice").orderBy("hash", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = copies.withColumn("upto", F.sum("size").over(within)).alias("c").join(
        slices.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.epoch") == F.col("s.epoch")) & (F.col("c.slice") == F.col("s.slice")))
    running = running.select("c.*", (F.col("c.upto") + F.col("s.before")).alias("used"))
    part = (F.col("repeats") - F.floor("repeats")) * F.col("had")
    taken = running.where((F.col("epoch") < F.floor("repeats")) | (F.col("used") <= part + 1e-6))
    whole = plan.agg(F.sum(F.col("repeats") * F.col("had"))).first()[0] or 0.0
    blocks = max(1, math.ceil(whole / block_tokens))
    spot = (F.col("epoch") * F.col("had") + F.col("used") - F.col("size")) / (F.col("repeats") * F.col("had"))
    taken = taken.withColumn("block", F.least(F.floor(spot * blocks), F.lit(blocks - 1)).cast("long"))
    inside = Window.partitionBy("block").orderBy(F.xxhash64(F.lit("block"), "hash"), "hash", "key", "epoch")
    return taken.select("doc_id", "key", "source", "size", "epoch", "hash", "block", F.row_number().over(inside).cast("long").alias("position"))


def schedule(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None,
             max_repeats: float | None = None, total: float | None = None, block_tokens: int = 1_000_000) -> DataFrame:
    """The mix as a table of copies: block by block, position by position."""
    sizes = _narrow(documents, doc_id, source, text)
    return placements(sizes, weights(sizes, entropy, max_repeats, total), block_tokens)


def mixed(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", entropy: float | None = None,
          max_repeats: float | None = None, total: float | None = None) -> DataFrame:
    """The documents, each as many times as its source's budget takes it. The last, partial order of a source is one cut of its hashes."""
    sizes = _narrow(documents, doc_id, source, text)
    plan = weights(sizes, entropy, max_repeats, total)
    placed = placements(sizes, plan)
    cut = placed.alias("p").join(plan.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")) & (F.col("p.epoch") == F.floor("w.repeats")))
    cut = cut.groupBy(F.col("p.source").alias("source")).agg(F.max(F.struct("p.hash", "p.key")).alias("cut"))
    rule = written(plan.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select(F.col("w.source").alias("__source"), F.floor("w.repeats").cast("int").alias("__full"), F.col("c.cut").alias("__cut")))
    rows = documents.withColumn("__key", row_key(doc_id, text)).join(rule, F.col(source).eqNullSafe(F.col("__source")))
    partial = F.struct(_order(F.col("__key"), F.col("__full")).alias("hash"), F.col("__key").alias("key"))
    times = F.col("__full") + F.when(F.col("__cut").isNotNull() & (partial <= F.col("__cut")), 1).otherwise(0)
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*documents.columns)
