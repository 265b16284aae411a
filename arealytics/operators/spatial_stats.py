"""Moran statistics on sparse weights (i, j, w), with repeatable permutation tests.

Shuffles are bijections of the areas' places, keyed by md5(seed, replicate, round), so a result depends on the data and the seed only, not on
partitions.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import hotspot_label
from ..session import broadcast_if_small, dealt, durable, durable_rows, only_row
from .ranking import ranked

ROUNDS, PRIME = 32, 2 ** 31 - 1
_BLOCK = 256  # areas whose places in all replicates are worked out at once


def require_standardised(values: DataFrame, z: str = "z") -> DataFrame:
    """Refuse values that do not have mean 0 and population standard deviation 1."""
    stats = only_row(values.agg(F.avg(z).alias("mean"), F.stddev_pop(z).alias("sd")))
    if stats["mean"] is None or abs(stats["mean"]) >= 1e-9 or abs(stats["sd"] - 1) >= 1e-9:
        raise ValueError("Moran's I needs z-scores (mean 0, SD 1), not raw scores")
    return values


def _lags(values: DataFrame, weights: DataFrame, code: str, z: str) -> DataFrame:
    """Per area: weighted mean over its neighbours (0 when it has none), their number and the sum of weights."""
    near = values.select(F.col(code).alias("j"), F.col(z).alias("zj"))
    sums = weights.join(near, "j").groupBy(F.col("i").alias(code)).agg(
        F.sum(F.col("w") * F.col("zj")).alias("neighbour_mean"), F.count(F.lit(1)).alias("neighbours"), F.sum("w").alias("_w"))
    return values.join(sums, code, "left").fillna(0, subset=["neighbour_mean", "neighbours", "_w"])


def local_moran(values: DataFrame, weights: DataFrame, code: str = "code", z: str = "z") -> DataFrame:
    """Local I = z * neighbour mean."""
    lagged = _lags(require_standardised(values, z), weights, code, z)
    return lagged.withColumn("local_i", F.col(z) * F.col("neighbour_mean")).drop("_w")


def global_moran(values: DataFrame, weights: DataFrame, code: str = "code", z: str = "z") -> DataFrame:
    """One row: I = (n / sum of weights) * (z'Wz) / (z'z)."""
    lagged = _lags(require_standardised(values, z), weights, code, z)
    return lagged.agg((F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("_w")) * F.sum(F.col(z) * F.col("neighbour_mean"))
                       / F.sum(F.col(z) * F.col(z))).alias("morans_i"))


def replicate_keys(spark: SparkSession, permutations: int, seed: int) -> DataFrame:
    """(rep, keys): the round keys of each replicate's shuffle, below 2**28. One row per replicate, whatever the number of areas."""
    reps = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("rep"))
    digest = lambda r: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), r.cast("string")))
    return reps.select("rep", F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.conv(F.substring(digest(r), 1, 7), 16, 10).cast("long")).alias("keys"))


def shuffled_place(place: Column, n: int, keys: Column) -> Column:
    """Where a shuffle puts a place (0 to n - 1). Each round pairs every place with one other and swaps a pair or not by a bit of both, so a
    place is moved by arithmetic on its own row: nothing is sorted. The keys in reverse order give the inverse."""
    def swap(x, k):
        other = F.pmod(k - x, F.lit(n).cast("long"))
        mixed = (F.greatest(x, other) + k) % PRIME
        return F.when(F.shiftright(mixed * mixed % PRIME, 8).bitwiseAND(1) == 1, other).otherwise(x)
    return F.aggregate(keys, place.cast("long"), swap)


def _drawn(places: DataFrame, n: int, keys: DataFrame) -> DataFrame:
    """(rep, place, z): every area's value at the place each replicate's shuffle moves it to; the same arithmetic as `shuffled_place`, on blocks of areas."""
    rounds = np.array([r["keys"] for r in keys.orderBy("rep").collect()], dtype=np.int64)  # as many as there are replicates, whatever the areas
    reps = np.arange(1, len(rounds) + 1, dtype=np.int32)

    def moved(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = np.repeat(part.column("place").to_numpy().astype(np.int64)[:, None] - 1, len(reps), axis=1)
                for k in rounds.T:
                    other = (k - x) % n
                    mixed = (np.maximum(x, other) + k) % PRIME
                    x = np.where((mixed * mixed % PRIME >> 8) & 1 == 1, other, x)
                z = part.column("z").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(reps, part.num_rows)), pa.array(x.ravel() + 1), pa.array(np.repeat(z, len(reps)), from_pandas=True)], ["rep", "place", "z"])
    return dealt(places.select("place", "z"), "place", by_cores=True).mapInArrow(moved, "rep int, place long, z double")


def global_moran_p(values: DataFrame, weights: DataFrame, permutations: int = 999, seed: int = 20260926,
                   code: str = "code", z: str = "z") -> DataFrame:
    """One row: observed I and its two-sided p-value (1 + number at least as extreme) / (1 + permutations)."""
    base = require_standardised(values.select(F.col(code).alias("code"), F.col(z).alias("z")))
    places = ranked(base, [F.col("code").asc()], name="place")
    size = only_row(base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz")))
    shuffled = _drawn(places, size["n"], replicate_keys(values.sparkSession, permutations, seed))
    # Replicate 0 is the observed order. Both directions of a pair share one product, so their weights are added first.
    drawn = shuffled.unionByName(places.select(F.lit(0).alias("rep"), F.col("place").cast("long").alias("place"), "z"))
    # One row per place with its values in all replicates, so a pair of places meets once and not once per replicate.
    held = drawn.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "z"))), lambda v: v["z"]).alias("zs"))
    held = durable_rows(held)
    spots = places.select("code", "place")
    low, high = F.least("pi", "pj"), F.greatest("pi", "pj")
    pairs = (weights.join(spots.select(F.col("code").alias("i"), F.col("place").alias("pi")), "i")
             .join(spots.select(F.col("code").alias("j"), F.col("place").alias("pj")), "j")
             .groupBy(low.alias("lo"), high.alias("hi")).agg(F.sum("w").alias("w")))
    met = (pairs.join(held.select(F.col("place").alias("lo"), F.col("zs").alias("za")), "lo")
           .join(held.select(F.col("place").alias("hi"), F.col("zs").alias("zb")), "hi"))
    products = (met.select("w", "zb", F.posexplode("za").alias("rep", "a"))
                .groupBy("rep").agg(F.sum(F.col("w") * F.col("a") * F.get("zb", F.col("rep"))).alias("cross")))
    total = only_row(weights.agg(F.sum("w").alias("w")))["w"]
    per_rep = products.select("rep", (F.col("cross") * (size["n"] / size["zz"] / total)).alias("stat"))
    observed = F.max(F.when(F.col("rep") == 0, F.col("stat")))
    # Rounding keeps exact ties (equal up to the order of summation) on the extreme side.
    return (per_rep.agg(observed.alias("morans_i"), F.collect_list(F.when(F.col("rep") > 0, F.abs("stat"))).alias("sims"))
            .select("morans_i", ((F.size(F.filter("sims", lambda s: F.round(s, 9) >= F.round(F.abs("morans_i"), 9))) + 1)
                                 / (1 + permutations)).alias("p_value")))


def local_moran_p(local: DataFrame, permutations: int = 999, seed: int = 20260926, code: str = "code", z: str = "z") -> DataFrame:
    """Add `p_value` to a local Moran frame with row-standardised weights.

    An area keeps its own value and draws k of the others for its k neighbours. Each replicate's order starts the same for all
    areas, so only the areas at its first k + 1 places are needed, which the inverse shuffle names: their running sums, with the area itself
    skipped, give each mean.
    """
    base = local.select(F.col(code).alias("code"), F.col(z).alias("z"), F.col("neighbours").alias("k"), F.col("local_i"))
    base = durable(ranked(base, [F.col("code").asc()], name="place"))
    facts = only_row(base.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most")))
    n, most = facts["n"], facts["most"] or 0
    keys = replicate_keys(local.sparkSession, permutations, seed)
    slots = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(min(most, max(n - 1, 0))))).alias("slot"))
    named = slots.select("rep", "slot", (shuffled_place(F.col("slot"), n, F.reverse("keys")) + 1).alias("place"))
    heads = named.join(broadcast_if_small(base.withColumn("place", F.col("place").cast("long"))), "place")
    order = Window.partitionBy("rep").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    heads = durable(heads.withColumn("upto", F.sum("z").over(order)))

    def extreme(total):
        return F.round(F.abs(F.col("z") * total / F.col("k")), 9) >= F.round(F.abs("local_i"), 9)
    # The k draws end at slot k - 1. One row per slot holds the sums of all replicates, so an area meets one row.
    wanted = heads.join(broadcast_if_small(durable(base.select((F.col("k") - 1).alias("slot")).distinct())), "slot", "left_semi")
    upto = durable(wanted.groupBy((F.col("slot") + 1).alias("k")).agg(F.collect_list("upto").alias("sums")))
    plain = dealt(base, "code", by_cores=True).join(broadcast_if_small(upto, 1000), "k").select("code", F.size(F.filter("sums", extreme)).alias("found"))
    # Where the area itself stands among its draws, they end one slot later and leave it out.
    own = heads.filter("slot < k").select("rep", "code", "z", "k", "local_i")
    ends = heads.select("rep", "slot", "upto")
    own = (own.join(ends.select("rep", (F.col("slot") + 1).alias("k"), F.col("upto").alias("short")), ["rep", "k"])
           .join(ends.select("rep", F.col("slot").alias("k"), F.col("upto").alias("long")), ["rep", "k"]))
    changed = own.select("code", (extreme(F.col("long") - F.col("z")).cast("int") - extreme(F.col("short")).cast("int")).alias("found"))
    counted = plain.unionByName(changed).groupBy(F.col("code").alias(code)).agg(((F.sum("found") + 1) / (1 + permutations)).alias("p_value"))
    # An area without neighbours always simulates 0, which is never less extreme than its own 0.
    return (local.join(counted, code, "left")
            .withColumn("p_value", F.coalesce("p_value", F.lit(1.0))))


def hotspots(local_with_p: DataFrame, alpha: float = 0.05, z: str = "z") -> DataFrame:
    """Add the cluster label and the neighbours' average on the 100-centred scale."""
    label = hotspot_label(F.col(z), F.col("neighbour_mean"), F.col("p_value"), alpha)
    return (local_with_p.withColumn("hotspot_class", label)
            .withColumn("neighbour_average_score", F.col("neighbour_mean") * 10 + 100))


def chance_positions(areas: DataFrame, code: str = "code", alpha: float = 0.05, seed: int = 20261001) -> DataFrame:
    """The areas marked in the by-chance picture: round(alpha * n) of them, drawn by a seeded order."""
    keyed = areas.select(F.col(code)).withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(code).cast("string"))))
    drawn = ranked(keyed, [F.col("_key").asc(), F.col(code).asc()], name="_slot")
    by_chance = round(areas.count() * alpha)
    return drawn.filter(F.col("_slot") <= by_chance).select(code)
