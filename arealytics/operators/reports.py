"""Summary tables of a scored layer: shares, classes, bands, correlations and exceptions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import total_behind_density
from ..session import broadcast_if_small
from .ranking import prefix_sums, quantiles, ranked, upper_median, value_ranks

# Distance bands in km, and the histogram's range and step.
DISTANCE_BANDS = [(0.0, 5.0, "Within 5 km"), (5.0, 10.0, "5 to 10 km"), (10.0, 20.0, "10 to 20 km"),
                  (20.0, 40.0, "20 to 40 km"), (40.0, None, "Over 40 km")]
SCORE_LOW, SCORE_HIGH, SCORE_STEP = 70, 130, 2
QUINTILE_NAMES = ["Top quintile", "Second quintile", "Middle quintile", "Fourth quintile", "Bottom quintile"]


def class_counts(frame: DataFrame, column: str, classes: Sequence, name: str = "n") -> DataFrame:
    """Rows per class in the given order, 0 for a class that does not occur."""
    dtype = frame.schema[column].dataType
    listed = (frame.sparkSession.range(1)
              .select(F.posexplode(F.array(*[F.lit(c).cast(dtype) for c in classes])).alias("position", column)))
    counts = frame.filter(F.col(column).isin(list(classes))).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return (listed.join(F.broadcast(counts), column, "left")  # at most one row per listed class
            .select("position", column, F.coalesce(name, F.lit(0)).alias(name)))


def group_share(frame: DataFrame, condition: Column, measures: Sequence[str]) -> DataFrame:
    """The share of each measure's total that the rows under a condition hold (one row)."""
    return frame.agg(F.count(F.lit(1)).alias("areas"), *[
        F.try_divide(F.sum(F.when(condition, F.col(m)).otherwise(0)), F.sum(m)).alias(f"{m}_share") for m in measures])


def quantile_labels(frame: DataFrame, column: str) -> DataFrame:
    """Range labels of the five fifths of a score, top first."""
    cuts = quantiles(frame, column, [0.2, 0.4, 0.6, 0.8])
    one = cuts.agg(*[F.max(F.when(F.round(F.col("q"), 1) == q, F.col("value"))).alias(f"v{i}") for i, q in enumerate((0.2, 0.4, 0.6, 0.8))])

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.format_string("%.1f", p) for p in parts])
    v0, v1, v2, v3 = (F.col(f"v{i}") for i in range(4))
    labels = [text("Top quintile: ", v3, " and above"), text("Second quintile: ", v2, " to under ", v3),
              text("Middle quintile: ", v1, " to under ", v2), text("Fourth quintile: ", v0, " to under ", v1),
              text("Bottom quintile: under ", v0)]
    return one.select(F.posexplode(F.array(*labels)).alias("position", "label"))


def income_groups(frame: DataFrame, income: str, code: str, names: Sequence[str]) -> DataFrame:
    """Split the areas with an income into equally many groups from low to high, like `ntile`, without one big window."""
    some = frame.filter(F.col(income).isNotNull())
    placed = ranked(some, [F.col(income).asc(), F.col(code).asc()], name="_r")
    small, extra = divmod(placed.count(), len(names))
    wide = extra * (small + 1)
    group = F.when(F.col("_r") <= wide, F.floor((F.col("_r") - 1) / (small + 1))).otherwise(
        F.floor((F.col("_r") - 1 - wide) / max(small, 1)) + extra)
    return placed.withColumn("income_group", F.get(F.array(*[F.lit(x) for x in names]), group.cast("int"))).drop("_r")


def equity(frame: DataFrame, group: str, residents: str, quintile: str = "quintile") -> DataFrame:
    """Share of each income group's residents who live in top- and bottom-quintile areas."""
    def share(q):
        return F.try_divide(F.sum(F.when(F.col(quintile) == q, F.col(residents)).otherwise(0)), F.sum(residents))
    return frame.groupBy(group).agg(F.sum(residents).alias("residents"), share(5).alias("top_quintile_share"),
                                    share(1).alias("bottom_quintile_share"))


def top_per_group(frame: DataFrame, by: str, order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows per group and partition before it shuffles."""
    window = Window.partitionBy(by).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def place_type_summary(frame: DataFrame, examples: int = 3, kind: str = "place_type", residents: str = "residents",
                       rank: str = "rank", label: str = "area_name") -> DataFrame:
    """Areas, residents and the best-ranked names of each place type."""
    some = frame.filter(F.col(kind).isNotNull())
    sizes = some.groupBy(kind).agg(F.count(F.lit(1)).alias("areas"), F.sum(residents).alias("residents"))
    best = (top_per_group(some.select(kind, rank, label), kind, [F.col(rank).asc()], examples)
            .groupBy(kind).agg(F.sort_array(F.collect_list(F.struct("place", label))).alias("_names"))
            .select(kind, F.array_join(F.transform("_names", lambda s: s[label]), ", ").alias("best_ranked_examples")))
    return sizes.join(best, kind, "left")


def rank_band_summary(frame: DataFrame, size: int, label: str = "area_name", rank: str = "rank") -> DataFrame:
    """Per baseline fifth: median, mean and maximum of the rank range, and its biggest mover (ties: better rank, then name)."""
    banded = frame.withColumn("band", F.floor((F.col(rank) - 1) * 5 / size).cast("int"))
    first = F.struct((-F.col("rank_range")).alias("down"), F.col(rank).alias("r"), F.col(label).alias("name"))
    summary = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("areas"), F.avg("rank_range").alias("mean_range"), F.max("rank_range").alias("max_range"),
        F.min_by(F.struct(F.col(label).alias("mover_name"), F.col("rank_min").alias("mover_rank_min"),
                          F.col("rank_max").alias("mover_rank_max")), first).alias("m"))
    medians = quantiles(banded, "rank_range", [0.5], by=["band"]).select("band", F.col("value").alias("median_range"))
    names = F.array(*[F.lit(n) for n in QUINTILE_NAMES])
    return (summary.join(medians, "band")
            .select("band", F.concat(F.get(names, F.col("band")), F.lit(" ("), F.col("areas").cast("string"), F.lit(" areas)")).alias("label"),
                    "areas", "median_range", "mean_range", "max_range", "m.*"))


def distance_bands(frame: DataFrame, distance: str, score: str, bands=DISTANCE_BANDS) -> DataFrame:
    """Count and (upper) median score per distance band [low, high), 0 for an empty band."""
    band = F.lit(None).cast("int")
    for i, (low, high, _) in reversed(list(enumerate(bands))):
        inside = F.col(distance) >= low
        band = F.when(inside & (F.col(distance) < high) if high is not None else inside, i).otherwise(band)
    medians = upper_median(frame.withColumn("position", band).filter(F.col("position").isNotNull()), score, by=["position"])
    listed = frame.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(b[2]) for b in bands])).alias("position", "band"))
    return (listed.join(F.broadcast(medians), "position", "left")  # at most one row per band
            .select("position", "band", F.coalesce("n", F.lit(0)).alias("n"), "upper_median"))


def far_exceptions(frame: DataFrame, distance: str, score: str, code: str, beyond: float = 10.0, k: int = 3) -> DataFrame:
    """The k best scores farther out than a distance."""
    return frame.filter(F.col(distance) > beyond).orderBy(F.col(score).desc(), F.col(code).asc()).limit(k)


def histogram(frame: DataFrame, column: str, low: float = SCORE_LOW, high: float = SCORE_HIGH, step: float = SCORE_STEP) -> DataFrame:
    """Counts in fixed bins [start, start + step), empty bins included, with the colour class of each bin's middle.

    A middle's class is that of the rank a score there would have: one more than the number of higher scores. Counting per half bin
    answers both in a single pass.
    """
    half = step / 2
    slots = int(round((high - low) / half))
    values = frame.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    # Slot edges are closed on the left; a value equal to a middle is not above it, so such values are counted apart.
    slot = F.greatest(F.lit(-1), F.least(F.lit(slots), F.floor((F.col("v") - low) / half)))
    exact = (F.col("v") == F.lit(float(low)) + slot * half).cast("int")
    counts = values.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("at_edge"))
    listed = frame.sparkSession.range(1).select(F.explode(F.sequence(F.lit(-1), F.lit(slots))).alias("slot"))
    filled = listed.join(F.broadcast(counts), "slot", "left").fillna(0)  # at most one row per slot
    # From here on there is one row per slot, a number fixed by the axis.
    after = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.col("n") - F.col("at_edge") + F.coalesce(F.sum("n").over(after), F.lit(0))
    summed = filled.withColumns({"higher": above, "total": F.sum("n").over(everything)})
    bins = summed.filter((F.col("slot") >= 0) & (F.col("slot") < slots)).withColumn("bin", F.floor(F.col("slot") / 2))
    return (bins.groupBy("bin").agg(F.sum("n").alias("n"), F.max(F.when(F.col("slot") % 2 == 1, F.col("higher"))).alias("higher"),
                                    F.max("total").alias("total"))
            .select((F.col("bin") * step + low).alias("bin_start"), "n",
                    (4 - F.floor(F.col("higher") * 5 / F.nullif("total", F.lit(0)))).cast("int").alias("color_class")))


def share_within(frame: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row: share of values in [low, high), number below the axis, and the lowest of those."""
    c = F.col(column)
    return frame.filter(c.isNotNull()).agg(
        F.avg(((c >= low) & (c < high)).cast("double")).alias("middle_share"),
        F.count_if(c < SCORE_LOW).alias("below_axis"), F.min(F.when(c < SCORE_LOW, c)).alias("lowest"))


def spearman(frame: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties; rows with a missing value are left out.

    Equal (x, y) pairs are counted before anything else, and weighted sums then give the correlation.
    """
    pairs = (frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w")))
    ranks = {}
    for side in ("x", "y"):
        values = pairs.groupBy(*by, side).agg(F.sum("w").alias("n"))
        summed = prefix_sums(values, [F.col(side).asc()], "n", by)
        ranks[side] = broadcast_if_small(summed.select(*by, side, (F.col("below") + (F.col("n") + 1) / 2).alias(f"r{side}")))
    joined = pairs.join(ranks["x"], [*by, "x"]).join(ranks["y"], [*by, "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = joined.groupBy(*by).agg(F.sum("w").alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
                                   F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return sums.select(*by, "n", F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"))


def correlation_matrix(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one scan and one row of partial sums per task."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = frame.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("p")
    ).select("p.*")


def site_averages(wide: DataFrame, site: str, area: str, surveys: dict[str, str]) -> DataFrame:
    """Wide survey columns (column -> day type) to site averages, and those to area averages per day type."""
    rows = F.explode(F.array(*[F.struct(F.lit(day).alias("day_type"), F.col(c).cast("double").alias("count")) for c, day in surveys.items()]))
    sites = (wide.select(site, area, rows.alias("s")).select(site, area, "s.*").filter(F.col("count").isNotNull())
             .groupBy(site, area, "day_type").agg(F.avg("count").alias("site_average")))
    return sites.groupBy(area, "day_type").agg(F.avg("site_average").alias("area_average"), F.count(F.lit(1)).alias("sites"))


def axis_range(frame: DataFrame, column: str) -> DataFrame:
    """Chart range: out to the next ten with a margin of four."""
    return frame.agg((F.floor((F.min(column) - 4) / 10) * 10).alias("lower"), (F.ceil((F.max(column) + 4) / 10) * 10).alias("upper"))


def extremes(frame: DataFrame, area: str, diversity: str, label: str, businesses: str, zero_of: str) -> DataFrame:
    """One row: smallest and largest area, the area lowest in diversity, and the share of areas with none of something."""
    known = frame.withColumn("_low", F.when(F.col(diversity).isNotNull(), F.struct(diversity, label)))
    lowest = F.min_by(F.struct(F.col(label).alias("n"), F.col(businesses).alias("b")), F.col("_low"))
    return (known.agg(F.min(area).alias("smallest"), F.max(area).alias("largest"), lowest.alias("l"),
                      F.avg((F.col(zero_of) == 0).cast("double")).alias("zero_share"))
            .select("smallest", "largest", F.col("l.n").alias("lowest_name"), F.col("l.b").alias("lowest_businesses"), "zero_share"))


def percent_positions(frame: DataFrame, column: str) -> DataFrame:
    """Add, per row, how many values are at or below its own: counted per distinct value, then joined back."""
    values = value_ranks(frame, column).select(F.col(column).alias("_v"), (F.col("below") + F.col("n")).alias("at_or_below"))
    return frame.join(broadcast_if_small(values), F.col(column) == F.col("_v"), "left").drop("_v")


def hover_totals(layer: DataFrame, code: str, densities: dict[str, str], area: str, fractions: DataFrame, groups: Sequence[str],
                 digits: int = 1) -> DataFrame:
    """Per area the whole totals behind its densities (total name -> density column) and its fractional counts, rounded."""
    totals = [total_behind_density(F.col(c), F.col(area)).alias(n) for n, c in densities.items()]
    shares = fractions.select(F.col("area_code").alias(code), *[F.round(g, digits).alias(g) for g in groups])
    return layer.select(code, *totals).join(shares, code, "left")
