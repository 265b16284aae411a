"""Indicators to scores: entropy, scaling, pillars, ranks, alternative versions."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import mean_of, weighted_mean
from ..session import durable, only_row
from .ranking import rank_class, ranked


def normalised_entropy(shares: DataFrame, by: str, value: str, categories: int, name: str = "entropy") -> DataFrame:
    """Shannon entropy on a 0 to 1 scale per group, from one row per group and category.

    With s = sum of v, -sum(v/s * ln(v/s)) = ln s - sum(v ln v) / s, so one aggregate does it and no group total is joined back.
    Values that are missing, not finite or not above 0 do not count; a group without any is missing.
    """
    v = F.col(value).cast("double")
    counts = F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v)
    scale = F.nullif(F.ln(F.lit(float(categories))), F.lit(0.0))
    total = F.sum(counts)
    entropy = F.when(total > 0, F.greatest(F.ln(total) - F.sum(counts * F.ln(counts)) / total, F.lit(0.0)))
    return shares.groupBy(by).agg(F.try_divide(entropy, scale).alias(name))


def _stats(frame: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Means, deviations and ranges of all columns from one scan, as numbers."""
    fields = []
    for c in columns:
        fields += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return only_row(frame.agg(*fields)).asDict()


def _zscore(name: str, stats: dict) -> Column:
    mean, sd = stats[f"{name}_mean"], stats[f"{name}_sd"]
    return (F.col(name) - float(mean)) / float(sd) if sd else F.lit(None).cast("double")


def _minmax(name: str, stats: dict) -> Column:
    low, high = stats[f"{name}_min"], stats[f"{name}_max"]
    return (F.col(name) - float(low)) / float(high - low) if low is not None and high > low else F.lit(None).cast("double")


SCALES = {"zscore": _zscore, "minmax": _minmax}


def zscores(frame: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add z-scores by the population deviation; a column without spread gives missing values."""
    stats = _stats(frame, columns)
    return frame.withColumns({c + suffix: _zscore(c, stats) for c in columns})


def standardised_scores(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add display scores 100 + 10 z: `columns` maps a value column to its score column."""
    stats = _stats(frame, list(columns))
    return frame.withColumns({name: _zscore(c, stats) * 10 + 100 for c, name in columns.items()})


def scale_indicators(frame: DataFrame, columns: Sequence[str], densities: Sequence[str], scale: str = "zscore",
                     log_densities: bool = True) -> DataFrame:
    """Log the density columns if asked, then replace every indicator by its scaled value."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale: {scale}")
    values = {c: F.log1p(c) if log_densities and c in densities else F.col(c).cast("double") for c in columns}
    logged = frame.withColumns(values)
    stats = _stats(logged, columns)
    return logged.withColumns({c: SCALES[scale](c, stats) for c in columns})


def score_index(frame: DataFrame, pillars: dict[str, Sequence[str]], densities: Sequence[str], scale: str = "zscore",
                log_densities: bool = True, overall: str = "index_z") -> DataFrame:
    """Scale the indicators, average each pillar's available ones, and average the available pillars.

    Scaling needs two passes over the areas, so callers hand over a durable frame when it is costly to compute.
    """
    columns = [c for names in pillars.values() for c in names]
    scaled = scale_indicators(frame, columns, densities, scale, log_densities)
    scaled = scaled.withColumns({p: mean_of([F.col(c) for c in names]) for p, names in pillars.items()})
    return scaled.withColumn(overall, mean_of([F.col(p) for p in pillars]))


def ranked_scores(frame: DataFrame, score: str, code: str) -> DataFrame:
    """Add the rank (highest first, ties by code; unscored areas have none) and the quintile from 5 (top) to 1."""
    some = frame.filter(F.col(score).isNotNull())
    best = ranked(some, [F.col(score).desc(), F.col(code).asc()])
    best = best.withColumn("quintile", rank_class(F.col("rank"), best.count()) + 1)
    return best.unionByName(frame.filter(F.col(score).isNull()), allowMissingColumns=True)


@dataclass(frozen=True)
class Version:
    """One way to compute the index: dropped indicators, weights, no log, another scale, or all indicators in one pool."""
    name: str
    drop: tuple[str, ...] = ()
    log_densities: bool = True
    scale: str = "zscore"
    pooled: bool = False
    weights: dict[str, float] = field(default_factory=dict)


def standard_versions(pillars: dict[str, Sequence[str]]) -> list[Version]:
    """The baseline, one version without each indicator, and the three named alternatives."""
    drops = [Version(f"without {c}", drop=(c,)) for names in pillars.values() for c in names]
    return [Version("Baseline"), *drops, Version("no log", log_densities=False), Version("min-max", scale="minmax"),
            Version("equal indicators", pooled=True)]


def version_scores(frame: DataFrame, code: str, pillars: dict[str, Sequence[str]], densities: Sequence[str],
                   versions: Sequence[Version]) -> DataFrame:
    """One row per version and area (`version`, code, `score`).

    All versions share one durable frame of areas and one row of statistics; each version is then a row-level mean.
    """
    columns = [c for names in pillars.values() for c in names]
    forms = {(v.log_densities, v.scale) for v in versions}
    sources = {}
    for c in columns:
        sources[c] = F.col(c).cast("double")
        if c in densities:
            sources[f"{c}_log"] = F.log1p(c)
    base = frame.select(F.col(code), *[s.alias(n) for n, s in sources.items()])
    base = durable(base)
    stats = _stats(base, list(sources))

    def name(c, log, scale):
        return f"{c}_{scale}_{'log' if log and c in densities else 'raw'}"
    scaled = {}
    for log, scale in forms:
        for c in columns:
            source = f"{c}_log" if log and c in densities else c
            scaled[name(c, log, scale)] = SCALES[scale](source, stats)
    wide = base.select(code, *[c.alias(n) for n, c in scaled.items()])
    scores = []
    for v in versions:
        means = {}
        for p, names in pillars.items():
            kept = [F.col(name(c, v.log_densities, v.scale)) for c in names if c not in v.drop]
            means[p] = kept
        if v.pooled:
            score = mean_of([c for kept in means.values() for c in kept])
        else:
            live = {p: mean_of(kept) for p, kept in means.items() if kept}
            score = weighted_mean(list(live.values()), [v.weights.get(p, 1.0) for p in live])
        scores.append(F.struct(F.lit(v.name).alias("version"), score.alias("score")))
    return wide.select(code, F.explode(F.array(*scores)).alias("s")).select(code, "s.version", "s.score")


def version_ranks(scores: DataFrame, code: str) -> DataFrame:
    """Rank the areas within each version, ties by code. The frame is durable."""
    return durable(ranked(scores.filter(F.col("score").isNotNull()), [F.col("score").desc(), F.col(code).asc()], by=["version"]))


def rank_ranges(ranks: DataFrame, code: str, baseline: str = "Baseline") -> DataFrame:
    """Per area: the baseline rank, and the lowest and highest rank over the other versions."""
    other = F.col("version") != baseline
    return (ranks.groupBy(code).agg(F.max(F.when(~other, F.col("rank"))).alias("baseline_rank"),
                                    F.min(F.when(other, F.col("rank"))).alias("rank_min"),
                                    F.max(F.when(other, F.col("rank"))).alias("rank_max"))
            .withColumn("rank_range", F.col("rank_max") - F.col("rank_min")))


def top_overlap(ranks: DataFrame, code: str, k: int = 25, baseline: str = "Baseline") -> DataFrame:
    """Per version, how many of its top k areas are also in the baseline's top k (at most k rows per version are joined)."""
    tops = ranks.filter(F.col("rank") <= k)
    base = tops.filter(F.col("version") == baseline).select(code)
    return (tops.filter(F.col("version") != baseline).join(base.withColumn("_hit", F.lit(1)), code, "left")
            .groupBy("version").agg(F.count("_hit").alias("top_overlap")))


def weighted_scores(frame: DataFrame, weights: dict[str, float], name: str = "weighted_score") -> DataFrame:
    """A user's own pillar weights over the pillars that are there."""
    return frame.withColumn(name, weighted_mean([F.col(p) for p in weights], list(weights.values())))
