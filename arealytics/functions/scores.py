"""Row-level rules of the index: densities, labels and display text."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE_TYPE_CUT = 100
# Fixed values, in the order the reports list them.
PLACE_TYPES = ["dense and diverse", "dense and less diverse", "less dense and diverse", "less dense and less diverse"]
HOTSPOT_CLASSES = ["high-high", "low-low", "high-low", "low-high", "not significant"]


def density(count: Column, area: Column) -> Column:
    return count / F.nullif(area.cast("double"), F.lit(0.0))


def total_behind_density(value: Column, area: Column, tolerance: float = 1e-6) -> Column:
    """The whole-number total a density came from; a product that is not whole stops the job."""
    product = value * area
    total = F.bround(product)
    return F.when(F.abs(product - total) < tolerance, total.cast("bigint")).when(
        product.isNotNull(), F.raise_error(F.concat(F.lit("density times area is not whole: "), product.cast("string"))))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the values that are there; missing only when all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return total / F.nullif(present, F.lit(0))


def weighted_mean(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean over the values that are there."""
    total = sum((F.coalesce(c * float(w), F.lit(0.0)) for c, w in zip(columns, weights)), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(columns, weights)), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def scored_flag(residents: Column, businesses: Column) -> Column:
    """An area with neither residents nor businesses is not scored."""
    return (F.coalesce(residents, F.lit(0)) > 0) | (F.coalesce(businesses, F.lit(0)) > 0)


def combined_density(intensity: Column, design: Column) -> Column:
    return (intensity + design) / 2


def place_type(intensity: Column, diversity: Column, design: Column) -> Column:
    """One of four kinds of place on the 100-centred scale; missing diversity counts as less diverse."""
    dense = F.when(combined_density(intensity, design) >= PLACE_TYPE_CUT, "dense").otherwise("less dense")
    diverse = F.when(diversity >= PLACE_TYPE_CUT, "diverse").otherwise("less diverse")
    return F.when(intensity.isNotNull() & design.isNotNull(), F.concat_ws(" and ", dense, diverse))


def hotspot_label(z: Column, neighbour_mean: Column, p: Column, alpha: float = 0.05) -> Column:
    """Quadrant of a significant area, with 0 counting as high."""
    own = F.when(z >= 0, "high").otherwise("low")
    near = F.when(neighbour_mean >= 0, "high").otherwise("low")
    return F.when(p >= alpha, "not significant").otherwise(F.concat_ws("-", own, near))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def display_value(value: Column, total: Column, limit: float, units: tuple[str, str], nouns: tuple[str, str]) -> Column:
    """A density in words: below the limit the total behind it, else the rounded density, each with its singular or plural."""
    shown = half_up(value)

    def counted(n, words):
        return F.concat_ws(" ", F.format_number(n, 0), F.when(n == 1, words[0]).otherwise(words[1]))
    return F.when(value < limit, F.concat(counted(total, nouns), F.lit(" in total"))).otherwise(counted(shown, units))


def share_phrase(at_or_below: Column, size: Column, noun: str = "areas") -> Column:
    """"higher than X%" from the middle up, else "lower than Y%"; halves round up and 99 is the most."""
    above = size - at_or_below
    up = F.least(F.lit(99), half_up(at_or_below / size * 100))
    down = F.least(F.lit(99), half_up(above / size * 100))
    return F.when(at_or_below * 2 >= size, F.concat(F.lit("higher than "), up.cast("string"), F.lit(f"% of {noun}"))).otherwise(
        F.concat(F.lit("lower than "), down.cast("string"), F.lit(f"% of {noun}")))


def zero_phrase(zeros: Column, size: Column, noun: str = "areas", one: str = "area") -> Column:
    """How common a value of exactly zero is."""
    share = zeros / size * 100
    return (F.when(zeros == 1, f"none, as in no other {one}")
            .when(share < 1, f"none, as in fewer than 1% of {noun}")
            .otherwise(F.concat(F.lit("none, as in "), half_up(share).cast("string"), F.lit(f"% of {noun}"))))


def comparison_phrase(value: Column, at_or_below: Column, zeros: Column, highest: Column, size: Column, limit: float,
                      noun: str = "areas", one: str = "area") -> Column:
    """The second line of a fact: zeros, small densities, the highest value, or a percent-rank phrase."""
    phrase = share_phrase(at_or_below, size, noun)
    return (F.when((value < limit) & (value == 0), zero_phrase(zeros, size, noun, one))
            .when(value < limit, F.concat(F.lit("density "), phrase))
            .when(value >= highest, F.concat(F.lit("the highest of "), size.cast("string"), F.lit(f" {noun}")))
            .otherwise(phrase))
