"""Choice of a retail candidate for a lot: score band, then the cheapest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the score of what a user has chosen.
CHOSEN = 100


def band_choice(scored: DataFrame, key: str, score: str, price: str, position: list[str], width: float) -> DataFrame:
    """Of each key's candidates with a score above 0 and within ``width`` of its best: the cheapest; ties by score, then position.

    The best score of a key comes from a partial aggregate, so a lot with very many candidates is no hot task.
    """
    good = scored.where(F.col(score) > 0)
    top = good.groupBy(key).agg(F.max(score).alias("_top"))
    near = good.join(top, key).where(F.col(score) >= F.col("_top") - width)
    rest = [c for c in scored.columns if c != key]
    order = F.struct(F.coalesce(F.col(price), F.lit(float("inf"))), -F.col(score), *position)
    picked = near.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def overlap(expected: Column, actual: Column) -> Column:
    """struct(hits, total, ratio) of two token arrays."""
    hits, total = F.size(F.array_intersect(expected, actual)), F.size(F.array_distinct(expected))
    return F.struct(hits.alias("hits"), total.alias("total"), F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("ratio"))


def attribute_sets(expected: dict[str, Column], actual: dict[str, Column], double: tuple[str, ...] = ()) -> Column:
    """struct(conflicts, missing, matched): names of attribute groups whose expected values are contradicted or not there.

    A group conflicts when both sides have values and share none, is missing when only the expected side has some; matched
    counts shared values, twice for groups named in ``double``.
    """
    both = lambda k: F.size(F.array_intersect(expected[k], actual[k]))
    conflicts = F.array_compact(F.array(*(F.when((F.size(expected[k]) > 0) & (F.size(actual[k]) > 0) & (both(k) == 0), k) for k in expected)))
    absent = F.array_compact(F.array(*(F.when((F.size(expected[k]) > 0) & (F.size(actual[k]) == 0), k) for k in expected)))
    matched = sum((both(k) * (2 if k in double else 1) for k in expected), F.lit(0))
    return F.struct(conflicts.alias("conflicts"), absent.alias("missing"), matched.alias("matched"))


def overridden(chosen: Column, found: Column, found_score: Column | float) -> Column:
    """struct(key, score): the user's choice at a score of 100, else what was found at its own."""
    score = found_score if isinstance(found_score, Column) else F.lit(found_score)
    return F.struct(F.coalesce(chosen, found).alias("key"), F.when(chosen.isNotNull(), F.lit(CHOSEN)).when(found.isNotNull(), score).alias("score"))
