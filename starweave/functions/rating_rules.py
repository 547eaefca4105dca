"""Similarity and prediction rules as column expressions.

Sums are taken over whole or half stars, for which double arithmetic is exact,
so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from starweave import settings as S


def centred_product(n: Column, s_x: Column, s_y: Column, s_xy: Column) -> Column:
    """n^2 times the covariance of x and y."""
    return n * s_xy - s_x * s_y


def pearson(n: Column, s_a: Column, s_b: Column, s_ab: Column, s_aa: Column, s_bb: Column) -> Column:
    """Pearson correlation from moment sums; NULL where a side has no spread."""
    spread_a = F.sqrt(F.greatest(centred_product(n, s_a, s_a, s_aa), F.lit(0.0)))
    spread_b = F.sqrt(F.greatest(centred_product(n, s_b, s_b, s_bb), F.lit(0.0)))
    return F.try_divide(centred_product(n, s_a, s_b, s_ab), spread_a * spread_b)


def mean_closeness(mean_a: Column, mean_b: Column) -> Column:
    """Similarity of two items of which too few co-raters are known."""
    return F.greatest(1.0 - F.abs(mean_a - mean_b) / S.RATING_SPAN, F.lit(0.0))


def pearson_similarity(mean_a: Column, mean_b: Column) -> Column:
    """Over columns n, sum_*, min_*, max_* (NULL n: no co-raters)."""
    n = F.col("n").cast("double")
    flat = (F.col("min_a") == F.col("max_a")) | (F.col("min_b") == F.col("max_b"))
    correlation = pearson(n, *(F.col(c) for c in ("sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb")))
    return (
        F.when(mean_a.isNull() | mean_b.isNull(), 0.0)
        .when(F.coalesce(F.col("n"), F.lit(0)) <= S.FEW_CO_RATERS, mean_closeness(mean_a, mean_b))
        .when(flat, 0.0)
        .otherwise(F.coalesce(correlation, F.lit(0.0)))
    )


def cosine_similarity(shrinkage: float = S.SHRINKAGE) -> Column:
    """Cosine over the co-raters, damped where they are few."""
    n = F.col("n").cast("double")
    cosine = F.try_divide(F.col("sum_ab"), F.sqrt("sum_aa") * F.sqrt("sum_bb"))
    return F.coalesce(n / (n + F.lit(float(shrinkage))) * cosine, F.lit(0.0))


def rank_key(similarity: Column) -> Column:
    """Whole-number sort key: similarities equal to 12 digits are ties.

    Ties are then broken by item id, never by the last bit of a double.
    """
    return F.floor(similarity * 1e12 + 0.5)


def clip_stars(prediction: Column) -> Column:
    return F.least(F.greatest(prediction, F.lit(S.LOWEST_STAR)), F.lit(S.HIGHEST_STAR))


def or_neutral(mean: Column) -> Column:
    return F.coalesce(mean, F.lit(S.NEUTRAL_RATING))
