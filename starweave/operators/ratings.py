"""Per-user and per-business facts of the ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starweave import settings as S


def user_means(ratings: DataFrame) -> DataFrame:
    """Mean rating of each user, over all rows including duplicates."""
    return ratings.groupBy("user_id").agg(F.avg("stars").alias("user_mean"), F.count("*").alias("n_ratings"))


def business_means(ratings: DataFrame) -> DataFrame:
    """Mean rating of each business, over all rows including duplicates."""
    return ratings.groupBy("business_id").agg(
        F.avg("stars").alias("business_mean"), F.count("*").alias("n_ratings")
    )


def raters(ratings: DataFrame) -> DataFrame:
    """The set of users of each business, as distinct (business, user) rows.

    A popular business may have more users than one row can hold, so the sets
    stay a relation.
    """
    return ratings.select("business_id", "user_id").distinct()


def rated_items(ratings: DataFrame) -> DataFrame:
    """The set of businesses of each user, as distinct (user, business) rows."""
    return ratings.select("user_id", "business_id").distinct()


def popularity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("business_id").agg(F.count("*").alias("n_ratings"))


def most_popular(ratings: DataFrame, n: int = S.POPULAR_ITEMS) -> DataFrame:
    """The n most rated businesses; equal counts in the order of their ids."""
    return popularity(ratings).orderBy(F.desc("n_ratings"), F.asc("business_id")).limit(n)


def latest_ratings(ratings: DataFrame, order: str = "rated_at") -> DataFrame:
    """One rating per (user, business): the last one by ``order``.

    Without an order column the highest rating is kept.
    """
    last = F.max_by("stars", order) if order in ratings.columns else F.max("stars")
    return ratings.groupBy("user_id", "business_id").agg(last.alias("stars"))


def settled_ratings(ratings: DataFrame, order: str = "rated_at", dealt_by: str | None = None) -> DataFrame:
    """:func:`latest_ratings` without a look at the order, as far as that goes: ``settled`` tells where.

    It goes where all ratings of a user and a business agree, so that the
    order column is shuffled for the other pairs only.  ``dealt_by``: the one
    key that rows are dealt by, for a join by it that follows.
    """
    ordered = order in ratings.columns
    placed = F.col(order).isNotNull() if ordered else F.lit(True)
    rows = ratings.select("user_id", "business_id", "stars", placed.alias("_placed"))
    if dealt_by:
        rows = rows.repartition(dealt_by)
    if not ordered:
        return latest_ratings(rows).withColumn("settled", F.lit(True))
    found = rows.groupBy("user_id", "business_id").agg(
        F.max("stars").alias("stars"), F.min("stars").alias("_least"), F.count("stars").alias("_known"),
        F.count("*").alias("_n"), F.min("_placed").alias("_placed"),
    )
    alike = (F.col("_known") == 0) | ((F.col("_known") == F.col("_n")) & (F.col("_least") == F.col("stars")))
    return found.select("user_id", "business_id", "stars", (F.col("_placed") & alike).alias("settled"))
