"""Sets of raters as bitmaps: common raters of items are counted by AND.

Users get dense numbers from 1 on; an item's raters are one bitmap of 32,768
bits for each range of numbers that it has raters in.  A bitmap takes
4 kilobytes however few bits are set, so this is for items with many raters (the
popular ones); sets of rarely rated items are smaller as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starweave import settings as S
from starweave.operators.similarity import canonical_pairs, popular_pairs, ratings_of_popular
from starweave.operators.skew import lookup_join, measure_hot
from starweave.session import shared_folder
from starweave.settings import DEFAULT_TUNING, Tuning

#: Bits of a monotonic id that count rows within a task.
_ROW_BITS = 33


def dense_numbers(ids: DataFrame, column: str, number: str = "number") -> DataFrame:
    """``column, number``: the different values without NULL, numbered 1, 2, ... in no certain order.

    Each task numbers its own values, and the tasks are shifted by the
    counts before them, one count per task from the driver.  A checkpoint
    fixes the numbers, so that a task lost later does not draw new ones.
    """
    shared_folder(ids.sparkSession)
    found = (
        ids.select(column).where(F.col(column).isNotNull()).distinct()
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    )
    task = F.shiftrightunsigned("_id", _ROW_BITS).alias("_task")
    counts = sorted((r["_task"], r["count"]) for r in found.groupBy(task).count().collect())
    shifts, before = [], 1
    for key, count in counts:
        shifts.append((key, before))
        before += count
    shift = ids.sparkSession.createDataFrame(shifts, "_task bigint, _shift bigint")
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return found.withColumn("_task", task).join(F.broadcast(shift), "_task").select(
        column, (row + F.col("_shift")).alias(number)
    )


def rater_bitmaps(ratings: DataFrame, numbers: DataFrame, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """``business_id, bucket, bits``: the raters of each business, repeats once, blank users left out.

    Bits are set map-side, so a business with any number of raters sends
    one bitmap of a bucket from each task.
    """
    (hot,) = measure_hot(ratings, ["user_id"], tuning=tuning)
    numbered = lookup_join(
        ratings.select("user_id", "business_id"), numbers, ["user_id"], "inner",
        hot=hot, spread=["business_id"], tuning=tuning,
    )
    return numbered.groupBy("business_id", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def rater_counts(bitmaps: DataFrame) -> DataFrame:
    """``business_id, n_raters``: the size of each set."""
    return bitmaps.groupBy("business_id").agg(F.sum(F.bitmap_count("bits")).alias("n_raters"))


def common_counts(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item_a, item_b, n``: how many raters the items of each pair have in common; pairs with none are left out.

    The bitmaps are dealt by bucket once; a bitmap then meets its partners
    in its own task.  ``pairs`` are different items, each pair once, and few
    enough to be broadcast: those of a top-n list.
    """
    dealt = bitmaps.repartition("bucket")
    sides = pairs.select("item_a", "item_b", F.explode(F.array("item_a", "item_b")).alias("business_id"))
    both = (
        dealt.join(F.broadcast(sides), "business_id").groupBy("item_a", "item_b", "bucket")
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides")).where("sides = 2")
    )
    counted = both.groupBy("item_a", "item_b").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return counted.where("n > 0")


def popular_common_raters(
    ratings: DataFrame, n: int = S.POPULAR_ITEMS, tuning: Tuning = DEFAULT_TUNING, stage=lambda frame, name: frame
) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n``: sizes of the rater sets of the n most rated businesses, and of what each two share.

    Equal to counting :func:`similarity.popular_co_raters`, but no pair of
    ratings is ever made: beyond the numbering of users only bitmaps move.
    """
    popular, few = ratings_of_popular(ratings, n)
    few = stage(few.select("user_id", "business_id"), "popular-ratings")
    bitmaps = stage(rater_bitmaps(few, dense_numbers(few, "user_id"), tuning), "bitmaps")
    pairs = canonical_pairs(popular_pairs(popular), "first", "second")
    sizes = rater_counts(bitmaps)
    out = pairs.join(common_counts(bitmaps, pairs), ["item_a", "item_b"], "left")
    for side in "ab":
        own = sizes.select(F.col("business_id").alias(f"item_{side}"), F.col("n_raters").alias(f"n_{side}"))
        out = out.join(own, f"item_{side}", "left")
    return out.select("item_a", "item_b", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n")])
