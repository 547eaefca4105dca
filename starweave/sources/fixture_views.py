"""Ratings, users, businesses and check-ins derived from the order tables.

An order line is a rating: the customer rates the part (or, in the dense
variant, the supplier).  Ratings from 2001 on are the hold-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HOLDOUT_FROM = "2001-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ratings(spark: SparkSession, folder: str, item: str = "l_partkey") -> DataFrame:
    """user_id, business_id, stars (1..5), rated_at; one row per order line."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col(item).cast("string").alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.struct(
            "o_orderdate", "o_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice"
        ).alias("rated_at"),
    )


def before_holdout(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("rated_at.o_orderdate") < F.lit(HOLDOUT_FROM).cast("timestamp_ntz"))


def of_holdout(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("rated_at.o_orderdate") >= F.lit(HOLDOUT_FROM).cast("timestamp_ntz"))


def train_ratings(spark: SparkSession, folder: str, item: str = "l_partkey") -> DataFrame:
    return before_holdout(ratings(spark, folder, item))


def holdout_ratings(spark: SparkSession, folder: str, item: str = "l_partkey") -> DataFrame:
    return of_holdout(ratings(spark, folder, item))


def users(spark: SparkSession, folder: str, rated: DataFrame | None = None) -> DataFrame:
    """One row per customer, in the shape of the user records; ``rated`` are the ratings, if they are at hand."""
    ordered = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("review_count"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("yelping_since"),
    )
    rated = ratings(spark, folder) if rated is None else rated
    rated = rated.groupBy("user_id").agg(F.avg("stars").alias("average_stars"))

    def of_type(kind: str):
        return F.sum((F.col("event_type") == kind).cast("bigint"))

    acted = table(spark, folder, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        of_type("click").alias("useful"),
        of_type("view").alias("funny"),
        of_type("purchase").alias("cool"),
        of_type("signup").alias("fans"),
    )
    return (
        table(spark, folder, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("user_id"))
        .join(ordered, "c_custkey", "left")
        .join(acted, "c_custkey", "left")
        .join(rated, "user_id", "left")
        .select("user_id", "review_count", "yelping_since", "average_stars", "useful", "funny", "cool", "fans")
    )


def businesses(spark: SparkSession, folder: str, rated: DataFrame | None = None) -> DataFrame:
    """One row per part, in the shape of the business records; ``rated`` are the ratings, if they are at hand."""
    rated = ratings(spark, folder) if rated is None else rated
    rated = rated.groupBy("business_id").agg(
        F.avg("stars").alias("stars"), F.count("*").alias("review_count")
    )
    size, kind = F.col("p_size"), F.col("p_type")

    def flag(cond):
        return F.when(cond, "True").otherwise("False")

    attributes = F.struct(
        F.when(size % 4 != 0, F.lower(kind)).alias("NoiseLevel"),
        flag(size > 25).alias("OutdoorSeating"),
        kind.alias("RestaurantsAttire"),
        F.when(size % 3 != 0, flag(size > 10)).alias("RestaurantsDelivery"),
        flag(size % 2 == 0).alias("RestaurantsGoodForGroups"),
        (1 + size % 4).cast("string").alias("RestaurantsPriceRange2"),
        flag(size < 20).alias("RestaurantsReservations"),
        F.when(size % 5 != 0, flag(size > 30)).alias("RestaurantsTakeOut"),
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("business_id"),
        F.col("p_brand").alias("postal_code"),
        (size % 5 != 0).cast("int").alias("is_open"),
        F.when(size % 7 != 0, attributes).alias("attributes"),
    )
    return part.join(rated, "business_id", "left").select(
        "business_id", "postal_code", "stars", "review_count", "is_open", "attributes"
    )


def checkins(spark: SparkSession, folder: str) -> DataFrame:
    """business_id and a map "Day-Hour" -> count; at most 168 slots a row."""
    slot = F.concat_ws("-", F.date_format("ts", "E"), F.hour("ts").cast("string"))
    counted = table(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("business_id"), slot.alias("slot")
    ).agg(F.count("*").alias("n"))
    return counted.groupBy("business_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("time")
    )
