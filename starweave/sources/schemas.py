"""Explicit schemas of the input and output records."""

from pyspark.sql import types as T

# fixed values: the nested attributes that become features, in feature order
ATTRIBUTES = (
    "NoiseLevel",
    "OutdoorSeating",
    "RestaurantsAttire",
    "RestaurantsDelivery",
    "RestaurantsGoodForGroups",
    "RestaurantsPriceRange2",
    "RestaurantsReservations",
    "RestaurantsTakeOut",
)

RATING = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
])

BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("is_open", T.IntegerType()),
    T.StructField(
        "attributes",
        T.StructType([T.StructField(name, T.StringType()) for name in ATTRIBUTES]),
    ),
])

USER = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("yelping_since", T.StringType()),
    T.StructField("average_stars", T.DoubleType()),
    T.StructField("useful", T.LongType()),
    T.StructField("funny", T.LongType()),
    T.StructField("cool", T.LongType()),
    T.StructField("fans", T.LongType()),
])

CHECKIN = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("time", T.MapType(T.StringType(), T.LongType())),
])

PREDICTION = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
])
