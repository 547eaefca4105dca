"""Feature rows for rated or requested pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from starweave.operators.skew import HotKeys, lookup_join, measure_hot, pair_lookup_join
from starweave.settings import DEFAULT_TUNING, Tuning
from starweave.sources.schemas import ATTRIBUTES

# fixed values: feature names and their order
USER_BASIC = ("user_review_count", "yelping_since", "average_stars")
USER_ENGAGEMENT = ("user_review_count", "useful", "funny", "cool", "fans", "average_stars")
BUSINESS_NARROW = ("business_stars", "business_review_count", "is_open")
BUSINESS_WIDE = ("postal_code", *BUSINESS_NARROW, *ATTRIBUTES)


def business_wide(businesses: DataFrame) -> DataFrame:
    """Twelve features; a NULL ``attributes`` gives NULL for its eight."""
    return businesses.where(F.col("business_id").isNotNull()).select(
        "business_id",
        "postal_code",
        F.col("stars").alias("business_stars"),
        F.col("review_count").alias("business_review_count"),
        "is_open",
        *[F.col(f"attributes.{name}").alias(name) for name in ATTRIBUTES],
    )


def business_narrow(businesses: DataFrame) -> DataFrame:
    return businesses.where(F.col("business_id").isNotNull()).select(
        "business_id",
        F.col("stars").alias("business_stars"),
        F.col("review_count").alias("business_review_count"),
        "is_open",
    )


def user_basic(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_id").isNotNull()).select(
        "user_id", F.col("review_count").alias("user_review_count"), "yelping_since", "average_stars"
    )


def user_engagement(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_id").isNotNull()).select(
        "user_id", F.col("review_count").alias("user_review_count"),
        "useful", "funny", "cool", "fans", "average_stars",
    )


def flatten(frame: DataFrame) -> DataFrame:
    """Struct columns replaced by their fields, at every depth."""
    structs = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.StructType)}
    if not structs:
        return frame
    columns = []
    for field in frame.schema.fields:
        if field.name in structs:
            columns += [F.col(f"`{field.name}`.`{inner}`").alias(inner) for inner in field.dataType.names]
        else:
            columns.append(F.col(f"`{field.name}`"))
    return flatten(frame.select(*columns))


def one_per_key(records: DataFrame, key: str, order: str = "read_at") -> DataFrame:
    """At most one record per key: the last one by the order column.

    Without that column the greatest record is kept, so that the choice is
    the same in every run.
    """
    rest = [c for c in records.columns if c not in (key, order)]
    row = F.struct(*rest)
    if order in records.columns:
        by = F.col(order)
    else:  # maps have no order, their sorted entries do
        by = F.struct(*[
            F.array_sort(F.map_entries(c)).alias(c) if isinstance(records.schema[c].dataType, T.MapType) else F.col(c)
            for c in rest
        ])
    last = F.max_by(row, by)
    return records.groupBy(key).agg(last.alias("_row")).select(key, "_row.*")


def join_users(
    rows: DataFrame, users: DataFrame, *, hot: HotKeys | None = None, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """Left join of user features; an unknown user gives NULLs."""
    return _join_entity(rows, users, "user_id", "business_id", hot, tuning)


def join_businesses(
    rows: DataFrame, businesses: DataFrame, *, hot: HotKeys | None = None, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """Left join of business features; an unknown business gives NULLs."""
    return _join_entity(rows, businesses, "business_id", "user_id", hot, tuning)


def _join_entity(rows, dimension, key, other, hot, tuning):
    if hot is None:
        (hot,) = measure_hot(rows, [key], tuning=tuning)
    return lookup_join(rows, dimension, [key], hot=hot, spread=[other], tuning=tuning)


def business_with_checkins(businesses: DataFrame, checkin_totals: DataFrame) -> DataFrame:
    """Narrow business features and check-ins of the businesses that have both.

    Both sides have one row per business, so no key is hot.
    """
    return business_narrow(businesses).join(checkin_totals, "business_id", "inner")


def feature_table(
    rows: DataFrame, users: DataFrame, businesses: DataFrame, *, tuning: Tuning = DEFAULT_TUNING
) -> DataFrame:
    """Three user and twelve business features beside each row."""
    user_hot, business_hot = measure_hot(rows, ["user_id"], ["business_id"], tuning=tuning)
    joined = join_users(rows, user_basic(users), hot=user_hot, tuning=tuning)
    joined = join_businesses(joined, business_wide(businesses), hot=business_hot, tuning=tuning)
    return joined.select(*rows.columns, *USER_BASIC, *BUSINESS_WIDE)


def entity_rows(rows: DataFrame, users: DataFrame, businesses: DataFrame) -> list[DataFrame]:
    """The features of :func:`feature_table`, one row for each user and each business of ``rows``.

    An unknown one has NULLs, as in the table, so both hold the same values.
    """
    return [
        rows.select("user_id").distinct().join(user_basic(users), "user_id", "left"),
        rows.select("business_id").distinct().join(business_wide(businesses), "business_id", "left"),
    ]


HYBRID_FEATURES = (*USER_ENGAGEMENT, *BUSINESS_NARROW, "checkin_total", "cf_prediction")


def hybrid_feature_table(
    rows: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    checkin_totals: DataFrame,
    cf: DataFrame,
    *,
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Six user, three business and one check-in feature, and the prediction.

    A business without check-ins has no business features at all.  ``cf`` has
    user_id, business_id and prediction, one row per pair.
    """
    user_hot, business_hot = measure_hot(rows, ["user_id"], ["business_id"], tuning=tuning)
    joined = join_users(rows, user_engagement(users), hot=user_hot, tuning=tuning)
    joined = join_businesses(
        joined, business_with_checkins(businesses, checkin_totals), hot=business_hot, tuning=tuning
    )
    joined = pair_lookup_join(
        joined,
        cf.select("user_id", "business_id", F.col("prediction").alias("cf_prediction")),
        [user_hot, business_hot],
        tuning=tuning,
    )
    return joined.select(*rows.columns, *HYBRID_FEATURES)


def category_columns(frame: DataFrame, names: Sequence[str]) -> list[str]:
    """The feature columns that hold categories: the strings."""
    return [n for n in names if isinstance(frame.schema[n].dataType, T.StringType)]
