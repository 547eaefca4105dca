
from __future__ import annotations

import functools
import importlib
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracle  # noqa: E402
from starweave import settings as S  # noqa: E402
from starweave.operators import (  # noqa: E402
    bitmaps as B, checkins as C, corating as K, encoding as E, evaluation as V, features as X,
    models as M, neighbours as N, ratings as R, selection as L, similarity as Z,
)
from starweave.operators.skew import lookup_join, measure_hot  # noqa: E402
from starweave.plans import jobs  # noqa: E402
from starweave.session import parquet_stage, shared_folder  # noqa: E402
from starweave.sources import files, fixture_views as T  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
PAIR = ["user_id", "business_id"]
DENSE = "l_suppkey"
#: Sizes at which the test tables have hot keys, more of them than the list holds.
SKEWED = S.Tuning(heavy_user=60, grid_block=25, rows_per_slot=40, hot_keys=30)


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six digits, for comparison across engines."""
    return frame.select(*[
        F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes
    ])


class Tables:
    """What a query reads more than once, joined once: the ratings, and the users and businesses made of them.

    ``ordered=False`` leaves out what only tells ratings of one day apart, for queries that want no latest one.
    """

    def __init__(self, spark: SparkSession, sf: str, item: str = "l_partkey", ordered: bool = True):
        self.spark, self.sf, self.stage = spark, sf, parquet_stage(spark)
        ratings = T.ratings(spark, sf, item)
        if not ordered:
            ratings = ratings.withColumn("rated_at", F.struct("rated_at.o_orderdate"))
        self.ratings = self.stage(ratings, "ratings")
        self.train, self.holdout = T.before_holdout(self.ratings), T.of_holdout(self.ratings)
        self.pairs = self.holdout.select(*PAIR)

    @functools.cached_property
    def users(self) -> DataFrame:
        return self.stage(T.users(self.spark, self.sf, self.ratings), "users")

    @functools.cached_property
    def businesses(self) -> DataFrame:
        return self.stage(T.businesses(self.spark, self.sf, self.ratings), "businesses")


def pairs(spark: SparkSession, sf: str, item: str = "l_partkey") -> DataFrame:
    return T.holdout_ratings(spark, sf, item).select(*PAIR)


def _flat_business(spark, sf):
    return X.flatten(T.businesses(spark, sf))


def _join_users(spark, sf):
    t = Tables(spark, sf, ordered=False)
    return X.join_users(t.ratings.select(*PAIR, "stars"), X.user_basic(t.users))


def _join_businesses(spark, sf):
    t = Tables(spark, sf, ordered=False)
    return X.join_businesses(t.ratings.select(*PAIR, "stars"), X.business_wide(t.businesses))


def _feature_table(spark, sf):
    t = Tables(spark, sf, ordered=False)
    return X.feature_table(t.ratings.select(*PAIR, "stars"), t.users, t.businesses)


def _train_features(t: Tables):
    # Shown to six digits, so that both engines correlate the same numbers.
    return rounded(X.feature_table(t.train.select(*PAIR, "stars"), t.users, t.businesses))


def _hybrid_table(spark, sf):
    t = Tables(spark, sf)
    cf = t.stage(N.predict_training_pairs(t.train, stage=t.stage), "cf")
    return X.hybrid_feature_table(t.train.select(*PAIR, "stars"), t.users, t.businesses, C.totals(T.checkins(spark, sf)), cf)


def _candidates(spark, sf, item: str = "l_partkey"):
    t = Tables(spark, sf, item)
    return _candidates_of(t, t.stage(R.latest_ratings(t.train), "latest"))


def _candidates_of(t: Tables, latest: DataFrame):
    train, asked = t.train, t.pairs
    asked_users, asked_items = measure_hot(asked, ["user_id"], ["business_id"])
    known = lookup_join(
        asked.distinct(), latest.select("business_id").distinct(), ["business_id"], "inner",
        hot=asked_items, spread=["user_id"],
    )
    (rating_users,) = measure_hot(train, ["user_id"])
    return N.candidates(
        known.select("user_id", F.col("business_id").alias("target")),
        latest.select("user_id", F.col("business_id").alias("item"), "stars"),
        target_users=asked_users,
        history_users=rating_users,
    ).select("user_id", "target", "item", "stars")


def _co_rating_stats(spark, sf):
    stage = parquet_stage(spark)
    stats = K.co_rating_moments(stage(R.latest_ratings(T.ratings(spark, sf, DENSE)), "latest"), stage=stage)
    return stats.where(F.col("item_a") < F.col("item_b")).select(
        "item_a", "item_b", "n", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb"
    )


def _requested_stats(spark, sf):
    """Moments of the pairs of a hold-out item and an item that its user rated before."""
    t = Tables(spark, sf)
    latest = t.stage(R.latest_ratings(t.train), "latest")
    wanted = Z.canonical_pairs(_candidates_of(t, latest), "target", "item")
    stats = K.requested_moments(latest, wanted, stage=t.stage)
    return stats.select("item_a", "item_b", "n", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb")


def _popular_pairs(spark, sf):
    return Z.popular_pairs(R.most_popular(T.ratings(spark, sf)))


def _co_raters(spark, sf):
    return Z.popular_co_raters(T.ratings(spark, sf))


def _common_raters(spark, sf):
    return B.popular_common_raters(T.ratings(spark, sf), stage=parquet_stage(spark))


def _similarity(measure: str, item: str) -> Query:
    def query(spark, sf):
        t = Tables(spark, sf, item)
        latest = t.stage(R.latest_ratings(t.train), "latest")
        wanted = t.stage(Z.canonical_pairs(_candidates_of(t, latest), "target", "item"), "pairs")
        targets = t.pairs.select("business_id").distinct()
        return Z.similarities(wanted, t.train, measure, targets=targets, stage=t.stage)
    return query


def _neighbours(find) -> Query:
    def query(spark, sf):
        t = Tables(spark, sf)
        return find(t.train, t.pairs, stage=t.stage)
    return query


def _predict(how, item: str = "l_partkey", **options) -> Query:
    def query(spark, sf):
        t = Tables(spark, sf, item)
        return how(t.train, t.pairs, stage=t.stage, **options).select(*PAIR, "prediction")
    return query


def _train_feature(spark, sf, item, **options):
    t = Tables(spark, sf, item)
    return N.predict_training_pairs(t.train, stage=t.stage, **options)


def _with_blanks(how, spark, sf):
    """Predictions for hold-out pairs in which the user, the business or both are blank."""
    t = Tables(spark, sf)
    asked = t.pairs.select(*[
        F.when(~F.substring(other, -1, 1).isin(*blank), F.col(c)).alias(c)
        for c, other, blank in (("user_id", "business_id", "13579"), ("business_id", "user_id", "02468"))
    ]).where(F.col("user_id").isNull() | F.col("business_id").isNull())
    return how(t.train, asked, stage=t.stage).select(*PAIR, "prediction")


def _scored(how, spark, sf):
    """Predictions for the distinct hold-out pairs beside every hold-out rating."""
    t = Tables(spark, sf)
    predicted = how(t.train, t.pairs.distinct(), distinct=True, stage=t.stage)
    return V.with_actuals(predicted, t.holdout)


def _rmse(spark, sf):
    return V.rmse(_scored(N.predict_cosine, spark, sf))


def _error_distribution(spark, sf):
    return V.error_distribution(_scored(N.predict_pearson, spark, sf))


def _mean_predictions(rows, means, key):
    (hot,) = measure_hot(rows, [key])
    other = PAIR[1 - PAIR.index(key)]
    joined = lookup_join(rows.select(*PAIR), means, [key], "inner", hot=hot, spread=[other])
    # rows of a pair have one key, so they are together already: no shuffle of their own
    return joined.select(*PAIR, F.col(means.columns[1]).alias("prediction")).distinct()


def _combined(spark, sf):
    t = Tables(spark, sf)
    first = _mean_predictions(t.train, R.user_means(t.train), "user_id")
    second = _mean_predictions(t.holdout, R.business_means(t.train), "business_id")
    return V.combine(first, second, R.latest_ratings(t.ratings))


def _labelled(spark, sf):
    ratings = Tables(spark, sf).ratings
    first = _mean_predictions(ratings, R.user_means(ratings), "user_id")
    second = _mean_predictions(ratings, R.business_means(ratings), "business_id")
    return V.label_closer(V.combine(first, second, R.latest_ratings(ratings)))


def _labels(spark, sf):
    return _labelled(spark, sf).select(*PAIR, "closer")


def _selected(spark, sf):
    labelled = _labelled(spark, sf)
    return V.choose(labelled.drop("closer", "actual"), labelled.select(*PAIR, "closer"))


def _impute(spark, sf):
    wide = X.business_wide(T.businesses(spark, sf))
    names = X.category_columns(wide, X.BUSINESS_WIDE)
    return E.impute(wide.select("business_id", *names), names)


def _fitted(t: Tables, read: bool):
    """The rows to learn from, their categories and the dictionary of these.

    The dictionary is made of the entities of the rows, which are staged only where they are ``read`` themselves.
    """
    train = _train_features(t)
    if read:
        train = t.stage(train, "train-features")
    names = X.category_columns(train, jobs.FEATURES)
    return train, names, E.fit_ordinal(train, names, entities=X.entity_rows(t.train, t.users, t.businesses))


def _dictionary(spark, sf):
    return _fitted(Tables(spark, sf, ordered=False), read=False)[2].frame


def _encode_train(spark, sf):
    train, names, dictionary = _fitted(Tables(spark, sf, ordered=False), read=True)
    return E.apply_ordinal(train.select(*PAIR, *names), dictionary, names)


def _encode_holdout(spark, sf):
    t = Tables(spark, sf, ordered=False)
    _, names, dictionary = _fitted(t, read=False)
    asked = X.feature_table(t.pairs, t.users, t.businesses)
    return E.apply_ordinal(asked.select(*PAIR, *names), dictionary, names)


def _encoded(spark, sf):
    train, _, dictionary = _fitted(Tables(spark, sf, ordered=False), read=True)
    return E.encode(train, jobs.FEATURES, dictionary, keep=[*PAIR, "stars"])


def _correlations(spark, sf):
    encoded = _encoded(spark, sf)
    return L.correlations(encoded, encoded.columns[3:])


def _correlations_with_gaps(spark, sf):
    t = Tables(spark, sf)
    joined = X.join_users(t.ratings.select(*PAIR, "stars"), X.user_engagement(t.users))
    return L.correlations(joined, X.USER_ENGAGEMENT)


def _top_features(spark, sf):
    return L.top_features(_correlations(spark, sf), 6)


def _feature_model(spark, sf, profile=S.FEATURE_MODEL):
    t = Tables(spark, sf)
    return jobs.feature_regression(t.train, t.pairs, t.users, t.businesses, profile=profile, stage=t.stage)


def _hybrid_model(spark, sf, profile=S.HYBRID_MODEL):
    t = Tables(spark, sf)
    return jobs.hybrid(t.train, t.pairs, t.users, t.businesses, T.checkins(spark, sf), profile=profile, stage=t.stage)


def _selector_model(spark, sf, profile=S.SHORT_HYBRID, selector=S.SHORT_SELECTOR, folds=0):
    t = Tables(spark, sf)
    return jobs.selected(
        t.train, t.pairs, t.users, t.businesses, T.checkins(spark, sf),
        profile=profile, selector=selector, folds=folds, stage=t.stage,
    )


def _scored_rows(model, **options) -> Query:
    """Which requested rows a model answers with a number between the stars, give or take one."""
    def query(spark, sf):
        return model(spark, sf, **options).select(*PAIR, F.col("prediction").between(0.0, 6.0).alias("scored"))
    return query


def _planted_rows(spark, sf):
    """Feature rows of all rated pairs, with a label that follows from them but for a tenth of noise; the hold-out apart.

    The tables' own stars are drawn at random, so a model need not beat their mean.
    """
    t = Tables(spark, sf)
    rows = X.feature_table(
        t.ratings.select(*PAIR, (F.col("rated_at.o_orderdate") < F.lit(T.HOLDOUT_FROM).cast("timestamp_ntz")).alias("train")),
        t.users, t.businesses,
    )
    rule = (
        F.coalesce(F.col("user_review_count"), F.lit(30)) % 4 + F.coalesce(F.col("business_review_count"), F.lit(0)) % 3
        + F.when(F.col("business_stars").isNull(), 2).otherwise((F.col("business_stars") > 3.0).cast("int"))
    )
    noise = F.pmod(F.xxhash64(*PAIR), F.lit(1000)) / 1000 - 0.5
    names = ["user_review_count", "average_stars", "business_stars", "business_review_count"]
    planted = rows.select(*PAIR, "train", *names, (rule + noise).cast("double").alias("planted"))
    return t.stage(planted, "planted"), names


def _planted_stars(spark, sf):
    """Does the regression model at its documented profile explain half of a planted label's variance on rows it has not seen?"""
    rows, names = _planted_rows(spark, sf)
    held = rows.where(~F.col("train"))
    model = M.fit_regressor(rows.where("train"), names, S.FEATURE_MODEL, label="planted")
    error = F.avg((F.col("prediction") - F.col("planted")) ** 2)
    return model.predict(held).agg(F.count("*").alias("n"), (error < 0.5 * F.var_pop("planted")).alias("beats_the_mean"))


def _planted_choice(spark, sf):
    """Is the selector right more often than its larger class, and calibrated to a twentieth, on rows it has not seen?"""
    rows, names = _planted_rows(spark, sf)
    rows = rows.withColumn("closer", (F.col("planted") > 3).cast("int"))
    scored = M.fit_selector(rows.where("train"), names, S.SHORT_SELECTOR).predict(rows.where(~F.col("train")))
    share = F.avg("closer")
    return scored.agg(
        F.count("*").alias("n"),
        (F.avg((F.col("prediction") == F.col("closer")).cast("int")) > F.greatest(share, 1 - share) + 0.05).alias("beats_larger_class"),
        (F.abs(F.avg("probability") - share) < 0.05).alias("calibrated"),
    )


def _written(frame: DataFrame, kind: str) -> str:
    """The frame as files of that kind in the shared folder, with one more column; their path."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    writer = frame.withColumn("further", F.lit("x")).write.option("header", True)
    getattr(writer, kind)(path)
    return path


def _read_ratings(spark, sf):
    path = _written(T.ratings(spark, sf).select(*PAIR, "stars"), "csv")
    return files.read_ratings(spark, path).select(*PAIR, "stars")


def _read_pairs(spark, sf):
    return files.read_pairs(spark, _written(pairs(spark, sf), "csv"))


def _read_users(spark, sf):
    path = _written(T.users(spark, sf), "json")
    return X.user_engagement(X.one_per_key(files.read_users(spark, path), "user_id"))


def _read_businesses(spark, sf):
    path = _written(T.businesses(spark, sf), "json")
    return X.business_wide(X.one_per_key(files.read_businesses(spark, path), "business_id"))


def _read_checkins(spark, sf):
    path = _written(T.checkins(spark, sf), "json")
    return C.totals(X.one_per_key(files.read_checkins(spark, path), "business_id"))


def _round_trip(spark, sf):
    """Ratings as predictions: written by the prediction writer and read again."""
    path = f"{shared_folder(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    files.write_predictions(T.ratings(spark, sf).select(*PAIR, F.col("stars").alias("prediction")), path)
    return files.read_ratings(spark, path, with_order=False).withColumnRenamed("stars", "prediction")


_QUERIES: dict[str, Query] = {
    # readers and the writer, over files made of the tables
    "read_ratings_csv": _read_ratings,
    "read_pairs_csv": _read_pairs,
    "read_users_json": _read_users,
    "read_businesses_json": _read_businesses,
    "read_checkins_json": _read_checkins,
    "predictions_round_trip": _round_trip,
    # scans
    "scan_ratings": lambda s, d: T.ratings(s, d).select(*PAIR, "stars"),
    "scan_validation_pairs": pairs,
    # entity features
    "business_features_wide": lambda s, d: X.business_wide(T.businesses(s, d)),
    "business_features_narrow": lambda s, d: X.business_narrow(T.businesses(s, d)),
    "user_features_basic": lambda s, d: X.user_basic(T.users(s, d)),
    "user_features_engagement": lambda s, d: X.user_engagement(T.users(s, d)),
    "flatten_feature_row": _flat_business,
    # joins
    "join_user_features": _join_users,
    "join_business_features": _join_businesses,
    "business_checkin_join": lambda s, d: X.business_with_checkins(
        T.businesses(s, d), C.totals(T.checkins(s, d))
    ),
    "feature_table": _feature_table,
    "hybrid_feature_table": _hybrid_table,
    # rating statistics
    "user_mean_rating": lambda s, d: R.user_means(T.ratings(s, d)),
    "business_mean_rating": lambda s, d: R.business_means(T.ratings(s, d)),
    "users_per_business": lambda s, d: R.raters(T.ratings(s, d)),
    "businesses_per_user": lambda s, d: R.rated_items(T.ratings(s, d)),
    "business_popularity": lambda s, d: R.popularity(T.ratings(s, d)),
    "top_popular": lambda s, d: R.most_popular(T.ratings(s, d)),
    "last_rating": lambda s, d: R.latest_ratings(T.ratings(s, d)),
    # co-rating and similarity
    "cf_candidates": _candidates,
    "co_rating_stats": _co_rating_stats,
    "co_rating_stats_requested": _requested_stats,
    "co_raters": _co_raters,
    "co_rater_counts": _common_raters,
    "popular_item_pairs": _popular_pairs,
    "popular_pair_similarity": lambda s, d: Z.popular_pair_similarities(T.ratings(s, d)),
    "pearson_similarity": _similarity("pearson", DENSE),
    "cosine_similarity": _similarity("cosine", "l_partkey"),
    # neighbours and predictions
    "top_neighbours": _neighbours(N.pearson_neighbours),
    "top_neighbours_15": _neighbours(N.cosine_neighbours),
    "predict_pearson_cf": _predict(N.predict_pearson),
    "predict_pearson_cf_dense": _predict(N.predict_pearson, DENSE),
    "predict_cosine_cf": _predict(N.predict_cosine),
    "cf_train_feature": lambda s, d: _train_feature(s, d, "l_partkey"),
    # small sizes, so that the routes of hot keys run on the test tables too
    "predict_pearson_cf_skewed": _predict(N.predict_pearson, DENSE, tuning=SKEWED),
    "predict_cosine_cf_skewed": _predict(N.predict_cosine, tuning=SKEWED),
    "cf_train_feature_skewed": lambda s, d: _train_feature(s, d, "l_partkey", tuning=SKEWED),
    "predict_pearson_cf_blank_ids": lambda s, d: _with_blanks(N.predict_pearson, s, d),
    "predict_cosine_cf_blank_ids": lambda s, d: _with_blanks(N.predict_cosine, s, d),
    # check-ins
    "checkin_total": lambda s, d: C.totals(T.checkins(s, d)),
    "checkin_by_day": lambda s, d: C.by_day(T.checkins(s, d)),
    "checkin_by_hour": lambda s, d: C.by_hour(T.checkins(s, d)),
    "checkin_peak": lambda s, d: C.peaks(T.checkins(s, d)),
    # encoding and selection
    "impute_categorical": _impute,
    "ordinal_dictionary": _dictionary,
    "ordinal_encode_train": _encode_train,
    "ordinal_encode_validation": _encode_holdout,
    "encoded_feature_table": _encoded,
    "feature_correlations": _correlations,
    "feature_correlations_with_gaps": _correlations_with_gaps,
    "select_top_features": _top_features,
    # evaluation
    "rmse": _rmse,
    "error_distribution": _error_distribution,
    "combine_predictions": _combined,
    "closer_prediction_label": _labels,
    "select_prediction": _selected,
    # models, two of them at their documented profiles
    "gbt_feature_model": _feature_model,
    "gbt_hybrid_model": _hybrid_model,
    "gbt_selector_model": _selector_model,
    # the same models under SQL: every requested row is answered
    "gbt_feature_model_scored": _scored_rows(_feature_model, profile=S.QUICK_MODEL),
    "gbt_hybrid_model_scored": _scored_rows(_hybrid_model, profile=S.QUICK_MODEL),
    "gbt_selector_model_scored": _scored_rows(_selector_model, profile=S.QUICK_MODEL, selector=S.QUICK_MODEL),
    "gbt_selector_cross_fitted_scored": _scored_rows(_selector_model, profile=S.QUICK_MODEL, selector=S.QUICK_MODEL, folds=2),
    # and what they are worth on rows not seen, where there is something to learn
    "gbt_regression_planted": _planted_stars,
    "gbt_selector_planted": _planted_choice,
}


def _text_modules() -> list:
    """The text queries and the pipeline, as far as they are there; the rest works without them."""
    found = []
    for name, parts in (("starweave.llm.queries", ("starweave.llm",)), ("corpus_pipeline", ("corpus_pipeline", "starweave.llm"))):
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError as missing:
            if missing.name is None or not missing.name.startswith(parts):
                raise
    return found


def queries() -> dict[str, Query]:
    """One entry per operator; every query reads its whole tables."""
    own = {name: (lambda s, d, q=query: rounded(q(s, d))) for name, query in _QUERIES.items()}
    for module in _text_modules():
        own |= module.queries()
    return own


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows and column names."""
    own = oracle.oracle_sql()
    for module in _text_modules():
        own |= module.oracle_sql()
    return own


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: Pearson neighbour prediction of the hold-out pairs."""
    return queries()["predict_pearson_cf"](spark, "/root/testdata/sf0.001")
