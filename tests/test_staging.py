"""Queries join the ratings once, however often they read them."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from starweave.operators import neighbours as N, ratings as R
from starweave.session import parquet_stage
from starweave.sources import fixture_views as T

RATED_AT = "struct<o_orderdate: timestamp_ntz, o_orderkey: bigint, l_linenumber: int, l_quantity: double, l_shipdate: timestamp_ntz, l_extendedprice: double>"


def rating_rows(spark):
    rows = []
    for i in range(60):
        day = datetime.datetime(2000 if i % 4 else 2001, 3, 1 + i % 20)
        item = f"b{i * 5 % 9}" if i % 10 else f"b{i // 10 % 2}"
        rows.append((f"u{i % 7}" if i % 13 else None, item if i % 17 else None, float(1 + i % 5), (day, i, 1, 1.0, day, 2.0)))
        if i % 6 == 0:
            rows.append(rows[-1])
    return spark.createDataFrame(rows, f"user_id string, business_id string, stars double, rated_at {RATED_AT}")


@pytest.mark.parametrize("name", ["predict_pearson_cf", "error_distribution", "co_rating_stats_requested", "closer_prediction_label", "combine_predictions"])
def test_ratings_are_joined_once(spark, monkeypatch, name):
    made = []
    monkeypatch.setattr(T, "ratings", lambda *_: made.append(1) or rating_rows(spark))
    assert entry.queries()[name](spark, "nowhere").count() > 0
    assert len(made) == 1


@pytest.mark.parametrize("predict", [N.predict_pearson, N.predict_cosine])
def test_distinct_pairs_have_the_same_predictions(spark, predict):
    ratings = rating_rows(spark)
    pairs = ratings.select("user_id", "business_id").union(spark.createDataFrame([("u1", "new"), ("new", "b1"), (None, "b2")], "a string, b string")).distinct()
    found = [
        sorted(predict(ratings, pairs, distinct=d).select("user_id", "business_id", F.round("prediction", 9)).collect(), key=str) for d in (False, True)
    ]
    assert found[0] == found[1] and len(found[0]) == pairs.count()


@pytest.mark.parametrize("key", entry.PAIR)
def test_mean_predictions_have_a_row_for_each_pair(spark, key):
    ratings = rating_rows(spark)
    means = ratings.groupBy(key).agg(F.avg("stars").alias("mean"))
    known = ratings.where(F.col(key).isNotNull()).select(*entry.PAIR).distinct()
    expected = sorted(known.join(means, key).select(*entry.PAIR, "mean").collect(), key=str)
    assert sorted(map(tuple, entry._mean_predictions(ratings, means, key).collect()), key=str) == [tuple(r) for r in expected]


def test_validation_is_encoded_without_writing_rows_to_learn_from(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(entry, "parquet_stage", lambda _: lambda frame, name: staged.setdefault(name, frame))
    assert entry.queries()["ordinal_encode_validation"](spark, "/root/testdata/sf0.001").count() > 0
    assert set(staged) == {"ratings", "users", "businesses"}
    assert staged["ratings"].schema["rated_at"].dataType.names == ["o_orderdate"]


@pytest.mark.parametrize("dealt_by", [None, "business_id"])
def test_settled_ratings_are_the_latest(spark, dealt_by):
    rows = [("a", "x", 1.0, 1), ("a", "x", 2.0, 2), ("a", "y", 3.0, 5), ("a", "y", 3.0, 4), ("b", "x", None, 1), ("b", "x", 4.0, 2),
            ("b", "y", None, 3), ("b", "y", None, 4), ("c", "x", 5.0, None), ("c", "y", float("nan"), 1), (None, "x", 2.0, 1), ("c", None, 2.0, 1)]
    ratings = spark.createDataFrame(rows, "user_id string, business_id string, stars double, rated_at int")
    last = {(r["user_id"], r["business_id"]): str(r["stars"]) for r in R.latest_ratings(ratings).collect()}
    found = R.settled_ratings(ratings, dealt_by=dealt_by).collect()
    assert {(r["user_id"], r["business_id"]) for r in found} == set(last) and len(found) == len(last)
    assert {(r["user_id"], r["business_id"]): str(r["stars"]) for r in found if r["settled"]}.items() <= last.items()
    assert {(r["user_id"], r["business_id"]) for r in found if not r["settled"]} == {("a", "x"), ("b", "x"), ("c", "x")}


@pytest.mark.parametrize("last", [1.0, 5.0])
def test_neighbours_use_the_latest_of_unlike_ratings(spark, last):
    day = "struct<o_orderdate: int>"
    rows = [("u", "x", 6.0 - last, (1,)), ("u", "x", last, (2,)), ("u", "y", 3.0, (1,)), ("v", "x", 2.0, (1,)), ("v", "y", 4.0, (1,))]
    ratings = spark.createDataFrame(rows, f"user_id string, business_id string, stars double, rated_at {day}")
    near = N.cosine_neighbours(ratings, ratings.where("user_id = 'u' and business_id = 'y'").select(*entry.PAIR))
    assert {r["item"]: r["stars"] for r in near.collect()} == {"x": last, "y": 3.0}


def test_requests_of_means_travel_without_names_and_means(spark, monkeypatch):
    sent, ratings = [], rating_rows(spark)
    pairs = ratings.select(*entry.PAIR).distinct()
    plain = N.nearest
    monkeypatch.setattr(N, "nearest", lambda asked, *rest, **options: sent.append(asked) or plain(asked, *rest, **options))
    N.predict_cosine(ratings, pairs)
    N.predict_pearson(ratings, pairs)
    assert [f.schema["target"].dataType.simpleString() for f in sent] == ["bigint", "bigint"]
    assert [f.where("mean is not null").isEmpty() for f in sent] == [True, False]


def test_rated_pairs_are_neither_written_nor_dealt_twice(spark, tmp_path):
    """They are made distinct where their items' means are joined."""
    ratings, names = rating_rows(spark), []
    write = parquet_stage(spark, str(tmp_path))
    found = N.predict_training_pairs(ratings, stage=lambda frame, name: names.append(name) or write(frame, name))
    assert "asked-pairs" not in names
    pairs = ratings.select("user_id", "business_id").distinct()
    plain = N.predict_cosine(ratings, pairs, all_items=True, distinct=True)
    shown = [sorted(f.select("user_id", "business_id", F.round("prediction", 9)).collect(), key=str) for f in (found, plain)]
    assert shown[0] == shown[1] and len(shown[0]) == pairs.count() < ratings.count()
