import math
import random

import pytest
from pyspark.sql import functions as F

from starweave.operators import checkins as C, encoding as E, evaluation as V, features as X, selection as L
from starweave.settings import DEFAULT_TUNING, Tuning
from starweave.sources import schemas

TINY = Tuning(heavy_user=1, grid_block=1, rows_per_slot=1, broadcast_rows=1)


@pytest.fixture(scope="module")
def entities(spark):
    users = spark.createDataFrame(
        [("u1", 5, "2010-01-01", 4.0, 1, 2, 3, 4), ("u2", 7, None, 3.0, None, None, None, None)], schemas.USER
    )
    businesses = spark.createDataFrame(
        [("b1", "A", 4.5, 10, 1, ("quiet",) + (None,) * 7), ("b2", "B", 2.0, 3, 0, None)], schemas.BUSINESS
    )
    checkins = spark.createDataFrame(
        [("b1", {"Fri-0": 2, "Sat-13": 1, "Fri-13": 2}), ("b9", {"Mon-1": 1}), ("b3", {}), ("b4", None)],
        schemas.CHECKIN,
    )
    return users, businesses, checkins


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("u1", "b1", 5.0), ("u1", "b2", 3.0), ("u2", "b1", 4.0), ("u9", "b9", 1.0)],
        "user_id string, business_id string, stars double",
    )


@pytest.mark.parametrize("tuning", [DEFAULT_TUNING, TINY])
def test_feature_table_keeps_unknown_entities(entities, rows, tuning):
    users, businesses, _ = entities
    table = X.feature_table(rows, users, businesses, tuning=tuning)
    assert table.columns == ["user_id", "business_id", "stars", *X.USER_BASIC, *X.BUSINESS_WIDE]
    got = {(r["user_id"], r["business_id"]): r for r in table.collect()}
    assert len(got) == 4
    assert got["u1", "b1"]["NoiseLevel"] == "quiet" and got["u1", "b2"]["NoiseLevel"] is None
    assert got["u9", "b9"]["average_stars"] is None and got["u9", "b9"]["business_stars"] is None


@pytest.mark.parametrize("tuning", [DEFAULT_TUNING, TINY])
def test_business_without_checkins_has_no_features(spark, entities, rows, tuning):
    users, businesses, checkins = entities
    cf = spark.createDataFrame([("u1", "b1", 4.25)], schemas.PREDICTION)
    table = X.hybrid_feature_table(rows, users, businesses, C.totals(checkins), cf, tuning=tuning)
    got = {(r["user_id"], r["business_id"]): r for r in table.collect()}
    assert got["u1", "b1"]["checkin_total"] == 5 and got["u1", "b1"]["cf_prediction"] == 4.25
    assert got["u1", "b2"]["business_stars"] is None and got["u1", "b2"]["is_open"] is None
    assert got["u2", "b1"]["useful"] is None and got["u2", "b1"]["cf_prediction"] is None


def test_flatten_nested_structs(spark):
    frame = spark.sql("SELECT 1 AS a, struct(2 AS b, struct(3 AS c, 4 AS d) AS e) AS f, 5 AS g")
    assert X.flatten(frame).columns == ["a", "b", "c", "d", "g"]
    assert tuple(X.flatten(frame).first()) == (1, 2, 3, 4, 5)


def test_checkin_aggregates(entities):
    checkins = entities[2]
    assert dict(map(tuple, C.totals(checkins).collect())) == {"b1": 5, "b9": 1, "b3": 0, "b4": 0}
    days = {(r[0], r[1]): r[2] for r in C.by_day(checkins).collect()}
    assert days == {("b1", "Fri"): 4, ("b1", "Sat"): 1, ("b9", "Mon"): 1}
    hours = {(r[0], r[1]): r[2] for r in C.by_hour(checkins).collect()}
    assert hours == {("b1", 0): 2, ("b1", 13): 3, ("b9", 1): 1}
    peaks = {r[0]: tuple(r)[1:] for r in C.peaks(checkins).collect()}
    assert peaks == {"b1": ("Fri", 13, 2), "b9": ("Mon", 1, 1), "b3": (None, None, 0), "b4": (None, None, 0)}


@pytest.mark.parametrize("tuning", [DEFAULT_TUNING, TINY])
def test_ordinal_codes(spark, tuning):
    train = spark.createDataFrame(
        [("b", "2", 1.0), (None, "10", 2.0), ("zz", "2", 3.0), ("a", "1", 4.0), ("b", None, 5.0)] * 3,
        "x string, y string, n double",
    )
    fitted = E.fit_ordinal(train, ["x", "y"])
    codes = {(r["column"], r["value"]): r["code"] for r in fitted.frame.collect()}
    assert codes == {
        ("x", "a"): 0, ("x", "b"): 1, ("x", "missing"): 2, ("x", "zz"): 3,
        ("y", "1"): 0, ("y", "10"): 1, ("y", "2"): 2, ("y", "missing"): 3,
    }
    assert fitted.sizes == {"x": 4, "y": 4}
    new = spark.createDataFrame([("b", "3", 1.0), (None, "1", 2.0)], "x string, y string, n double")
    coded = E.encode(new, ["x", "n", "y"], fitted, tuning=tuning)
    assert coded.columns == ["n", "x", "y"] == E.encoded_order(new, ["x", "n", "y"])
    assert sorted(map(tuple, coded.collect())) == [(1.0, 1.0, None), (2.0, 2.0, 0.0)]
    filled = E.encode(new, ["x", "n", "y"], fitted, unknown=-1, tuning=tuning)
    assert sorted(map(tuple, filled.collect())) == [(1.0, 1.0, -1.0), (2.0, 2.0, 0.0)]


def test_codes_follow_the_order_over_many_ranges(spark):
    names = [f"c{i:05}" for i in range(3000)]
    shuffled = random.Random(1).sample(names, len(names))
    frame = spark.createDataFrame([(n, n[-1]) for n in shuffled], "x string, y string").repartition(7)
    fitted = E.fit_ordinal(frame, ["y", "x"])
    codes = {r["value"]: r["code"] for r in fitted.frame.where("column = 'x'").collect()}
    assert codes == {n: float(i) for i, n in enumerate(names)}
    assert fitted.sizes == {"x": 3000, "y": 10}


def test_correlations_and_selection(spark):
    rng = random.Random(2)
    data = [(rng.random(), rng.random(), 7.0, None if i == 3 else rng.random()) for i in range(50)]
    data = [(2 * a - b + 0.1 * rng.random(), a, b, c, d) for a, b, c, d in data]
    frame = spark.createDataFrame(data, "stars double, a double, b double, flat double, gap double")
    names = ["gap", "flat", "b", "a"]
    got = {r["feature"]: r["correlation"] for r in L.correlations(frame, names).collect()}

    def pearson(i):
        ys, xs = [r[0] for r in data], [r[i] for r in data]
        my, mx = sum(ys) / 50, sum(xs) / 50
        cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
        return cov / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))

    assert got["a"] == pytest.approx(pearson(1)) and got["b"] == pytest.approx(pearson(2))
    assert got["flat"] is None and got["gap"] is None
    assert L.select_top(frame, names, n=3) == ["a", "b", "gap"]
    pairwise = {r["feature"]: r["correlation"] for r in L.correlations(frame, names, pairwise=True).collect()}
    assert pairwise["gap"] is not None and pairwise["a"] == pytest.approx(got["a"])


def test_errors_weigh_copies(spark):
    schema = "user_id string, business_id string, prediction double"
    predicted = spark.createDataFrame([("u", "a", 3.0), ("u", "a", 3.0), ("u", "b", 1.0), ("u", "x", 1.0)], schema)
    actual = spark.createDataFrame([("u", "a", 5.0), ("u", "b", 1.5), ("u", "b", 5.0)], schema.replace("prediction", "stars"))
    scored = V.with_actuals(predicted, actual)
    # two rows with error 2, one with 0.5, one with 4
    one = V.rmse(scored).first()
    assert one["n"] == 4 and one["rmse"] == pytest.approx(math.sqrt((4 + 4 + 0.25 + 16) / 4))
    assert dict(map(tuple, V.error_distribution(scored).collect())) == {0: 1, 2: 2, 4: 1}
    empty = V.rmse(scored.where("false")).first()
    assert empty["n"] == 0 and empty["rmse"] is None


def test_choosing_between_predictions(spark):
    schema = "user_id string, business_id string, prediction double"
    first = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 1.0)], schema)
    second = spark.createDataFrame([("u", "a", 5.0), ("u", "c", 2.0)], schema)
    actual = spark.createDataFrame([("u", "a", 4.5), ("u", "d", 1.0)], schema.replace("prediction", "stars"))
    combined = V.combine(first, second, actual)
    labelled = {r["business_id"]: r["closer"] for r in V.label_closer(combined).collect()}
    assert labelled == {"a": 1, "b": None, "c": None, "d": None}
    tie = V.label_closer(spark.sql("SELECT 1D AS first, 3D AS second, 2D AS actual"))
    assert tie.first()["closer"] == 1
    classes = spark.createDataFrame([("u", "a", 0), ("u", "c", 1), ("u", "z", 1)], "user_id string, business_id string, closer int")
    chosen = {r["business_id"]: r["prediction"] for r in V.choose(V.combine(first, second), classes).collect()}
    assert chosen == {"a": 3.0, "c": 2.0}


def test_dictionary_of_entities_equals_that_of_the_rows(spark):
    users = spark.createDataFrame([("u1", 3, "2010-01-01", 4.0), ("u2", 1, None, 2.0), ("u9", 1, "2011", 2.0)],
                                  "user_id string, review_count long, yelping_since string, average_stars double")
    businesses = spark.createDataFrame([("b1", "p1", 4.0, 1, 1, None)], schemas.BUSINESS)
    rows = spark.createDataFrame([("u1", "b1", 5.0), ("u2", "b1", 3.0), ("u3", "b2", 1.0)], "user_id string, business_id string, stars double")
    table = X.feature_table(rows, users, businesses)
    names = X.category_columns(table, (*X.USER_BASIC, *X.BUSINESS_WIDE))
    plain = E.fit_ordinal(table, names)
    fitted = E.fit_ordinal(table, names, entities=X.entity_rows(rows, users, businesses))
    show = lambda d: sorted(map(tuple, d.frame.collect()))
    assert show(fitted) == show(plain) and fitted.sizes == plain.sizes and fitted.widths == plain.widths
    assert ("yelping_since", "2010-01-01", 0.0) in show(fitted) and ("yelping_since", "2011", 1.0) not in show(fitted)
    assert ("NoiseLevel", "missing", 0.0) in show(fitted)


def test_no_category_column_gives_an_empty_dictionary(spark):
    frame = spark.createDataFrame([(1.0,)], "x double")
    fitted = E.fit_ordinal(frame, [])
    assert fitted.frame.count() == 0 and fitted.sizes == {}
    assert E.encode(frame, ["x"], fitted).collect()[0]["x"] == 1.0


def test_wide_dictionaries_are_not_broadcast(spark):
    frame = spark.createDataFrame([("a" * 40,), ("b" * 40,), (None,)], "x string")
    fitted = E.fit_ordinal(frame, ["x"])
    for most in (10, 1000):
        coded = E.apply_ordinal(frame, fitted, ["x"], tuning=Tuning(broadcast_bytes=most, heavy_user=1, grid_block=1, rows_per_slot=1))
        assert sorted(r["x"] for r in coded.collect()) == [0.0, 1.0, 2.0]
