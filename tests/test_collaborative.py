import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from brute_force import Ratings
from conftest import PAIR, RATING
from starweave.operators import corating as K, neighbours as N, ratings as R, similarity as Z
from starweave.plans import jobs
from starweave.session import parquet_stage
from starweave.settings import DEFAULT_TUNING, Tuning

SIMILARITIES = {
    ("b1", "b2"): (4, -0.404520, 0.250426),
    ("b1", "b3"): (3, -0.188982, 0.206120),
    ("b1", "b4"): (1, 0.800000, 0.090909),
    ("b2", "b3"): (2, 0.616667, 0.165647),
    ("b2", "b4"): (1, 0.850000, 0.090909),
    ("b3", "b4"): (0, 0.466667, 0.0),
}
PREDICTIONS = {
    ("u1", "b3"): (2.561714, 4.108867),
    ("u4", "b2"): (2.811618, 2.592481),
    ("u5", "b3"): (2.520946, 2.891133),
    ("u1", "b4"): (3.984848, 4.000000),
    ("u3", "b4"): (2.909449, 2.500000),
    ("u2", "b3"): (3.350075, 3.833163),
    ("u9", "b1"): (3.450000, 3.225000),
    ("u1", "b9"): (4.000000, 3.725000),
    ("u9", "b9"): (3.450000, 3.450000),
}
TUNINGS = [
    DEFAULT_TUNING,
    Tuning(heavy_user=1, grid_block=1, rows_per_slot=1),
    Tuning(heavy_user=6, grid_block=3, rows_per_slot=4, hot_keys=5),
]


def values(frame, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in frame.collect()}


@pytest.mark.parametrize("by", ["user", "request"])
@pytest.mark.parametrize("measure,column", [("pearson", 1), ("cosine", 2)])
def test_golden_similarities(spark, golden, measure, column, by):
    pairs = spark.createDataFrame(list(SIMILARITIES), "item_a string, item_b string")
    rows = Z.similarities(pairs, golden, measure, by=by).collect()
    assert len(rows) == len(SIMILARITIES)
    for row in rows:
        expected = SIMILARITIES[row["item_a"], row["item_b"]]
        assert row["n"] == expected[0]
        assert row["similarity"] == pytest.approx(expected[column], abs=1e-6)


def test_unknown_item_has_no_similarity(spark, golden):
    pairs = spark.createDataFrame([("b1", "b9")], "item_a string, item_b string")
    for measure in ("pearson", "cosine"):
        assert Z.similarities(pairs, golden, measure).first()["similarity"] == 0.0


def test_golden_predictions(spark, golden):
    pairs = spark.createDataFrame(list(PREDICTIONS), PAIR)
    for column, predict in enumerate((N.predict_pearson, N.predict_cosine)):
        got = values(predict(golden, pairs), "user_id", "business_id", value="prediction")
        assert set(got) == set(PREDICTIONS)
        for pair, expected in PREDICTIONS.items():
            assert got[pair] == pytest.approx(expected[column], abs=1e-6), pair


def skewed_rows(seed=5):
    """One user and one item each hold about a third of the rows."""
    rng = random.Random(seed)
    users, items = [f"u{i:02}" for i in range(14)], [f"b{i:02}" for i in range(26)]
    rows = [("hot", i) for i in items] + [(u, "b00") for u in users for _ in range(2)]
    rows += [(rng.choice(users), rng.choice(items)) for _ in range(70)]
    # b01 gets one and the same rating from everyone: no variance
    stars = [4.0 if i == "b01" else float(rng.randint(1, 5)) for _, i in rows]
    rows = [(u, i, s, n) for n, ((u, i), s) in enumerate(zip(rows, stars))]
    for u in users[:5]:
        rows.append((u, "b01", 4.0, len(rows)))
    rng.shuffle(rows)
    asked = [(u, i) for u in [*users[:6], "hot", "new"] for i in [*items[::3], "b01", "none"]]
    return rows, asked + asked[:4] + [asked[0]] * 30


@pytest.mark.parametrize("tuning", TUNINGS[:3])
def test_skewed_predictions_match_brute_force(spark, tuning):
    stage = parquet_stage(spark)
    rows, asked = skewed_rows()
    truth = Ratings(rows)
    ratings = spark.createDataFrame(rows, RATING + ", rated_at int").repartition(3)
    pairs = spark.createDataFrame(asked, PAIR).repartition(5)
    for predict, expected in ((N.predict_pearson, truth.predict_pearson), (N.predict_cosine, truth.predict_cosine)):
        got = predict(ratings, pairs, tuning=tuning, stage=stage).collect()
        assert sorted((r["user_id"], r["business_id"]) for r in got) == sorted(asked)
        for row in got:
            want = expected(row["user_id"], row["business_id"])
            assert row["prediction"] == pytest.approx(want, abs=1e-9), row


@pytest.mark.parametrize("exclude", [False, True])
def test_training_pairs(spark, exclude):
    rows, _ = skewed_rows(8)
    truth = Ratings(rows)
    ratings = spark.createDataFrame(rows, RATING + ", rated_at int")
    got = N.predict_training_pairs(ratings, exclude_target=exclude, tuning=TUNINGS[2]).collect()
    assert len(got) == len({(u, i) for u, i, _, _ in rows})
    for row in got:
        want = truth.predict_cosine(row["user_id"], row["business_id"], exclude=exclude)
        assert row["prediction"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("exclude", [False, True])
def test_long_tail_of_a_hot_user_is_cut_exactly(spark, exclude):
    rng = random.Random(11)
    tail = [f"t{i:03}" for i in range(120)]
    rows = [("hot", i, float(rng.randint(1, 5))) for i in [*tail, "b0", "b1", "b2"]]
    rows += [(u, b, float(rng.randint(1, 5))) for u in "uvwxyz" for b in ("b0", "b1", "b2", "b3")]
    rows += [("u", i, float(rng.randint(1, 5))) for i in tail[50:70]]
    rows = [(*r, n) for n, r in enumerate(rows)]
    truth = Ratings(rows)
    ratings = spark.createDataFrame(rows, RATING + ", rated_at int")
    asked = [("hot", t) for t in ("b3", "b0", "t000", "t001", "t055", "t119")] + [("u", "t003"), ("u", "b1")]
    pairs = spark.createDataFrame(asked, PAIR)
    tuning = Tuning(heavy_user=40, grid_block=8)
    request = N._Request(ratings, pairs, tuning, lambda frame, name: frame)
    for measure in ("pearson", "cosine"):
        opened = request.candidates(measure, 3, exclude).where("user_id = 'hot'")
        assert opened.count() < 6 * len(truth.by_user["hot"]) / 2
    for row in N.predict_cosine(ratings, pairs, 3, exclude_target=exclude, tuning=tuning).collect():
        want = truth.predict_cosine(row["user_id"], row["business_id"], 3, exclude)
        assert row["prediction"] == pytest.approx(want, abs=1e-9), row
    if not exclude:
        for row in N.predict_pearson(ratings, pairs, 3, tuning=tuning).collect():
            want = truth.predict_pearson(row["user_id"], row["business_id"], 3)
            assert row["prediction"] == pytest.approx(want, abs=1e-9), row


def test_one_pass_covers_rated_and_requested_pairs(spark):
    rows, asked = skewed_rows(9)
    truth = Ratings(rows)
    ratings = spark.createDataFrame(rows, RATING + ", rated_at int")
    pairs = spark.createDataFrame(asked, PAIR)
    stage = parquet_stage(spark)
    got = values(jobs.cf_predictions(ratings, pairs, stage=stage, tuning=TUNINGS[2]), "user_id", "business_id", value="prediction")
    assert set(got) == {(u, i) for u, i, _, _ in rows} | set(asked)
    for pair, prediction in got.items():
        assert prediction == pytest.approx(truth.predict_cosine(*pair), abs=1e-9)


def test_more_than_k_neighbours_and_ties(spark):
    # all items are rated alike by two users, so all similarities are equal
    rows = [(u, f"b{i:02}", 3.0 + (u == "y") - 2.0 * (u == "y" and i == 0)) for u in "xy" for i in range(20)]
    ratings = spark.createDataFrame(rows, RATING)
    pairs = spark.createDataFrame([("x", "b19")], PAIR)
    near = N.cosine_neighbours(ratings, pairs, 5).orderBy("rank").collect()
    assert [r["item"] for r in near] == ["b01", "b02", "b03", "b04", "b05"]
    assert [r["rank"] for r in near] == [1, 2, 3, 4, 5]


def test_both_ways_to_co_ratings_agree(spark):
    rows, _ = skewed_rows(3)
    latest = R.latest_ratings(spark.createDataFrame(rows, RATING + ", rated_at int"))
    every = K.co_rating_moments(latest)
    pairs = every.select("item_a", "item_b")

    def table(frame):
        return sorted(map(tuple, frame.select(*["item_a", "item_b", *K.MOMENTS]).collect()))

    expected = table(every)
    for tuning in TUNINGS[1:3]:
        assert table(K.co_rating_moments(latest, tuning=tuning)) == expected
        assert table(K.co_rating_moments(latest, pairs=pairs, tuning=tuning)) == expected
    assert table(K.moments(K.co_ratings_by_request(pairs, latest))) == expected


def test_requested_moments_are_those_of_the_pairs_asked_for(spark, monkeypatch):
    from starweave.operators import pair_filter

    rows, _ = skewed_rows(3)
    latest = R.latest_ratings(spark.createDataFrame(rows, RATING + ", rated_at int"))
    every = {(r["item_a"], r["item_b"]): tuple(r) for r in K.co_rating_moments(latest).collect()}
    asked = sorted(every)[::5]
    odd = [asked[0], ("b0", "none"), (asked[0][1] + "x", asked[0][0]), (None, "b1"), ("b1", None)]
    pairs = spark.createDataFrame(asked + odd, "item_a string, item_b string")
    for sent in (pair_filter.BROADCAST_BYTES, 0):  # with the bitmap, and where it would be too large
        monkeypatch.setattr(pair_filter, "BROADCAST_BYTES", sent)
        for tuning in TUNINGS[:3]:
            got = K.requested_moments(latest, pairs, tuning=tuning).collect()
            assert sorted(map(tuple, got)) == [every[p] for p in asked]
    assert K.requested_moments(latest, pairs.limit(0)).count() == 0


def test_the_bitmap_drops_nearly_all_other_pairs_before_the_sums(spark):
    from starweave.operators.pair_filter import only_requested

    rows = spark.range(20_000).selectExpr("id as item_a", "id + 1 as item_b")
    wanted = rows.where("item_a % 10 = 0")
    kept = only_requested(rows, wanted, ["item_a", "item_b"], 2000)
    assert kept.columns == rows.columns and kept.where("item_a % 10 = 0").count() == 2000
    assert kept.count() < 2000 + 18_000 * 0.03
    text = kept.groupBy("item_a").count()._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    assert next(i for i, x in enumerate(lines) if "Aggregate" in x) < next(i for i, x in enumerate(lines) if "_words" in x)


def test_targets_restrict_the_pairs(spark, golden):
    flagged = R.latest_ratings(golden).withColumn("t", F.col("business_id") == "b4")
    got = K.co_rating_moments(flagged, target_flag="t").select("item_a", "item_b").collect()
    assert sorted(map(tuple, got)) == [("b1", "b4"), ("b2", "b4"), ("b4", "b4")]


def test_popular_pairs(spark, golden):
    assert [r["business_id"] for r in R.most_popular(golden, 3).collect()] == ["b1", "b2", "b3"]
    pairs = Z.popular_pairs(R.most_popular(golden, 3)).collect()
    assert sorted(map(tuple, pairs)) == [("b1", "b2"), ("b1", "b3"), ("b2", "b3")]
    got = values(Z.popular_pair_similarities(golden), "item_a", "item_b", value="pearson")
    assert got == pytest.approx({k: v[1] for k, v in SIMILARITIES.items()}, abs=1e-6)


def test_last_duplicate_wins_and_means_use_all_rows(spark):
    rows = [("u", "b", 1.0, 1), ("u", "b", 5.0, 2), ("u", "b", 2.0, 3)]
    ratings = spark.createDataFrame(rows, RATING + ", rated_at int")
    assert R.latest_ratings(ratings).first()["stars"] == 2.0
    assert R.latest_ratings(ratings.drop("rated_at")).first()["stars"] == 5.0
    assert R.user_means(ratings).first()["user_mean"] == pytest.approx(8 / 3)
    assert R.business_means(ratings).first()["n_ratings"] == 3


def test_sets_are_relations(spark, golden):
    twice = golden.union(golden)
    assert R.raters(twice).count() == golden.count()
    assert R.rated_items(twice).count() == golden.count()


ratings_rows = st.lists(
    st.tuples(st.sampled_from("uvwxyz"), st.sampled_from("abcdef"), st.sampled_from([1.0, 1.5, 2.0, 3.0, 4.5, 5.0])),
    min_size=1, max_size=30, unique_by=lambda r: r[:2],
)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ratings_rows)
def test_properties(spark, rows):
    ratings = spark.createDataFrame(rows, RATING)
    pairs = ratings.select("user_id").distinct().crossJoin(ratings.select("business_id").distinct())
    truth = Ratings([(*r, 0) for r in rows])
    both = N.predict_pearson(ratings, pairs).withColumnRenamed("prediction", "p").join(
        N.predict_cosine(ratings, pairs), ["user_id", "business_id"]
    ).collect()
    assert len(both) == len({r[0] for r in rows}) * len({r[1] for r in rows})
    for row in both:
        pair = row["user_id"], row["business_id"]
        assert 1 <= row["prediction"] <= 5
        assert row["prediction"] == pytest.approx(truth.predict_cosine(*pair), abs=1e-9)
        assert row["p"] == pytest.approx(truth.predict_pearson(*pair), abs=1e-9)
    items = sorted({r[1] for r in rows})
    wanted = spark.createDataFrame([(a, b) for a in items for b in items if a <= b], "item_a string, item_b string")
    for row in Z.similarities(wanted, ratings, "pearson").collect():
        assert abs(row["similarity"]) <= 1 + 1e-12
    for row in Z.similarities(wanted, ratings, "cosine").collect():
        assert 0 <= row["similarity"] < 1


@pytest.mark.parametrize("how", [N.predict_pearson, N.predict_cosine])
def test_blank_ids_are_unknown(spark, golden, how):
    pairs = spark.createDataFrame([("u1", None), (None, "b1"), (None, None), ("u1", None), ("u1", "b3")], PAIR)
    got = sorted(map(tuple, how(golden, pairs).select("user_id", "business_id", "prediction").collect()), key=str)
    mean = {r["user_id"]: r["m"] for r in golden.groupBy("user_id").agg(F.avg("stars").alias("m")).collect()}["u1"]
    item = {r["business_id"]: r["m"] for r in golden.groupBy("business_id").agg(F.avg("stars").alias("m")).collect()}["b1"]
    blank = {row[:2]: row[2] for row in got if None in row[:2]}
    if how is N.predict_pearson:
        assert blank == {("u1", None): pytest.approx(mean), (None, "b1"): 3.45, (None, None): 3.45}
    else:
        assert blank == {k: pytest.approx(v) for k, v in {
            ("u1", None): (mean + 3.45) / 2, (None, "b1"): (3.45 + item) / 2, (None, None): 3.45}.items()}
    assert len(got) == 5 and all(row[2] is not None for row in got)


def test_only_ratings_of_popular_items_are_used(golden):
    popular, few = Z.ratings_of_popular(golden, 2)
    top = [r["business_id"] for r in popular.collect()]
    assert top == [r["business_id"] for r in R.most_popular(golden, 2).collect()]
    assert sorted(r[0] for r in few.select("business_id").distinct().collect()) == sorted(top)
