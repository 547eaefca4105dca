import json
import random

import pytest
from pyspark.sql import functions as F

from starweave import settings as S
from starweave.operators import models as M
from starweave.plans import jobs, run
from starweave.session import shared_folder
from starweave.sources import schemas


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """Small input files whose stars follow user and business features."""
    folder, rng = tmp_path_factory.mktemp("inputs"), random.Random(4)
    users = [{"user_id": f"u{i}", "review_count": i, "yelping_since": f"20{10 + i % 9}-01-01",
              "average_stars": 1 + i % 5, "useful": i % 3, "funny": 1, "cool": None, "fans": i % 2} for i in range(30)]
    places = [{"business_id": f"b{i}", "postal_code": str(i % 4), "stars": 1 + i % 5, "review_count": i, "is_open": i % 2,
               "attributes": {"NoiseLevel": "loud" if i % 2 else "quiet"} if i % 3 else None} for i in range(20)]
    checkins = [{"business_id": f"b{i}", "time": {"Fri-1": i + 1}} for i in range(15)]
    for name, records in (("user", users), ("business", places), ("checkin", checkins)):
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, records)))
    rated = [(f"u{rng.randrange(30)}", f"b{rng.randrange(20)}") for _ in range(400)]
    lines = [f"{u},{b},{(1 + int(u[1:]) % 5 + 1 + int(b[1:]) % 5) / 2}" for u, b in rated]
    (folder / "train.csv").write_text("user_id,business_id,stars\n" + "\n".join(lines))
    asked = [(f"u{rng.randrange(32)}", f"b{rng.randrange(22)}") for _ in range(40)]
    (folder / "val.csv").write_text("user_id,business_id,stars\n" + "\n".join(f"{u},{b},1" for u, b in asked))
    return folder, asked


@pytest.mark.parametrize("job,options", [
    ("cf", {}),
    ("features", {"profile": S.QUICK_MODEL, "n_features": 5}),
    ("hybrid", {"profile": S.QUICK_MODEL}),
    ("selected", {"profile": S.QUICK_MODEL, "selector": S.QUICK_MODEL}),
])
def test_command_line(spark, inputs, tmp_path, job, options):
    folder, asked = inputs
    out = str(tmp_path / "out")
    run.main([
        job, "--train", f"{folder}/train.csv", "--pairs", f"{folder}/val.csv", "--out", out,
        "--users", f"{folder}/user.json", "--businesses", f"{folder}/business.json",
        "--checkins", f"{folder}/checkin.json",
    ], spark=spark, **options)
    got = spark.read.schema(schemas.PREDICTION).option("header", True).csv(out).collect()
    keys = sorted((r["user_id"], r["business_id"]) for r in got)
    # the selector answers once per pair, the others once per input row
    assert keys == sorted(set(asked) if job == "selected" else asked)
    assert all(r["prediction"] is not None and abs(r["prediction"]) < 100 for r in got)


def test_cf_source_train_leaves_new_pairs_without_prediction(spark):
    ratings = spark.createDataFrame([("u1", "b1", 5.0), ("u2", "b1", 3.0), ("u2", "b2", 4.0)], schemas.RATING)
    pairs = spark.createDataFrame([("u1", "b2"), ("u2", "b2")], "user_id string, business_id string")
    users = spark.createDataFrame([], schemas.USER)
    businesses = spark.createDataFrame([], schemas.BUSINESS)
    checkins = spark.createDataFrame([], schemas.CHECKIN)
    for source, known in (("validation", {"u1", "u2"}), ("train", {"u2"})):
        _, asked = jobs.hybrid_tables(ratings, pairs, users, businesses, checkins, cf_source=source)
        assert {r["user_id"] for r in asked.collect() if r["cf_prediction"] is not None} == known
    with pytest.raises(ValueError):
        jobs.hybrid_tables(ratings, pairs, users, businesses, checkins, cf_source="other")


def test_regressor_learns_and_takes_gaps(spark):
    frame = spark.range(400).select(
        (F.col("id") % 5).cast("double").alias("a"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("double")).alias("b"),
        F.lit(None).cast("double").alias("never"),
        (1 + F.col("id") % 5).cast("double").alias("stars"),
    ).coalesce(1)
    model = M.fit_regressor(frame, ["a", "b", "never"], S.QUICK_MODEL)
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2)))
    assert model.predict(frame).agg(error).first()[0] < 1.0   # the mean alone gives 1.41
    # a value that is only missing in the rows to score
    gap = frame.drop("stars").limit(3).withColumn("a", F.lit(None).cast("double"))
    assert all(r["prediction"] is not None for r in model.predict(gap).collect())


def test_selector_learns(spark):
    frame = spark.range(300).select(
        (F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 10 > 4).cast("int")).alias("closer"),
    ).coalesce(1)
    chooser = M.fit_selector(frame, ["a"], S.QUICK_MODEL)
    wrong = chooser.predict(frame).where("closer IS NOT NULL AND int(prediction) <> closer").count()
    assert wrong == 0


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_evaluate_and_options(spark, inputs, tmp_path):
    folder, asked = inputs
    predicted, out = str(tmp_path / "p"), str(tmp_path / "e")
    run.main(["cf", "--train", f"{folder}/train.csv", "--pairs", f"{folder}/val.csv", "--out", predicted, "--neighbours", "3"], spark=spark)
    run.main(["evaluate", "--predictions", predicted, "--pairs", f"{folder}/train.csv", "--out", out], spark=spark)
    rmse = spark.read.option("header", True).csv(f"{out}/rmse").first()
    buckets = spark.read.option("header", True).csv(f"{out}/errors").collect()
    assert int(rmse["n"]) == sum(int(r["n"]) for r in buckets)
    with pytest.raises(SystemExit):
        run.main(["features", "--train", "x", "--pairs", "y", "--out", "z"], spark=spark)
    args = run._arguments(["features", "--train", "x", "--pairs", "y", "--out", "z", "--users", "u", "--businesses", "b",
                           "--trees", "7", "--max-depth", "3", "--features", "4"])
    assert run._options(args) == {"profile": S.BoostingProfile(3, 0.051, 7, 0.8, 0.5, 60), "n_features": 4}
