from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from starweave.operators import bitmaps, similarity
from tests.conftest import RATING


def test_numbers_are_dense_and_skip_blanks(spark):
    ids = spark.createDataFrame([(f"u{i % 700}",) for i in range(2000)] + [(None,)], "user_id string").repartition(5)
    got = bitmaps.dense_numbers(ids, "user_id").collect()
    assert len({r["user_id"] for r in got}) == len(got) == 700
    assert sorted(r["number"] for r in got) == list(range(1, 701))


def test_counts_equal_the_sets(spark):
    rows = [(f"u{i * 7 % 83}", f"b{i * i % 11}", float(i % 5 + 1)) for i in range(600)] + [(None, "b1", 3.0), (None, "b4", 2.0)]
    ratings = spark.createDataFrame(rows, RATING)
    raters = defaultdict(set)
    for user, item, _ in rows:
        if user is not None:
            raters[item].add(user)
    got = {(r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["n"]) for r in bitmaps.popular_common_raters(ratings).collect()}
    assert got == {
        (a, b): (len(raters[a]), len(raters[b]), len(raters[a] & raters[b])) for a, b in combinations(sorted(raters), 2)
    }
    rows = similarity.popular_co_raters(ratings).groupBy("item_a", "item_b").count().collect()
    assert {(r["item_a"], r["item_b"]): r["count"] for r in rows} == {k: v[2] for k, v in got.items() if v[2]}


def test_more_raters_than_a_bucket_holds(spark):
    # b0 has all 70,000 users (three buckets), b1 every third, b2 every seventh, b3 nobody of the others
    users = spark.range(70_000).withColumn("user_id", F.concat(F.lit("u"), "id"))
    parts = [users.where(f"id % {step} = 0").select("user_id", F.lit(f"b{i}").alias("business_id"), F.lit(3.0).alias("stars"))
             for i, step in enumerate((1, 3, 7))]
    ratings = parts[0].union(parts[1]).union(parts[2]).union(spark.createDataFrame([("other", "b3", 1.0)], RATING))
    got = {(r["item_a"], r["item_b"]): r["n"] for r in bitmaps.popular_common_raters(ratings).collect()}
    assert got == {("b0", "b1"): 23334, ("b0", "b2"): 10000, ("b1", "b2"): 3334, ("b0", "b3"): 0, ("b1", "b3"): 0, ("b2", "b3"): 0}
    numbers = bitmaps.dense_numbers(ratings, "user_id")
    assert bitmaps.rater_bitmaps(ratings, numbers).where("business_id = 'b0'").count() == 3


@pytest.mark.parametrize("rows", [[], [("u1", "b1", 3.0)]])
def test_no_pairs(spark, rows):
    assert bitmaps.popular_common_raters(spark.createDataFrame(rows, RATING)).collect() == []


def test_bitmaps_are_dealt_once(spark, golden):
    sets = bitmaps.rater_bitmaps(golden, bitmaps.dense_numbers(golden, "user_id"))
    pairs = spark.createDataFrame([("b1", "b2")], "item_a string, item_b string")
    plan = bitmaps.common_counts(sets, pairs)._jdf.queryExecution().executedPlan().toString()
    # the AND by pair and bucket needs no exchange of its own: bitmaps lie by bucket
    assert plan.count("hashpartitioning(bucket") == 1 and "hashpartitioning(item_a#" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "item_a" in line and "bucket" in line]
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
