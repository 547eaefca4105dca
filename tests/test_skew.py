import pytest
from pyspark.sql import functions as F

from starweave.operators import skew as K
from starweave.settings import DEFAULT_TUNING, Tuning

SMALL = Tuning(heavy_user=5, grid_block=5, rows_per_slot=5)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows have key "hot", a tenth a NULL key."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(
        (F.col("id") % 40).cast("string")
    )
    return spark.range(600).select(key.alias("k"), F.col("id").alias("v"))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_measure_hot_counts_each_key_set_in_one_pass(facts):
    by_key, by_both = K.measure_hot(facts, ["k"], ["k", "v"], tuning=SMALL)
    assert by_key.keys == ("k",) and by_both.counts == {}
    assert by_key.counts[("hot",)] == 200
    assert by_key.splits(50) == {("hot",): 4, (None,): 1} or by_key.splits(50)[("hot",)] == 4


@pytest.mark.parametrize("limit", [1, 7, 40, 1000])
def test_keys_outside_the_list_have_no_more_than_the_rest(spark, limit):
    """Counts of all sizes, many of them equal, counted by many tasks; a NULL key among them."""
    spread = spark.range(60).select(
        F.when(F.col("id") != 7, F.col("id")).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(20) + (F.col("id") % 9) * (F.col("id") % 4))).alias("v")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        keys, pairs = K.measure_hot(spread.repartition(40), ["k"], ["k", "v"], tuning=Tuning(heavy_user=21, grid_block=21, rows_per_slot=21, hot_keys=limit))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    counts = {(r["k"],): r["count"] for r in spread.groupBy("k").count().collect()}
    hot = {k: n for k, n in counts.items() if n > 21}
    assert pairs.counts == {} and pairs.rest == 0
    assert len(keys.counts) == min(limit, len(hot)) and all(counts[k] == n for k, n in keys.counts.items())
    outside = [n for k, n in hot.items() if k not in keys.counts]
    assert max(outside, default=0) <= keys.rest <= (1.1 * max(outside) if outside else 0)
    # what is listed is hot as well: at most a tenth below what is not
    assert not outside or min(keys.counts.values()) > 0.9 * max(outside)


def test_hot_keys_are_not_ranked_in_one_task(facts, monkeypatch):
    plans = []
    collect = type(facts).collect
    monkeypatch.setattr(type(facts), "collect", lambda frame: plans.append(frame._jdf.queryExecution().toString()) or collect(frame))
    K.measure_hot(facts, ["k"], tuning=Tuning(heavy_user=1, grid_block=1, rows_per_slot=1, hot_keys=3))
    assert plans and not any("Window" in p or "Sort [" in p for p in plans)


def test_measure_hot_is_bounded(facts):
    (hot,) = K.measure_hot(facts, ["k"], tuning=Tuning(heavy_user=1, hot_keys=2))
    assert len(hot.counts) == 2 and ("hot",) in hot.counts


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_plain_join(spark, facts, how):
    dimension = facts.where(F.col("k").isNotNull()).select("k").distinct().where("k <> '7'").withColumn("d", F.upper("k"))
    (hot,) = K.measure_hot(facts, ["k"], tuning=SMALL)
    assert hot.splits(SMALL.rows_per_slot)
    salted = K.lookup_join(facts, dimension, ["k"], how, hot=hot, spread=["v"], tuning=SMALL)
    assert rows(salted.select("k", "v", "d")) == rows(facts.join(dimension, "k", how).select("k", "v", "d"))


def test_copies_of_one_row_spread(spark):
    copies = spark.range(4000, numPartitions=16).select(F.lit("hot").alias("k"))
    slot = K._slot_of([], "s")
    used = copies.withColumn("s", F.lit(8).cast("bigint")).select(slot.alias("slot")).groupBy("slot").count().collect()
    assert len(used) > 1
    assert max(r["count"] for r in used) < 4000


def test_grid_join_equals_plain_join_and_bounds_cells(spark, facts):
    left = facts.where("v < 200").withColumnRenamed("v", "l")
    right = facts.withColumnRenamed("v", "r")
    (left_hot,) = K.measure_hot(left, ["k"], tuning=SMALL)
    (right_hot,) = K.measure_hot(right, ["k"], tuning=SMALL)
    joined = K.grid_join(
        left, right, "k", left_hot=left_hot, right_hot=right_hot, left_spread=["l"], right_spread=["r"], tuning=SMALL
    )
    assert joined.columns == ["k", "l", "r"]
    assert rows(joined) == rows(left.join(right, "k"))


def test_nothing_hot_plans_the_plain_join(facts):
    (hot,) = K.measure_hot(facts, ["k"], tuning=DEFAULT_TUNING)
    assert hot.counts == {}
    joined = K.lookup_join(facts, facts.select("k").distinct(), ["k"], hot=hot)
    assert joined.columns == ["k", "v"]


def test_each_key_set_has_its_own_limit(spark):
    """Many hot items do not crowd out the one hot user."""
    rows = [("hotuser", f"i{n}") for n in range(30)] + [(f"u{n}", f"big{n % 8}") for n in range(800)]
    frame = spark.createDataFrame(rows, "u string, i string")
    users, items = K.measure_hot(frame, ["u"], ["i"], tuning=Tuning(heavy_user=5, grid_block=5, rows_per_slot=5, hot_keys=3))
    assert users.counts == {("hotuser",): 30} and users.rest == 0
    assert len(items.counts) == 3 and set(items.counts.values()) == {100} and items.rest == 100


def _cells(frame, key, names):
    return frame.groupBy(key, *names).count().agg(F.max("count")).first()[0]


def test_more_hot_keys_than_the_list_holds_are_all_split(spark, monkeypatch):
    frame = spark.range(2400).select((F.col("id") % 6).cast("string").alias("k"), F.col("id").alias("v"))
    tuning = Tuning(heavy_user=10, grid_block=10, rows_per_slot=10, hot_keys=2)
    (hot,) = K.measure_hot(frame, ["k"], tuning=tuning)
    assert len(hot.counts) == 2 and hot.rest == 400 and hot.other_splits(10) == 40
    dimension = frame.select("k").distinct().withColumn("d", F.upper("k"))
    joined = K.lookup_join(frame, dimension, ["k"], hot=hot, spread=["v"], tuning=tuning)
    assert rows(joined.select("k", "v", "d")) == rows(frame.join(dimension, "k").select("k", "v", "d"))
    slotted = K._routed(frame, ["k"], {}, ["_splits"], [40]).withColumn("slot", K._slot_of(["v"], "_splits"))
    assert _cells(slotted, "k", ["slot"]) < 40  # ten on average, never a whole key
    grid = K.grid_join(frame, frame.withColumnRenamed("v", "w").where("w < 60"), "k", left_hot=hot, right_hot=hot,
                       left_spread=["v"], right_spread=["w"], tuning=tuning)
    assert grid.count() == 2400 * 10


@pytest.mark.parametrize("how", ["left", "inner"])
def test_pair_lookup_bounds_pairs_by_their_keys(spark, how):
    facts = spark.range(900).select(
        (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"), F.col("id").alias("v")
    )
    dimension = facts.select("a", "b").distinct().where("a <> '2' or b <> '1'").withColumn("d", F.concat("a", "b"))
    tuning = Tuning(heavy_user=10, grid_block=10, rows_per_slot=10, hot_keys=1)
    bounds = K.measure_hot(facts, ["a"], ["b"], tuning=tuning)
    joined = K.pair_lookup_join(facts, dimension, bounds, how, spread=["v"], tuning=tuning)
    assert rows(joined.select("a", "b", "v", "d")) == rows(facts.join(dimension, ["a", "b"], how).select("a", "b", "v", "d"))
