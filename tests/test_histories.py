import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from starweave.operators import corating as K, histories as H, neighbours as N, ratings as R
from starweave.session import parquet_stage
from starweave.settings import Tuning
from tests.test_plans import plan

RATED = "user_id string, business_id string, stars double"
TUNINGS = [Tuning(), Tuning(heavy_user=3, grid_block=2, rows_per_slot=2, hot_keys=2)]


@pytest.mark.parametrize("values", [[1.0, 4.5, 0.0], [1.3, -2.0, 1e9]])
@pytest.mark.parametrize("with_means", [False, True])
def test_packed_histories_open_to_what_went_in(values, with_means):
    sizes = np.array([2, 0, 3, 1])
    items = np.array([7, 300, 0, 70_000, 2, 1 << 33])
    stars, blank = np.array([*values, *values]), np.array([False, True, False, False, False, True])
    means = np.array([0.1, 0.2, np.nan, 0.4, 0.5, 0.6])
    packed = H.pack(sizes, items, stars, blank, means if with_means else None)
    row, item, got, no_stars, got_means = H.unpack(pa.concat_arrays([packed, packed]).slice(1, 4))
    assert row.tolist() == [1, 1, 1, 2, 3, 3] and item.tolist() == [0, 70_000, 2, 1 << 33, 7, 300]
    order = [2, 3, 4, 5, 0, 1]
    assert no_stars.tolist() == blank[order].tolist()
    assert got.tolist() == np.where(blank, 0.0, stars)[order].tolist()
    if with_means:
        assert np.array_equal(got_means, means[order], equal_nan=True)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("with_means", [False, True])
def test_histories_in_order_take_few_bits(whole, with_means):
    rng = np.random.default_rng(3)
    sizes = np.array([0, 36, 1, 36, 0, 36])
    items = np.concatenate([np.sort(rng.choice(1_200_000, n, replace=False)) for n in sizes]).astype(np.int64)
    blank = rng.random(len(items)) < 0.1
    stars = np.where(blank, 0.0, rng.integers(1, 6, len(items)) / (1 if whole else 2))
    counts = rng.integers(1, 50, len(items))
    means = np.where(blank, np.nan, rng.integers(0, 250, len(items)) / 2 / counts) if with_means else None
    packed = H.pack(sizes, items, stars, blank, means, counts)
    row, item, got, no_stars, got_means = H.unpack(pa.concat_arrays([packed, packed]).slice(6))
    assert row.tolist() == np.repeat(np.arange(6), sizes).tolist() and item.tolist() == items.tolist()
    assert got.tolist() == stars.tolist() and no_stars.tolist() == blank.tolist()
    if with_means:
        assert np.array_equal(got_means, means, equal_nan=True)
    assert packed.buffers()[2].size < len(items) * (6 if with_means else 3.2)
    # means that are no quotient of their counts are kept as they are
    odd = np.full(len(items), 0.1)
    assert np.array_equal(H.unpack(H.pack(sizes, items, stars, blank, odd, counts))[4], odd)


def _rows(seed):
    """Ratings with blank stars, stars that are no half ones, and a user and an item with many."""
    rng = random.Random(seed)
    pairs = {(f"u{rng.randint(0, 9)}", f"b{rng.randint(0, 14):02}") for _ in range(70)}
    pairs |= {("u0", f"b{i:02}") for i in range(15)} | {(f"u{i}", "b03") for i in range(10)}
    return [(u, b, rng.choice([1.0, 2.5, 5.0, 0.75, None])) for u, b in sorted(pairs)]


@pytest.mark.parametrize("tuning", TUNINGS)
def test_moments_are_those_of_the_plain_join(spark, tuning):
    rated = spark.createDataFrame(_rows(2), RATED)
    plain = K.moments(K.co_ratings_by_user(rated))
    every = sorted(map(tuple, plain.select("item_a", "item_b", *K.MOMENTS).collect()), key=str)
    assert sorted(map(tuple, K.co_rating_moments(rated, tuning=tuning).collect()), key=str) == every


def test_only_users_with_many_ratings_have_cells_where_the_list_is_full(spark):
    tuning = Tuning(heavy_user=4, grid_block=4, rows_per_slot=4, hot_keys=1)
    numbers = {"a": 14, "b": 9, "c": 4, "d": 1}
    rows = [(u, i, float(i % 5)) for u, n in numbers.items() for i in range(n)]
    rated = spark.createDataFrame(rows, "user_id string, item_no bigint, stars double").withColumn("is_target", F.col("item_no") % 2 == 0)
    (hot,) = H.measure_hot(rated, ["user_id"], tuning=tuning)
    assert len(hot.counts) == 1 and hot.other_splits(4) > 1
    packed = H.histories(rated, hot, tuning, with_targets=True).collect()
    cells = {u: {r["cells"] for r in packed if r["user_id"] == u} for u in numbers}
    assert cells["c"] == cells["d"] == {1} and min(cells["a"]) > 1 and min(cells["b"]) > 1
    _, items, stars, _, _ = H.unpack(pa.array([r["h"] for r in packed], pa.binary()))
    owners = [r["user_id"] for r in packed for _ in range(r["size"])]
    assert sorted(zip(owners, items.tolist(), stars.tolist())) == sorted(rows)
    targets = [(r["user_id"], t["t"], t["stars"]) for r in packed for t in r["targets"] or []]
    assert sorted(targets) == sorted(r for r in rows if r[1] % 2 == 0)
    assert len({(r["user_id"], r["cell"]) for r in packed}) == len(packed)


def test_targets_outside_a_full_list_have_the_slots_they_need(spark):
    h = H.pack(np.array([6]), np.arange(6), np.ones(6), np.zeros(6, bool), None).to_pylist()[0]
    rows = spark.createDataFrame([(1, 1, 0, h), (2, 3, 0, h), (3, 1, 1, h)], "t bigint, own int, kind tinyint, h binary").withColumn("cells", F.lit(1))
    got = H._slotted(rows.select("t", "own", "kind", "cells", F.lit(2.0).alias("stars"), "h"), [(3, 4)], 5, mark=True).collect()
    slots = {t: sorted({r["slot"] for r in got if r["t"] == t}) for t in (1, 2, 3)}
    assert slots[1] == [0] and len(slots[2]) > 1 and max(slots[2]) < 3 and len(slots[3]) > 1
    assert {r["t"]: r["kind"] for r in got} == {1: 0, 2: 0, 3: 2}


@pytest.mark.parametrize("tuning", [Tuning(), Tuning(broadcast_rows=0)])
def test_pairs_are_not_broadcast_to_get_their_names(spark, tmp_path, tuning):
    rated = spark.createDataFrame(_rows(6), RATED)
    found = K.co_rating_moments(rated, tuning=tuning, stage=parquet_stage(spark, str(tmp_path)))
    text = plan(found).split("Initial Plan")[-1]
    assert "BuildLeft" not in text and ("SortMergeJoin" if not tuning.broadcast_rows else "BroadcastHashJoin") in text
    plain = K.moments(K.co_ratings_by_user(rated)).select("item_a", "item_b", *K.MOMENTS)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_a_group_over_several_blocks_is_summed_once(spark, monkeypatch):
    rated = spark.createDataFrame(_rows(4), RATED)
    every = sorted(map(tuple, K.moments(K.co_ratings_by_user(rated)).select("item_a", "item_b", *K.MOMENTS).collect()), key=str)
    rows = rated.join(H.number_items(rated), "business_id").select("user_id", "item_no", "stars", F.lit(True).alias("is_target"))
    packed = H.histories(rows, H.HotKeys(("user_id",)), Tuning(), with_targets=True)
    sent = H._raters(packed, H.HotKeys(("user_id",)), Tuning()).withColumns({"slot": F.lit(0), "kind": F.lit(0).cast("tinyint")})
    batch = sent.orderBy("t").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(H, "_blocks", lambda batches: (b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)))
    names = {r["item_no"]: r["business_id"] for r in H.number_items(rated).collect()}
    got = [r for b in H._working(H.Answer("moments"))(iter([batch])) for r in b.to_pylist()]
    assert sorted([(names[r["t"]], names[r["item_no"]], *[r[c] for c in K.MOMENTS]) for r in got], key=str) == every


def test_no_co_rating_is_a_row_of_a_shuffle(spark):
    rated = spark.createDataFrame(_rows(3), RATED)
    for frame in (
        K.co_rating_moments(rated), K.requested_moments(rated, spark.createDataFrame([("b01", "b03")], "item_a string, item_b string")),
        N.pearson_neighbours(rated, rated.select("user_id", "business_id")),
    ):
        assert "sum_ab" not in plan(frame).split("MapInArrow")[0] and "MapInArrow" in plan(frame)
        assert "sum((stars" not in plan(frame) and "sum((_stars" not in plan(frame)
    assert R.latest_ratings(rated).count() == rated.count()


@pytest.mark.parametrize("tuning", TUNINGS[:1])
def test_blank_items_count_as_the_target_itself(spark, tuning):
    rows = [("u0", "b1", 4.0), ("u0", None, 2.0), ("u1", "b1", 3.0), ("u1", "b2", 1.0)]
    rated = spark.createDataFrame(rows, RATED)
    (near,) = N.cosine_neighbours(rated, rated.where("user_id = 'u0' and business_id = 'b1'").select("user_id", "business_id"), tuning=tuning).collect()
    # (4, 4), (3, 3) and (2, 4): three co-ratings
    assert near["similarity"] == pytest.approx(3 / 13 * 33 / (29 ** 0.5 * 41 ** 0.5))
