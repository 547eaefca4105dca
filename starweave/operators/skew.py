"""Joins that keep working when one key holds a large part of the rows.

Hot keys are measured with one partially aggregated pass.  For each key set
at most ``Tuning.hot_keys`` of them come to the driver and are broadcast
again.  How many rows a key outside the list has at most is known too; all
such keys are split as if they had that many.  So a list that
is too short costs copies of the small side, never an unsplit hot key.  Where
nothing needs splitting the plain join is planned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from starweave.settings import DEFAULT_TUNING, Tuning

_SLOT, _SLOT_L, _SLOT_R = "_slot", "_slot_l", "_slot_r"
_N, _SPLITS = "_n", "_splits"
_SET, _CLASS = "_set", "_class"
#: Classes of counts for each doubling: counts of a class differ by less than a tenth.
_CLASSES = 8


@dataclass(frozen=True)
class HotKeys:
    """Frequent keys of a relation, with their row counts.

    ``rest`` is the most rows that a key outside the list may have, as far
    as that matters for splitting.
    """

    keys: tuple[str, ...]
    counts: dict[tuple, int] = field(default_factory=dict)
    rest: int = 0

    def renamed(self, *keys: str) -> HotKeys:
        return HotKeys(keys, self.counts, self.rest)

    def splits(self, rows_per_slot: int) -> dict[tuple, int]:
        """Number of slots for each key which needs more than one."""
        return {k: -(-n // rows_per_slot) for k, n in self.counts.items() if n > rows_per_slot}

    def other_splits(self, rows_per_slot: int) -> int:
        """Number of slots for each key outside the list."""
        return max(1, -(-self.rest // rows_per_slot))


def measure_hot(frame: DataFrame, *key_sets: Sequence[str], tuning: Tuning = DEFAULT_TUNING) -> list[HotKeys]:
    """Hot keys for several key column sets, in one pass over ``frame``; each set has its own limit.

    Keys are never ranked.  They fall into classes of about equal counts, and
    a histogram of the classes (some hundred rows, added up in each task)
    says down to which class the list takes all keys.  Of the first class
    that does not fit, any keys fill the list up; its largest count bounds
    all keys outside.  So no task gets more than its share of the keys, and
    the driver gets the histogram and ``hot_keys`` keys of each set.
    """
    columns = list(dict.fromkeys(c for keys in key_sets for c in keys))
    counted = frame.select(*columns).groupingSets(
        [[F.col(c) for c in keys] for keys in key_sets], *[F.col(c) for c in columns]
    ).agg(F.count("*").alias(_N), F.grouping_id().alias(_SET)).where(F.col(_N) > tuning.hot_from)
    # few keys are hot, and they are read twice; a lost block is counted again
    counted = counted.withColumn(_CLASS, F.floor(F.log2(_N) * _CLASSES).cast("int")).persist()
    try:
        classes = counted.groupBy(_SET, _CLASS).agg(F.count("*").alias("keys"), F.max(_N).alias("most")).collect()
        return [_listed(counted, keys, columns, classes, tuning.hot_keys) for keys in key_sets]
    finally:
        counted.unpersist()


def _listed(counted: DataFrame, keys: Sequence[str], columns: list[str], classes: list, limit: int) -> HotKeys:
    """The keys of one set: whole classes from the top, then as many of the next class as there is room for."""
    # grouping_id has a 1 bit for every column that is not in the set
    mask = int("".join("0" if c in keys else "1" for c in columns), 2)
    room, lowest, partly = limit, None, None
    for c in sorted((c for c in classes if c[_SET] == mask), key=lambda c: -c[_CLASS]):
        if c["keys"] > room:
            partly = c
            break
        room, lowest = room - c["keys"], c[_CLASS]
    of_set = counted.where(F.col(_SET) == mask).select(*keys, _N, _CLASS)
    found = of_set.where(F.col(_CLASS) >= lowest).collect() if lowest is not None else []
    if partly and room:
        found += of_set.where(F.col(_CLASS) == partly[_CLASS]).limit(room).collect()
    return HotKeys(tuple(keys), {tuple(row[k] for k in keys): row[_N] for row in found}, partly["most"] if partly else 0)


def _routed(
    frame: DataFrame, keys: Sequence[str], table: dict[tuple, tuple[int, ...]], names: Sequence[str],
    others: Sequence[int],
) -> DataFrame:
    """Attach the numbers of listed keys (``others`` for all the rest); no shuffle."""
    if not table:
        return frame.select("*", *[F.lit(o).cast("bigint").alias(n) for n, o in zip(names, others)])
    schema = T.StructType(
        [T.StructField(f"_k{i}", frame.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField(n, T.LongType()) for n in names]
    )
    hot = frame.sparkSession.createDataFrame([(*k, *v) for k, v in table.items()], schema)
    on = None
    for i, key in enumerate(keys):
        same = F.col(key).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    joined = frame.join(F.broadcast(hot), on, "left")
    return joined.select(
        *frame.columns, *[F.coalesce(F.col(n), F.lit(o).cast("bigint")).alias(n) for n, o in zip(names, others)]
    )


def _slot_of(spread: Sequence[str], splits: str) -> Column:
    """Slot of a row: the same again when a lost task is recomputed.

    The partition number lets even exact copies of one row spread.
    """
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in spread]), F.col(splits))


def _all_slots(splits: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(splits) - 1))


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    hot: HotKeys,
    spread: Sequence[str] = (),
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Join facts to a relation with at most one row per key.

    The facts of a hot key go to several slots, and its dimension rows are
    repeated for each of them.  ``hot`` may be known for some of the keys only.
    """
    keys, route = list(keys), list(hot.keys)
    table = {k: (n,) for k, n in hot.splits(tuning.rows_per_slot).items()}
    other = hot.other_splits(tuning.rows_per_slot)
    if not table and other == 1:
        return facts.join(dimension, keys, how)
    left, right = (_routed(side, route, table, [_SPLITS], [other]) for side in (facts, dimension))
    return _slotted(left, right, keys, how, spread)


def _slotted(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Sequence[str]) -> DataFrame:
    left = left.withColumn(_SLOT, _slot_of(spread, _SPLITS)).drop(_SPLITS)
    right = right.withColumn(_SLOT, _all_slots(_SPLITS)).drop(_SPLITS)
    return left.join(right, [*keys, _SLOT], how).drop(_SLOT)


def pair_lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    bounds: Sequence[HotKeys],
    how: str = "left",
    *,
    spread: Sequence[str] = (),
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Lookup by a pair of keys of which only the single keys have been measured.

    No pair has more rows than either of its keys, so the smaller count of
    the two says into how many slots it goes; pairs are never counted or
    listed.  Unlisted keys count with the most that they may have.
    """
    per_slot = tuning.rows_per_slot
    keys = [b.keys[0] for b in bounds]
    most = min(max([b.rest, *b.counts.values()]) for b in bounds)
    if most <= per_slot:
        return facts.join(dimension, keys, how)
    names = ["_most_a", "_most_b"]

    def with_splits(side: DataFrame) -> DataFrame:
        columns = side.columns
        for b, name in zip(bounds, names):
            table = {k: (n,) for k, n in b.counts.items() if n > per_slot}
            side = _routed(side, list(b.keys), table, [name], [max(b.rest, 1)])
        return side.select(*columns, F.ceil(F.least(*names) / per_slot).cast("bigint").alias(_SPLITS))

    return _slotted(with_splits(facts), with_splits(dimension), keys, how, spread)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    left_hot: HotKeys,
    right_hot: HotKeys,
    left_spread: Sequence[str],
    right_spread: Sequence[str],
    tuning: Tuning = DEFAULT_TUNING,
) -> DataFrame:
    """Inner join where both sides may hold many rows of one key.

    The product of a hot key is cut into a grid of cells with at most about
    ``grid_block`` rows on either side, so no task makes a whole product.
    """
    rows, cols = left_hot.splits(tuning.grid_block), right_hot.splits(tuning.grid_block)
    others = [side.other_splits(tuning.grid_block) for side in (left_hot, right_hot)]
    table = {k: (rows.get(k, others[0]), cols.get(k, others[1])) for k in {**rows, **cols} if k[0] is not None}
    if not table and others == [1, 1]:
        return left.join(right, key)
    names = ["_rows", "_cols"]
    l = (
        _routed(left, [key], table, names, others)
        .withColumn(_SLOT_L, _slot_of(left_spread, "_rows"))
        .withColumn(_SLOT_R, _all_slots("_cols"))
        .drop(*names)
    )
    r = (
        _routed(right, [key], table, names, others)
        .withColumn(_SLOT_R, _slot_of(right_spread, "_cols"))
        .withColumn(_SLOT_L, _all_slots("_rows"))
        .drop(*names)
    )
    return l.join(r, [key, _SLOT_L, _SLOT_R]).drop(_SLOT_L, _SLOT_R)
