"""Co-ratings of whole items: packed histories meet at each target.

A row for every co-rating is a hundred bytes; here every rating of a target
sends its user's history instead, two to four bytes for an item, to the target's
task.  The task adds up the co-ratings of a target with all items at once and
answers the requests for that target: no pair of ratings and no candidate is
ever a row of a shuffle.

Items have numbers in the order of their ids.  A history of a user with very
many ratings stands in cells of bounded size, and a target with very many
ratings is dealt to slots by its partner items.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from starweave import settings as S
from starweave.operators.skew import HotKeys, grid_join, lookup_join, measure_hot
from starweave.session import Stage, no_stage, shared_folder
from starweave.settings import Tuning

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

_FEW, _SPAN = S.FEW_CO_RATERS, S.RATING_SPAN
#: Bytes of packed histories that a task opens at once, and co-ratings for each task.
BLOCK_BYTES, TASK_WORK = 4 << 20, 4_000_000
_ROW_BITS, _ITEM_BITS = 33, 40
_NO_STARS = 255
#: Most cells of a user, outside the list of hot ones, that are collected in one list.
_LISTED = 16
#: Slot of a partner item: (number, so many bits of it, times the factor) shifted by 16, modulo the slots.
_MIXED, _FACTOR = (1 << 31) - 1, 2654435761
_SUMS = ("n", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb", "n_a", "n_b", "n_ab")
_LEAST, _MOST = ("min_a", "min_b"), ("max_a", "max_b")
COLUMNS = (*_SUMS, *_LEAST, *_MOST)


def number_items(ids: DataFrame) -> DataFrame:
    """``business_id, item_no``: the different ids without NULL, numbered from 0 in their order.

    A distributed sort; only the counts of its ranges come to the driver.  A
    checkpoint fixes the execution that the numbers come from.
    """
    shared_folder(ids.sparkSession)
    ordered = (
        ids.select("business_id").where(F.col("business_id").isNotNull()).distinct().orderBy("business_id")
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    )
    task = F.shiftrightunsigned("_id", _ROW_BITS)
    shifts, before = [], 0
    for row in sorted(ordered.groupBy(task.alias("_task")).count().collect(), key=lambda r: r["_task"]):
        shifts.append((row["_task"], before))
        before += row["count"]
    shift = ordered.sparkSession.createDataFrame(shifts, "_task bigint, _shift bigint")
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ordered.withColumn("_task", task).join(F.broadcast(shift), "_task").select(
        "business_id", (row + F.col("_shift")).alias("item_no")
    )


# --- packed histories ---------------------------------------------------------
# A byte that tells the layout, and one of two.  *Dense*, for histories in the
# order of item numbers and half stars: the bits of each field, then for every
# item as few bits as its history needs: the step from the item before, the
# stars, and if means are needed the number and the sum of the ratings that
# they come from.  *Plain*: the item numbers byte by byte (lowest first), then
# the stars (half stars in a byte; other values as doubles, each behind a byte
# that tells a NULL), then the means if they are needed.
_HALVES_NOT, _MEANS, _DENSE, _WHOLE = 16, 32, 64, 1
_DENSE_BITS = 56

def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that the largest value of each history needs; every history has one."""
    most = np.maximum.reduceat(values, np.cumsum(sizes) - sizes)
    return np.frexp(most.astype(float))[1].astype(np.int64)


def _fractions(means: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers of ratings and twice their sums, if every mean is exactly their quotient (unknown ones: 0, 0)."""
    if counts is None:
        return None
    unknown = np.isnan(means)
    n = np.where(unknown, 0, counts)
    twice = np.where(unknown, 0.0, np.rint(np.where(unknown, 0.0, means) * 2 * n))
    fits = (twice >= 0) & (twice < 1 << 30) & (n < 1 << 30) & ~np.signbit(means) & (twice / 2 / np.maximum(n, 1) == means) & (n > 0)
    return (n, twice.astype(np.int64)) if (fits | unknown).all() else None


def _dense(sizes: np.ndarray, items: np.ndarray, codes: np.ndarray, blank: np.ndarray, means: np.ndarray | None, counts: np.ndarray | None) -> pa.Array | None:
    """:func:`pack` in the dense layout, None where it does not fit."""
    step = np.diff(items, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[first] = items[first]
    if not len(items) or (step < 0).any():
        return None
    whole = bool((codes % 2 == 0).all())
    fields = [step, np.where(blank, 0, (codes // 2 if whole else codes) + 1).astype(np.int64)]
    if means is not None:
        both = _fractions(means, counts)
        if both is None:
            return None
        fields += both
    full = sizes[sizes > 0]
    widths = np.zeros((len(fields), len(sizes)), dtype=np.int64)
    widths[:, sizes > 0] = [_bits(f, full) for f in fields]
    widths[0] += np.maximum(8 - widths.sum(axis=0), 0)      # no byte has bits of three items
    width = widths.sum(axis=0)
    if width.max() > _DENSE_BITS:
        return None
    ends = np.cumsum(1 + len(fields) + (sizes * width + 7) // 8)
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(int(ends[-1]) + 8, dtype=np.uint8)
    out[starts] = _DENSE | (_MEANS if means is not None else 0) | (_WHOLE if whole else 0)
    code, below = np.zeros(len(items), dtype=np.uint64), np.zeros(len(sizes), dtype=np.int64)
    for i, (values, w) in enumerate(zip(fields, widths)):
        out[starts + 1 + i] = w
        code |= values.astype(np.uint64) << np.repeat(below, sizes).astype(np.uint64)
        below = below + w
    at = np.repeat((starts + 1 + len(fields)) * 8, sizes) + _ramp(sizes) * np.repeat(width, sizes)
    code <<= (at & 7).astype(np.uint64)
    at >>= 3
    for k in range((int(width.max()) + 14) // 8):
        # items are a byte apart at least, so no byte is met twice here
        out[at + k] |= ((code >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _undense(data: np.ndarray, begin: np.ndarray, end: np.ndarray, head: int) -> tuple[np.ndarray, ...]:
    """size of every history, then item, stars, blank, mean of every element."""
    with_means = bool(head & _MEANS)
    widths = [data[begin + 1 + i].astype(np.int64) for i in range(4 if with_means else 2)]
    width, begin = sum(widths), begin + 1 + len(widths)
    sizes = (end - begin) * 8 // width      # less than a byte is left over
    at = np.repeat(begin * 8, sizes) + _ramp(sizes) * np.repeat(width, sizes)
    shift, at = (at & 7).astype(np.uint64), at >> 3
    code = np.zeros(len(at), dtype=np.uint64)
    for k in range((int(width.max(initial=0)) + 14) // 8):
        code |= data[np.minimum(at + k, len(data) - 1)].astype(np.uint64) << np.uint64(8 * k)
    code >>= shift
    values = []
    for w in widths:
        bits = np.repeat(w, sizes).astype(np.uint64)
        values.append((code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
        code >>= bits
    total = np.cumsum(values[0])
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    blank = values[1] == 0
    stars = np.where(blank, 0.0, (values[1] - 1) / (1.0 if head & _WHOLE else 2.0))
    means = np.where(values[2] > 0, values[3] / 2 / np.maximum(values[2], 1), np.nan) if with_means else np.zeros(len(total))
    return sizes, total - np.repeat(before, sizes), stars, blank, means


def pack(
    sizes: np.ndarray, items: np.ndarray, stars: np.ndarray, blank: np.ndarray, means: np.ndarray | None, counts: np.ndarray | None = None
) -> pa.Array:
    """One binary value for each history; ``sizes`` tells how many of the elements it has, ``counts`` of how many ratings a mean is."""
    codes = np.where(blank, 0.0, stars) * 2
    halves = bool(((codes == np.floor(codes)) & (codes >= 0) & (codes < _NO_STARS) & ~np.signbit(codes)).all())
    dense = _dense(sizes, items, codes, blank, means, counts) if halves else None
    if dense is not None:
        return dense
    width = max(1, (int(items.max(initial=0)).bit_length() + 7) // 8)
    per = width + (1 if halves else 9) + (8 if means is not None else 0)
    ends = np.cumsum(1 + sizes * per)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - 1 - sizes * per
    out[starts] = width | (0 if halves else _HALVES_NOT) | (_MEANS if means is not None else 0)
    n, j = np.repeat(sizes, sizes), _ramp(sizes)
    at = np.repeat(starts + 1, sizes)
    for k in range(width):
        out[at + n * k + j] = (items >> (8 * k)) & 255
    at = at + n * width
    if halves:
        out[at + j] = np.where(blank, _NO_STARS, codes).astype(np.uint8)
        at = at + n
    else:
        out[at + j] = blank
        out[(at + n + 8 * j)[:, None] + np.arange(8)] = np.where(blank, 0.0, stars).view(np.uint8).reshape(-1, 8)
        at = at + 9 * n
    if means is not None:
        out[(at + 8 * j)[:, None] + np.arange(8)] = np.ascontiguousarray(means).view(np.uint8).reshape(-1, 8)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, ...]:
    """row, item, stars, blank, mean of every element, in the order of rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    empty = np.empty(0)
    if not len(column):
        return empty.astype(np.int64), empty.astype(np.int64), empty, empty.astype(bool), empty
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    heads = data[offsets[:-1]]
    parts = []
    for head in np.unique(heads):
        rows = np.flatnonzero(heads == head)
        if head & _DENSE:
            sizes, *elements = _undense(data, offsets[rows], offsets[rows + 1], int(head))
            parts.append((np.repeat(rows, sizes), *elements))
            continue
        width, halves, with_means = head & 15, not head & _HALVES_NOT, bool(head & _MEANS)
        per = int(width) + (1 if halves else 9) + (8 if with_means else 0)
        sizes = (offsets[rows + 1] - offsets[rows] - 1) // per
        n, j, at = np.repeat(sizes, sizes), _ramp(sizes), np.repeat(offsets[rows] + 1, sizes)
        items = np.zeros(len(n), dtype=np.int64)
        for k in range(width):
            items |= data[at + n * k + j].astype(np.int64) << (8 * k)
        at = at + n * width
        if halves:
            code = data[at + j]
            blank, stars = code == _NO_STARS, code / 2.0
            stars[blank] = 0.0
            at = at + n
        else:
            blank = data[at + j].astype(bool)
            stars = data[(at + n + 8 * j)[:, None] + np.arange(8)].reshape(-1).view(np.float64)
            at = at + 9 * n
        means = data[(at + 8 * j)[:, None] + np.arange(8)].reshape(-1).view(np.float64) if with_means else np.zeros(len(n))
        parts.append((np.repeat(rows, sizes), items, stars, blank, means))
    if len(parts) == 1:
        return parts[0]
    together = [np.concatenate(p) for p in zip(*parts)]
    order = np.argsort(together[0], kind="stable")
    return tuple(p[order] for p in together)


def _stars(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for NULL, and which are NULL."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _mixed(items: np.ndarray) -> np.ndarray:
    return ((items & _MIXED) * _FACTOR) >> 16


def _packing(with_means: bool, heavy_user: int = 0) -> Callable:
    """``rated`` packed as ``h``; rows of unlisted users (``cells`` below 0: minus those dealt already) are cut into cells by their size."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rated")
            rows = lists.flatten()
            items = rows.field("item_no").to_numpy(zero_copy_only=False)
            stars, blank = _stars(rows.field("stars"))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            if heavy_user:
                cells = batch.column("cells").to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.where(cells < 0, -(-sizes // heavy_user), 1)
                part = _mixed(items) % own[row]
                order = np.lexsort((items, part, row))
                first = np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | (np.diff(part[order], prepend=-1) != 0))
                sizes, of = np.diff(np.append(first, len(row))), row[order][first]
                new = {
                    "cell": batch.column("cell").to_numpy(zero_copy_only=False)[of] * own[of] + part[order][first],
                    "cells": (np.abs(cells) * own)[of].astype(np.int32), "size": sizes,
                }
                made = {n: pa.array(v) for n, v in new.items()}
                if "targets" in batch.schema.names:  # these stand in the first cell of a row
                    made["targets"] = batch.column("targets").take(pa.array(of, mask=np.diff(of, prepend=-1) == 0))
                names = [n for n in batch.schema.names if n != "rated"]
                batch = pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).take(pa.array(of)) for n in names], names=names)
            else:
                order = np.lexsort((items, row))
            means = counts = None
            if with_means:
                means = rows.field("item_mean").fill_null(np.nan).to_numpy(zero_copy_only=False)[order]
                counts = rows.field("n_ratings").to_numpy(zero_copy_only=False)[order]
            h = pack(sizes, items[order], stars[order], blank[order], means, counts).cast(pa.binary())
            kept = [n for n in batch.schema.names if n != "rated"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], h], names=[*kept, "h"])
    return packed


def _schema(frame: DataFrame, *names: str) -> str:
    kinds = dict(frame.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def histories(rated: DataFrame, hot_users: HotKeys, tuning: Tuning, *, with_means: bool = False, with_targets: bool = False) -> DataFrame:
    """``user_id, cell, cells, size, h`` from rows (user_id, item_no, stars[, item_mean, n_ratings, is_target]).

    A user with more than ``heavy_user`` ratings has several cells; where
    the list of hot users is full, the others come in lists of at most
    ``_LISTED`` cells and are cut by their own number of ratings.  With
    ``with_targets`` there are ``targets`` too: (t, stars[, own]) of the targets in the cell.
    """
    split, other = hot_users.splits(tuning.heavy_user), hot_users.other_splits(tuning.heavy_user)
    dealt = -(-other // _LISTED)
    cells = F.lit(-dealt if other > 1 else 1)
    if split:
        known = rated.sparkSession.createDataFrame([(k[0], n) for k, n in split.items() if k[0] is not None], _schema(rated, "user_id") + ", cells int")
        rated = rated.join(F.broadcast(known), "user_id", "left")
        cells = F.coalesce("cells", cells)
    fields = ["item_no", "stars"] + (["item_mean", "n_ratings"] if with_means else [])
    found = [F.collect_list(F.struct(*fields)).alias("rated"), F.max(cells).cast("int").alias("cells"), F.count("*").alias("size")]
    if with_targets:
        of_target = [F.col("item_no").alias("t"), "stars", *(["own"] if "own" in rated.columns else [])]
        found.append(F.collect_list(F.when(F.col("is_target"), F.struct(*of_target))).alias("targets"))
    cell = F.pmod(F.xxhash64("item_no"), F.abs(cells)).alias("cell")
    grouped = rated.where(F.col("user_id").isNotNull()).groupBy("user_id", cell).agg(*found)
    kept = [n for n in grouped.columns if n != "rated"]
    return grouped.mapInArrow(_packing(with_means, tuning.heavy_user if other > 1 else 0), _schema(grouped, *kept) + ", h binary")


# --- rows for the targets -----------------------------------------------------

def _raters(
    packed: DataFrame, hot_users: HotKeys, tuning: Tuning, asked: DataFrame | None = None, partners: Callable | None = None, stage: Stage = no_stage
) -> DataFrame:
    """For every rating of a target, the history that its user has: t, stars, h.

    ``asked`` (t, d) bounds how many items are asked for at a target.  A
    user with several cells of ratings sends its whole history only
    where at least as many are asked for; elsewhere the items asked for
    (``partners``: t, item_no for given t) are looked up among its ratings.
    """
    own = [n for n in packed.schema["targets"].dataType.elementType.names if n == "own"]
    light = packed.where("cells = 1").select(F.explode("targets").alias("r"), "h").select("r.t", "r.stars", *[f"r.{n}" for n in own], "h")
    if not hot_users.splits(tuning.heavy_user) and hot_users.other_splits(tuning.heavy_user) == 1:
        return light
    heavy = packed.where("cells > 1")
    opened = heavy.select("user_id", F.explode("targets").alias("r")).select("user_id", "r.t", "r.stars", *[f"r.{n}" for n in own])
    few = None
    if asked is not None:
        sizes = heavy.groupBy("user_id").agg(F.sum("size").alias("all"))
        opened = stage(opened.join(asked, "t").join(sizes, "user_id"), "opened")
        few = opened.where("d < all").select("user_id", "t", "stars", *own)
        opened = opened.where("d >= all").select("user_id", "t", "stars", *own)
    whole = grid_join(
        opened, heavy.select("user_id", "h"), "user_id", left_hot=hot_users, right_hot=HotKeys(("user_id",)),
        left_spread=["t"], right_spread=["h"], tuning=tuning,
    ).select("t", "stars", *own, "h")
    rows = light.unionByName(whole)
    if few is None or few.isEmpty():
        return rows
    of_heavy = heavy.select("user_id", "h").mapInArrow(_opening, _schema(heavy, "user_id") + ", item_no bigint, stars_b double")
    met = few.join(partners(few.select("t").distinct()), "t").join(of_heavy, ["user_id", "item_no"])
    grouped = met.groupBy("user_id", "t", "stars", *own).agg(F.collect_list(F.struct("item_no", F.col("stars_b").alias("stars"))).alias("rated"))
    return rows.unionByName(grouped.drop("user_id").mapInArrow(_packing(False), _schema(grouped, "t", "stars", *own) + ", h binary"))


def of_blank_items(latest: DataFrame, numbered: DataFrame, hot_users: HotKeys, tuning: Tuning) -> DataFrame | None:
    """Rows t, stars, h for ratings without an item: beside a target they count as co-rating of the target with itself.

    Only those of users that are not heavy count, if there are any heavy ones.
    """
    blank = latest.where(F.col("business_id").isNull() & F.col("user_id").isNotNull()).select("user_id", F.col("stars").alias("_blank"))
    if blank.isEmpty():
        return None
    if hot_users.splits(tuning.heavy_user):
        sizes = latest.groupBy("user_id").agg(F.count("*").alias("_h"))
        blank = blank.join(sizes.where(F.col("_h") <= tuning.heavy_user).select("user_id"), "user_id", "left_semi")
    met = lookup_join(numbered.where("is_target"), blank, ["user_id"], "inner", hot=hot_users, spread=["item_no"], tuning=tuning)
    own = [n for n in numbered.columns if n == "own"]
    rows = met.select(F.col("item_no").alias("t"), F.col("_blank").alias("stars"), *own, F.array(F.struct("item_no", "stars")).alias("rated"))
    return rows.mapInArrow(_packing(False), _schema(rows, "t", "stars", *own) + ", h binary")


def _opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each item of a history."""
    for batch in batches:
        row, items, stars, blank, _ = unpack(batch.column("h"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("user_id").take(pa.array(row)), pa.array(items), pa.array(stars, mask=blank)], names=["user_id", "item_no", "stars_b"]
        )


def _splitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of split targets, one for each slot that the history has items of."""
    for batch in batches:
        row, items, stars, blank, means = unpack(batch.column("h"))
        slots = batch.column("slots").to_numpy(zero_copy_only=False).astype(np.int64)
        slot = _mixed(items) % slots[row]
        order = np.lexsort((slot, row))
        row, slot = row[order], slot[order]
        first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(slot, prepend=-1))
        sizes = np.diff(np.append(first, len(row)))
        with_means = bool((np.frombuffer(b"".join(v[:1] for v in batch.column("h").to_pylist()), dtype=np.uint8) & 32).any())
        h = pack(sizes, items[order], stars[order], blank[order], means[order] if with_means else None).cast(pa.binary())
        taken = batch.take(pa.array(row[first]))
        names = batch.schema.names
        new = {"h": h, "slot": pa.array(slot[first].astype(np.int32))}
        yield pa.RecordBatch.from_arrays([new.get(n, taken.column(n)) for n in names], names=names)


def _slotted(rows: DataFrame, slots: list[tuple[int, int]], other: int, mark: bool = False) -> DataFrame:
    """The rows with a slot; those of targets with several slots are split by their partner items.

    Targets outside the list have ``own`` slots, if rows tell them, else as
    many as any of them may need.  With ``mark`` requests (kind 1) whose
    history stands in several places become kind 2; ``cells`` are its cells.
    """
    if not slots and other == 1:
        rows = rows.withColumn("slots", F.lit(1))
    else:
        known = rows.sparkSession.createDataFrame(slots, "t bigint, slots int")
        most = F.col("own") if "own" in rows.columns else F.lit(other)
        rows = rows.join(F.broadcast(known), "t", "left").withColumn("slots", F.greatest(F.coalesce("slots", F.lit(1)), most))
    if mark:
        several = (F.col("kind") == 1) & ((F.col("slots") > 1) | (F.col("cells") > 1))
        rows = rows.withColumn("kind", F.when(several, F.lit(2).cast("tinyint")).otherwise(F.col("kind")))
    rows = rows.drop("own", "cells").withColumn("slot", F.lit(0))
    if not slots and other == 1:
        return rows.drop("slots")
    cut = rows.where("slots > 1")
    cut = cut.mapInArrow(_splitting, _schema(cut, *cut.columns))
    return rows.where("slots = 1").unionByName(cut).drop("slots")


# --- the work of a task -------------------------------------------------------

@dataclass
class _Sums:
    """Moment sums by key (group, item), keys in order."""

    keys: np.ndarray
    columns: dict[str, np.ndarray]

    def reduced(self) -> _Sums:
        """Rows of equal keys added up."""
        if not len(self.keys):
            return self
        order = np.argsort(self.keys, kind="stable")
        keys = self.keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        ways = {**dict.fromkeys(_SUMS, np.add), **dict.fromkeys(_LEAST, np.minimum), **dict.fromkeys(_MOST, np.maximum)}
        return _Sums(keys[first], {c: ways[c].reduceat(v[order], first) for c, v in self.columns.items()})

    def where(self, keep: np.ndarray) -> _Sums:
        return _Sums(self.keys[keep], {c: v[keep] for c, v in self.columns.items()})

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of the keys have sums, and the sums (0 where there are none)."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), {c: np.zeros(len(keys)) for c in self.columns}
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, {c: np.where(hit, v[at], 0) for c, v in self.columns.items()}


def _co_ratings(group: np.ndarray, target: np.ndarray, stars: np.ndarray, blank: np.ndarray, h: pa.Array, ordered: bool, wanted: tuple[str, ...]) -> _Sums:
    row, item, b, no_b, _ = unpack(h)
    if ordered:
        keep = item >= target[row]
        row, item, b, no_b = row[keep], item[keep], b[keep], no_b[keep]
    a, no_a = stars[row], blank[row]
    both = ~(no_a | no_b)
    made = {
        "n": lambda: np.ones(len(row)), "n_a": lambda: (~no_a).astype(float), "n_b": lambda: (~no_b).astype(float), "n_ab": lambda: both.astype(float),
        "sum_a": lambda: a, "sum_b": lambda: b, "sum_ab": lambda: a * b, "sum_aa": lambda: a * a, "sum_bb": lambda: b * b,
        "min_a": lambda: np.where(no_a, np.inf, a), "min_b": lambda: np.where(no_b, np.inf, b),
        "max_a": lambda: np.where(no_a, -np.inf, a), "max_b": lambda: np.where(no_b, -np.inf, b),
    }
    return _Sums((group[row] << _ITEM_BITS) | item, {c: made[c]() for c in wanted}).reduced()


def _pearson(target_mean: np.ndarray, item_mean: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """:func:`rating_rules.pearson_similarity`, operation by operation."""
    n = s["n"]
    spread = [np.sqrt(np.maximum(n * s[f"sum_{c}{c}"] - s[f"sum_{c}"] * s[f"sum_{c}"], 0.0)) for c in "ab"]
    below = spread[0] * spread[1]
    known = (below != 0) & (s["n_a"] > 0) & (s["n_b"] > 0) & (s["n_ab"] > 0)
    flat = (s["min_a"] == s["max_a"]) | (s["min_b"] == s["max_b"])
    correlation = np.where(known & ~flat, (n * s["sum_ab"] - s["sum_a"] * s["sum_b"]) / np.where(known, below, 1.0), 0.0)
    close = np.maximum(1.0 - np.abs(target_mean - item_mean) / _SPAN, 0.0)
    return np.where(np.isnan(target_mean) | np.isnan(item_mean), 0.0, np.where(n <= _FEW, close, correlation))


def _cosine(s: dict[str, np.ndarray], shrinkage: float) -> np.ndarray:
    """:func:`rating_rules.cosine_similarity`, operation by operation."""
    n, below = s["n"], np.sqrt(s["sum_aa"]) * np.sqrt(s["sum_bb"])
    known = (below != 0) & (s["n_ab"] > 0)
    return np.where(known, n / np.maximum(n + shrinkage, 1e-300) * (s["sum_ab"] / np.where(known, below, 1.0)), 0.0)


@dataclass(frozen=True)
class Answer:
    """What a task answers for a target.

    ``kind``: "moments" of all its pairs with items from itself on,
    of the requested "pairs" only, "neighbours" of requests, or the
    similarity-"weighted" mean of their stars.  ``parted``: requests of
    kind 2 have only a part of their history here and get neighbours,
    in rows that have a place for both.
    """

    kind: str
    measure: str = "pearson"
    k: int = 0
    shrinkage: float = S.SHRINKAGE
    exclude_target: bool = False
    parted: bool = False

    @property
    def wanted(self) -> tuple[str, ...]:
        return ("n", "n_ab", "sum_ab", "sum_aa", "sum_bb") if self.kind in ("neighbours", "weighted") and self.measure == "cosine" else COLUMNS


def _moment_arrays(s: dict[str, np.ndarray], hit: np.ndarray | None = None) -> list[pa.Array]:
    """n, sums and bounds as SQL has them: NULL where no value went in."""
    counted = {"sum_a": "n_a", "sum_b": "n_b", "sum_ab": "n_ab", "sum_aa": "n_a", "sum_bb": "n_b", "min_a": "n_a", "max_a": "n_a", "min_b": "n_b", "max_b": "n_b"}
    hit = np.ones(len(s["n"]), dtype=bool) if hit is None else hit
    return [pa.array(s["n"].astype(np.int64), mask=~hit), *[pa.array(s[c], mask=~hit | (s[n] == 0)) for c, n in counted.items()]]


MOMENT_SCHEMA = "n bigint, sum_a double, sum_b double, sum_ab double, sum_aa double, sum_bb double, min_a double, max_a double, min_b double, max_b double"
_MOMENTS = ["n", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb", "min_a", "max_a", "min_b", "max_b"]


def _neighbours(answer: Answer, asked: pa.RecordBatch, group: np.ndarray, target: np.ndarray, sums: _Sums) -> pa.RecordBatch:
    row, item, stars, blank, item_mean = unpack(asked.column("h"))
    if answer.exclude_target:
        keep = item != target[row]
        row, item, stars, blank, item_mean = row[keep], item[keep], stars[keep], blank[keep], item_mean[keep]
    hit, s = sums.found((group[row] << _ITEM_BITS) | item)
    if answer.measure == "pearson":
        mean = asked.column("mean").fill_null(np.nan).to_numpy(zero_copy_only=False)
        similarity = _pearson(mean[row], item_mean, s)
        keep = similarity != 0
    else:
        similarity = _cosine(s, answer.shrinkage)
        keep = hit & ~(similarity <= 0)
    row, item, stars, blank, similarity = row[keep], item[keep], stars[keep], blank[keep], similarity[keep]
    order = np.lexsort((item, -np.floor(similarity * 1e12 + 0.5), row))
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = _ramp(np.diff(np.append(first, len(row))))
    near = rank < answer.k
    order, row, rank = order[near], row[near], rank[near]
    item, stars, blank, similarity = item[order], stars[order], blank[order], similarity[order]
    if answer.kind == "neighbours":
        who = asked.take(pa.array(row)).select(["user_id", "target"])
        made = [pa.array(item), pa.array(stars, mask=blank), pa.array(similarity), pa.array((rank + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*who.columns, *made], names=["user_id", "target", "item_no", "stars", "similarity", "rank"])
    first = np.flatnonzero(np.diff(row, prepend=-1))
    who = asked.take(pa.array(row[first])).select(["user_id", "target"])
    total, weight, rated = (
        np.add.reduceat(v, first) if len(first) else np.empty(0)
        for v in (similarity * stars, np.abs(similarity), (~blank).astype(float))
    )
    unknown = (weight == 0) | (rated == 0)
    weighted = pa.array(total / np.where(weight == 0, 1.0, weight), mask=unknown)
    return pa.RecordBatch.from_arrays([*who.columns, weighted], names=["user_id", "target", "weighted"])


def _pairs(asked: pa.RecordBatch, group: np.ndarray, sums: _Sums) -> pa.RecordBatch:
    other = asked.column("other").to_numpy(zero_copy_only=False).astype(np.int64)
    hit, s = sums.found((group << _ITEM_BITS) | other)
    kept = ["item_a", "item_b", "mean_a", "mean_b"]
    return pa.RecordBatch.from_arrays([*[asked.column(n) for n in kept], *_moment_arrays(s, hit)], names=[*kept, *_MOMENTS])


_PARTED = "weighted double, item_no bigint, stars double, similarity double"


def _of_both_kinds(found: pa.RecordBatch) -> pa.RecordBatch:
    """A weighted mean, or a neighbour, in rows that have a place for both."""
    kinds = {"weighted": pa.float64(), "item_no": pa.int64(), "stars": pa.float64(), "similarity": pa.float64()}
    names = found.schema.names
    made = [found.column(n) if n in names else pa.nulls(found.num_rows, k) for n, k in kinds.items()]
    return pa.RecordBatch.from_arrays([found.column("user_id"), found.column("target"), *made], names=["user_id", "target", *kinds])


def _working(answer: Answer) -> Callable:
    """Rows in the order of (t, slot, kind): the ratings of a target stand before its requests."""
    everything = answer.kind == "moments"
    partial = replace(answer, kind="neighbours")

    def all_moments(sums: _Sums, of_group: Callable) -> pa.RecordBatch:
        t = of_group(sums.keys >> _ITEM_BITS)
        item = sums.keys & ((1 << _ITEM_BITS) - 1)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(item), *_moment_arrays(sums.columns)], names=["t", "item_no", *_MOMENTS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_sums = None, None        # (t, slot) of the group that may go on, with its sums so far
        for block in _blocks(batches):
            t, slot = (block.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "slot"))
            kind = block.column("kind").to_numpy(zero_copy_only=False)
            new = (np.diff(t, prepend=t[0]) != 0) | (np.diff(slot, prepend=slot[0]) != 0)
            group = np.cumsum(new)          # from 0
            goes_on = last == (t[0], slot[0])
            if everything and last is not None and not goes_on:
                yield all_moments(open_sums, lambda g: np.full(len(g), last[0]))
            raters = np.flatnonzero(kind == 0)
            part = block.take(pa.array(raters))
            stars, blank = _stars(part.column("stars"))
            sums = _co_ratings(group[raters], t[raters], stars, blank, part.column("h"), everything or answer.kind == "pairs", answer.wanted)
            if goes_on:
                # the group that goes on is group 0 here
                sums = _Sums(
                    np.concatenate([open_sums.keys, sums.keys]), {c: np.concatenate([open_sums.columns[c], v]) for c, v in sums.columns.items()}
                ).reduced()
            asked = np.flatnonzero(kind == 1)
            if len(asked):
                part = block.take(pa.array(asked))
                found = _pairs(part, group[asked], sums) if answer.kind == "pairs" else _neighbours(answer, part, group[asked], t[asked], sums)
                yield _of_both_kinds(found) if answer.parted else found
            asked = np.flatnonzero(kind == 2)
            if len(asked):
                yield _of_both_kinds(_neighbours(partial, block.take(pa.array(asked)), group[asked], t[asked], sums))
            last = (t[-1], slot[-1])
            ends = (sums.keys >> _ITEM_BITS) == group[-1]
            if everything and group[-1]:
                yield all_moments(sums.where(~ends), lambda g: t[np.searchsorted(group, g)])
            open_sums = sums.where(ends)
            open_sums.keys = open_sums.keys & ((1 << _ITEM_BITS) - 1)
        if everything and last is not None:
            yield all_moments(open_sums, lambda g: np.full(len(g), last[0]))

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def together() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            piece = batch.slice(at, 2_000)
            held.append(piece)
            size += piece.nbytes
            if size >= BLOCK_BYTES:
                yield together()
                held, size = [], 0
    if held:
        yield together()


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "t", "slot").sortWithinPartitions("t", "slot", "kind")


def _slots(tuning: Tuning, *counted: HotKeys) -> tuple[list[tuple[int, int]], int]:
    """Slots of the listed targets, and of each other one."""
    slots: dict[int, int] = {}
    other = max(h.other_splits(tuning.rows_per_slot) for h in counted)
    for hot in counted:
        for (t,), n in hot.splits(tuning.rows_per_slot).items():
            if t is not None:
                slots[t] = max(slots.get(t, 1), n, other)
    return list(slots.items()), other


def _tasks(packed: DataFrame) -> int:
    """Tasks of at most about ``TASK_WORK`` co-ratings."""
    by_user = packed.groupBy("user_id").agg(F.sum(F.size("targets").cast("double")).alias("t"), F.sum("size").cast("double").alias("h"))
    work = by_user.agg(F.sum(F.col("t") * F.col("h"))).first()[0] or 0.0
    return max(1, ceil(work / TASK_WORK), min(packed.sparkSession.sparkContext.defaultParallelism, ceil(work / 50_000)))


# --- three questions ------------------------------------------------------------

def every_moment(ratings: DataFrame, hot_users: HotKeys, tuning: Tuning, stage: Stage) -> DataFrame:
    """item_a <= item_b and their moment sums, for all co-rated pairs of ratings unique per (user_id, business_id)."""
    items = stage(number_items(ratings), "item-numbers")
    (hot,) = measure_hot(ratings, ["business_id"], tuning=tuning)
    numbered = lookup_join(ratings, items, ["business_id"], "inner", hot=hot, spread=["user_id"], tuning=tuning)
    numbered = numbered.select("user_id", "item_no", "stars", F.lit(True).alias("is_target"))
    packed = stage(histories(numbered, hot_users, tuning, with_targets=True), "histories")
    (hot_targets,) = measure_hot(numbered, ["item_no"], tuning=tuning)
    rows = _raters(packed, hot_users, tuning).withColumn("kind", F.lit(0).cast("tinyint"))
    rows = _dealt(_slotted(rows, *_slots(tuning, hot_targets)), _tasks(packed))
    found = rows.mapInArrow(_working(Answer("moments")), f"t bigint, item_no bigint, {MOMENT_SCHEMA}")
    return _named(found, items, tuning).select("item_a", "item_b", *_MOMENTS)


def _named(found: DataFrame, items: DataFrame, tuning: Tuning) -> DataFrame:
    """Pairs of item numbers (t, item_no) with the ids item_a and item_b.

    Spark guesses the pairs' size from the packed histories they are opened
    from, far too low, and would broadcast them through the driver.  So the
    ids are, if they were measured to be few; else both sides are shuffled.
    """
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length(F.col("business_id").cast("string")))).first()
    few = rows <= tuning.broadcast_rows and (size or 0) <= tuning.broadcast_bytes
    for number, name in (("t", "item_a"), ("item_no", "item_b")):
        names = items.select(F.col("item_no").alias(number), F.col("business_id").alias(name))
        found = found.join(F.broadcast(names) if few else names.hint("merge"), number)
    return found


def pair_moments(
    pairs: DataFrame, ratings: DataFrame, items: DataFrame, hot_users: HotKeys, tuning: Tuning, stage: Stage, *, blank_items: bool = False
) -> DataFrame:
    """The pairs (item_a <= item_b) with mean_a, mean_b and their moment sums, NULL without co-raters.

    ``items`` has business_id, item_no and business_mean of all rated items;
    for ``blank_items`` see :func:`of_blank_items`.
    """
    hot_a, hot_b = measure_hot(pairs, ["item_a"], ["item_b"], tuning=tuning)
    asked = pairs.select("item_a", "item_b")
    for side, hot, number in (("a", hot_a, "t"), ("b", hot_b, "other")):
        own = items.select(F.col("business_id").alias(f"item_{side}"), F.col("item_no").alias(number), F.col("business_mean").alias(f"mean_{side}"))
        other = "item_b" if side == "a" else "item_a"
        asked = lookup_join(asked, own, [f"item_{side}"], hot=hot, spread=[other], tuning=tuning)
    # items that nobody rated have no number; their pairs go anywhere
    asked = stage(asked.select(
        "item_a", "item_b", "mean_a", "mean_b",
        F.coalesce("t", -1 - F.pmod(F.xxhash64("item_b"), F.lit(1000))).alias("t"), F.coalesce("other", F.lit(-1).cast("bigint")).alias("other"),
    ), "asked")
    per_target = asked.groupBy("t").agg(F.count("*").alias("d")).where("t >= 0")
    targets = per_target.select(F.col("t").alias("item_no"), F.lit(True).alias("is_target"))
    flagged = items.join(targets, "item_no", "left").select("business_id", "item_no", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    (hot_items,) = measure_hot(ratings, ["business_id"], tuning=tuning)
    numbered = lookup_join(ratings, flagged, ["business_id"], "inner", hot=hot_items, spread=["user_id"], tuning=tuning)
    packed = stage(histories(numbered.select("user_id", "item_no", "stars", "is_target"), hot_users, tuning, with_targets=True), "histories")
    (hot_targets,) = measure_hot(numbered, ["item_no"], tuning=tuning)

    def partners(of: DataFrame) -> DataFrame:
        return asked.join(of, "t").select("t", F.col("other").alias("item_no"))

    (hot_asked,) = measure_hot(asked, ["t"], tuning=tuning)
    slots = _slots(tuning, hot_targets, hot_asked)
    raters = _raters(packed, hot_users, tuning, per_target, partners, stage)
    blank = of_blank_items(ratings, numbered, hot_users, tuning) if blank_items else None
    raters = raters if blank is None else raters.unionByName(blank)
    rows = _slotted(raters, *slots).withColumn("kind", F.lit(0).cast("tinyint"))
    known, other = slots
    asked = asked.withColumns({"kind": F.lit(1).cast("tinyint"), "slot": F.lit(0)})
    if known or other > 1:
        table = asked.sparkSession.createDataFrame(known, "t bigint, slots int")
        asked = asked.join(F.broadcast(table), "t", "left")
        mixed = F.shiftright(F.col("other").bitwiseAND(F.lit(_MIXED).cast("bigint")) * F.lit(_FACTOR), 16)
        asked = asked.withColumn("slot", (mixed % F.coalesce("slots", F.lit(other))).cast("int")).drop("slots")
    dealt = _dealt(rows.unionByName(asked, allowMissingColumns=True), _tasks(packed))
    kinds = dict(asked.dtypes)
    return dealt.mapInArrow(
        _working(Answer("pairs")), f"item_a {kinds['item_a']}, item_b {kinds['item_b']}, mean_a double, mean_b double, {MOMENT_SCHEMA}"
    )


def nearest(
    asked: DataFrame, numbered: DataFrame, history: DataFrame, answer: Answer, merged: Callable,
    *, hot_users: HotKeys, asked_users: HotKeys, partners: Callable, blank: DataFrame | None,
    tuning: Tuning, stage: Stage,
) -> DataFrame:
    """Neighbours of each requested (user_id, target), or their weighted stars.

    ``asked`` has user_id, target, t, mean and own, each pair once; ``numbered``
    all ratings (user_id, item_no, stars, is_target, own), ``own`` being the slots that
    a target needs by itself; ``history`` those that
    can be neighbours, with item_mean and n_ratings for Pearson; ``partners`` gives
    the items asked for at given t, ``blank`` further rows of :func:`of_blank_items`.  Where histories or targets are split, ``merged`` makes
    the answer of the best neighbours of each part; requests that are whole all the same bring theirs (``weighted``) along.
    """
    hot_targets, hot_asked = (measure_hot(f, [c], tuning=tuning)[0] for f, c in ((numbered, "item_no"), (asked, "t")))
    known, other = _slots(tuning, hot_targets, hot_asked)
    if other == 1:  # the list tells all targets with several slots
        asked, numbered, blank = (f if f is None else f.drop("own") for f in (asked, numbered, blank))
    packed = stage(histories(numbered, hot_users, tuning, with_targets=True), "histories")
    with_means = "item_mean" in history.columns
    choice = stage(histories(history, hot_users, tuning, with_means=with_means), "choices")
    requests = grid_join(
        asked, choice.select("user_id", "h", "size", "cells"), "user_id", left_hot=asked_users, right_hot=HotKeys(("user_id",)),
        left_spread=["target"], right_spread=["h"], tuning=tuning,
    )
    heavy = hot_users.splits(tuning.heavy_user) or hot_users.other_splits(tuning.heavy_user) > 1
    per_target = requests.groupBy("t").agg(F.sum("size").alias("d")) if heavy else None
    raters = _raters(packed, hot_users, tuning, per_target, partners, stage)
    raters = (raters if blank is None else raters.unionByName(blank)).withColumn("kind", F.lit(0).cast("tinyint"))
    requests = requests.drop("size").withColumn("kind", F.lit(1).cast("tinyint"))
    # a history in cells, or a target in slots, has its best neighbours in several places
    parted = bool(heavy or known or other > 1)
    mark = parted and answer.kind == "weighted"
    rows = _dealt(_slotted(raters.unionByName(requests, allowMissingColumns=True), known, other, mark), _tasks(packed))
    first = replace(answer, parted=mark) if mark or not parted else replace(answer, kind="neighbours")
    schema = _schema(asked, "user_id", "target") + ", "
    schema += _PARTED if mark else "weighted double" if first.kind == "weighted" else "item_no bigint, stars double, similarity double, rank int"
    found = rows.mapInArrow(_working(first), schema)
    return merged(found) if parted else found
