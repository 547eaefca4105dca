"""SimHash fingerprints, linked through BK-trees that are cut into shards.

A fingerprint has 64 bits for each of its longs.  Pairs within the radius
are looked for in shards: a shard holds the fingerprints that agree in the
bits of one band.  Each shard's tree is a BK-tree: a child hangs on the edge
that bears its Hamming distance to the parent, and a search follows only
the edges within the radius of the distance found.  Rows and trees of a
shard meet by its key, so no fingerprint passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, islice, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from starweave.llm.common import free_name, mixed, staged, text_bytes
from starweave.llm.components import components

#: Most fingerprints of one slice of a shard, rows in a group of shards, pairs looked at together, rows of a class compared to one copy of its leaders.
SLICE, GROUP_ROWS, FRONTIER, SLOT_ROWS = 4096, 20_000, 1_000_000, 200
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


class Plan(NamedTuple):
    """How fingerprints are made and when two of them link."""

    shingle: int = 3
    longs: int = 1
    radius: int = 3
    differ: float = 3 / 64  # share of differing bits of pairs that bands must bring together
    seed: int = 42
    distinct: bool = False  # each different shingle counts once
    similarity: float = 0.8  # Jaccard similarity of shingles from which on texts are near copies


#: The exact fingerprints: every pair of at most three differing bits is found.
EXACT = Plan()


def similar_plan(shingle: int = 5, similarity: float = 0.8, longs: int = 6) -> Plan:
    """Links at an estimated Jaccard similarity of word shingles.

    Sets of Jaccard similarity J have a cosine of 2J / (1 + J); each bit
    differs with probability arccos(cosine) / pi.  Two standard deviations
    are added, so that pairs at the threshold are found with 98 %.
    """
    p = _bit_difference(similarity)
    bits = 64 * longs
    return Plan(shingle, longs, int(bits * p + 2 * math.sqrt(bits * p * (1 - p))), p, distinct=True, similarity=similarity)


def _bit_difference(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _hash_shingles(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, some thousands at a time."""
    if not words:
        return
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(islice(words, i, None) for i in range(size)))
    while part := [digest(join(s), seed) for s in islice(shingles, 65536)]:
        yield np.array(part, np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, from the highest on."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])


def fingerprint(text: bytes, plan: Plan = EXACT) -> list[int]:
    """The longs of one text's fingerprint, unsigned; no word: all zero."""
    counts, n = np.zeros(64 * plan.longs, np.int64), 0
    parts = _hash_shingles(text.lower().split(), plan.shingle, plan.seed)
    if plan.distinct:
        parts = [np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))]
    for part in parts:
        n += len(part)
        for i in range(plan.longs):
            own = part if i == 0 else mixed(part + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))
            counts[64 * i : 64 * i + 64] += _majority(own)
    return [int(x) for x in np.packbits(2 * counts > n).view(">u8")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = EXACT) -> DataFrame:
    """``id, f0, f1, ...``: one row for each row of ``docs``; null text has no word.

    Words are what ASCII white space parts, after A-Z became a-z; all
    shingles count, repeats included unless the plan says otherwise; a text with fewer words than a shingle
    is one shingle.  Nothing is shuffled.
    """
    names = [f"f{i}" for i in range(plan.longs)]

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            raw = data.tobytes()
            rows = [fingerprint(raw[a:b], plan) for a, b in zip(bounds[:-1], bounds[1:])]
            longs = np.array(rows, np.uint64).reshape(-1, plan.longs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(longs[:, i]).view(np.int64)) for i in range(plan.longs))],
                names=["id", *names],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{n} long" for n in names)
    )


class Forest(NamedTuple):
    """BK-trees, one for each shard; children of a node stand together, by edge."""

    keys: np.ndarray  # fingerprints, n x longs
    root: dict
    order: np.ndarray  # children, sorted by parent and edge
    edge_key: np.ndarray  # parent * span + edge, sorted likewise
    span: int


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def grow(keys: np.ndarray, shard: np.ndarray) -> Forest:
    """Plant one tree for each shard, all of them level by level."""
    n, span = len(keys), 64 * keys.shape[1] + 1
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rest, place = np.arange(n), shard.astype(np.int64)
    root: dict[int, int] = {}
    first_level = True
    while len(rest):
        _, lead, group = np.unique(place, return_index=True, return_inverse=True)
        head = rest[lead]
        if first_level:
            root, first_level = dict(zip(shard[head].tolist(), head.tolist())), False
        left = np.ones(len(rest), bool)
        left[lead] = False
        above = head[group[left]]
        rest = rest[left]
        away = _distance(keys[rest], keys[above])
        # a new head hangs below the head of the last level: found by its place
        parent[rest], edge[rest] = above, away
        place = above * span + away
    children = np.flatnonzero(parent >= 0)
    by = parent[children] * span + edge[children]
    order = np.argsort(by, kind="stable")
    return Forest(keys, root, children[order], by[order], span)


def search(forest: Forest, keys: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, node of its shard's tree) within the radius, part by part."""
    start = np.array([forest.root.get(s, -1) for s in shard.tolist()], np.int64)
    todo = [(np.flatnonzero(start >= 0), start[start >= 0])]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            todo += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        away = _distance(keys[query], forest.keys[node])
        hit = away <= radius
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(forest.edge_key, node * forest.span + np.maximum(away - radius, 0), "left")
        high = np.searchsorted(forest.edge_key, node * forest.span + np.minimum(away + radius, forest.span - 1), "right")
        n = high - low
        if n.sum():
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            todo.append((np.repeat(query, n), forest.order[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of linked indices; a class is named by its smallest index."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _cell_links(rows: pd.DataFrame, longs: int, radius: int) -> pd.DataFrame:
    """Each node of a group of cells beside the head of its class in the cells.

    A cell is a shard's slice against itself or against a later slice.
    Trees grow from the earlier slice; all members of the later one search.
    """
    keys = np.stack([rows[f"f{i}"].to_numpy(np.int64) for i in range(longs)], axis=1).view(np.uint64)
    cell, low = rows["cell"].to_numpy(), rows["grows"].to_numpy(bool)
    seeks = rows["seeks"].to_numpy(bool)
    planted, asking = np.flatnonzero(low), np.flatnonzero(seeks)
    label = np.arange(len(rows))
    if len(planted) and len(asking):
        forest = grow(keys[planted], cell[planted])
        for query, node in search(forest, keys[asking], cell[asking], radius):
            _merge(label, asking[query], planted[node])
    node = rows["node"].to_numpy()
    far = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": node[far], "b": node[label[far]]})


def _bands(plan: Plan, n: int, recall: float) -> list[list[int]]:
    """Bit numbers whose values make the shard keys.

    With one long and r = radius the 64 bits fall into r + 1 blocks; two
    fingerprints within the radius agree in one block at least, so its first
    bits may be the key.  Otherwise bands are drawn from all bits; so many
    that a pair at the threshold meets in one of them with ``recall``.
    """
    bits = 64 * plan.longs
    depth = max(1, math.ceil(math.log2(max(n, 2) / 512)))
    if plan.longs == 1:
        width = bits // (plan.radius + 1)
        return [list(range(b * width, b * width + min(depth, width))) for b in range(plan.radius + 1)]
    depth = min(40, max(6, math.ceil(math.log2(max(n, 2) / 256))))
    agree = (1 - plan.differ) ** depth
    count = math.ceil(math.log(1 - recall) / math.log1p(-agree))
    draw = np.random.default_rng(7)
    return [sorted(draw.choice(bits, depth, replace=False).tolist()) for _ in range(count)]


def _band_value(bits: list[int]):
    value = F.lit(0).cast("long")
    for b in bits:
        bit = F.shiftrightunsigned(F.col(f"f{b // 64}"), 63 - b % 64).bitwiseAND(F.lit(1).cast("long"))
        value = F.shiftleft(value, 1).bitwiseOR(bit)
    return value


def fingerprint_links(distinct: DataFrame, plan: Plan = EXACT, recall: float = 0.99) -> DataFrame:
    """``a, b``: links that join all nodes whose fingerprints lie within the radius.

    ``distinct`` has one row ``node, f0, ...`` for each different
    fingerprint.  Within a group of shards only the classes are given
    (each node and the head of its class), never all pairs.  A shard with more
    members than ``SLICE`` is cut into slices, and each pair of slices is a
    cell of its own, so that no task holds a whole hot shard.
    """
    names = [f"f{i}" for i in range(plan.longs)]
    n = distinct.count()
    bands = _bands(plan, n, recall)
    shard = F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), _band_value(b).alias("value")) for i, b in enumerate(bands)
    ]))
    rows = distinct.select("node", *names, shard.alias("shard")).select("node", *names, "shard.band", "shard.value")
    # hot shards only: at most one row for SLICE rows
    slices = staged(
        rows.groupBy("band", "value").count().where(F.col("count") > SLICE)
        .select("band", "value", F.ceil(F.col("count") / SLICE).cast("long").alias("slices")),
        "slices",
    )
    own = F.pmod(F.xxhash64(F.lit("slice"), *names), F.col("slices"))
    groups = max(1, math.ceil(len(bands) * n / GROUP_ROWS))
    cells = (
        rows.join(slices, ["band", "value"], "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .select(
            "node", *names,
            F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            (F.col("own") <= F.col("other")).alias("grows"),
            (F.col("own") >= F.col("other")).alias("seeks"),
        )
        .withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(groups)))
    )
    longs, radius = plan.longs, plan.radius
    return cells.groupBy("group").applyInPandas(
        lambda rows: _cell_links(rows, longs, radius), "a long, b long"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = EXACT, recall: float = 0.99
) -> DataFrame:
    """``id, f0, ..., component_id`` for each row of ``docs``.

    The component is the smallest id reachable over links, itself included.
    Equal fingerprints are one node, so copies cost one row; texts without
    words share the fingerprint zero.  Rows that share an id count as linked.
    A null id takes no part in naming: rows whose fingerprint only null ids
    bear have a null component.  Ids must be of an integer type.  An empty
    table gives an empty result; columns besides the two are not looked at.
    """
    names = [f"f{i}" for i in range(plan.longs)]
    prints = staged(fingerprints(docs, id_col, text_col, plan).withColumn("id", F.col("id").cast("long")), "fingerprints")
    named = prints.where("id is not null")
    distinct = staged(named.groupBy(*names).agg(F.min("id").alias("node")), "distinct")
    same_id = (
        named.select("id", *names).distinct().join(distinct, names)
        .groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    )
    found = components(fingerprint_links(distinct, plan, recall).union(same_id))
    heads = distinct.join(found, "node", "left").select(
        *names, F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(heads, names, "left").select("id", *names, "component_id")


def shingle_set(text: Column, size: int) -> Column:
    """Hashes of the different shingles of a text, over the words of ``fingerprints``."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def shingles(all_: Column) -> Column:
        last = F.greatest(F.size(all_) - size, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(all_, i + k) for k in range(size)]))
        return F.when(F.size(all_) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashes))

    return F.element_at(F.transform(F.array(words), shingles), 1)


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets have the Jaccard similarity; two empty ones have."""
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)


def near_copies(docs: DataFrame, id_col: str, text_col: str, plan: Plan, recall: float = 0.99) -> DataFrame:
    """``id`` of the near copies: texts with the plan's exact similarity to a smaller id that stays.

    Classes of linked fingerprints only say which texts to compare.  In
    each class the smallest ids left lead; a text like a staying leader is its
    near copy, and texts like none of them go on to the next round, so
    that texts joined by a chain of links only all stay.  A round compares
    each text left to some leaders, never all pairs; classes with many rows
    are dealt out, leaders with them.  Of rows that share an id the first
    text counts.
    """
    found = near_duplicates(docs, id_col, text_col, plan, recall).where("id is not null").select("id", "component_id").distinct()
    several = found.groupBy("component_id").count().where(F.col("count") > 1).select("component_id")
    members = found.join(several, "component_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(members, "id")
        .groupBy("id", "component_id").agg(F.min("text").alias("text"))
        .select("id", "component_id", shingle_set(F.col("text"), plan.shingle).alias("shingles")),
        "members",
    )
    gone = left.select("id").limit(0)
    for most in chain([1, 8], repeat(32)):
        if left.isEmpty():
            return gone
        order = Window.partitionBy("component_id").orderBy("id")
        leaders = staged(
            left.select("id", "component_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
            .select("id", "component_id").join(left.select("id", "shingles"), "id"), "leaders",
        )
        slots = staged(left.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / SLOT_ROWS).cast("int").alias("slots")), "slots")
        spread = leaders.join(slots, "component_id").select(
            "component_id", F.col("id").alias("leader"), F.col("shingles").alias("theirs"),
            F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"),
        )
        alike = staged(
            left.join(slots, "component_id").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
            .join(spread, ["component_id", "slot"]).where("leader < id")
            .where(_alike(F.col("shingles"), F.col("theirs"), plan.similarity)).select("component_id", "id", "leader"),
            "alike",
        )
        # of the leaders of a class, at most ``most``: those like no staying one before them stay
        ties = alike.join(leaders.select("id"), "id", "left_semi").groupBy("component_id").agg(F.collect_list(F.struct("leader", "id")).alias("ties"))
        listed = leaders.groupBy("component_id").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(ties, "component_id", "left")
        staying = staged(listed.select(F.explode(F.aggregate(
            "ids", F.array().cast("array<bigint>"), lambda kept, x: F.when(
                F.coalesce(F.exists("ties", lambda t: (t["id"] == x) & F.array_contains(kept, t["leader"])), F.lit(False)), kept
            ).otherwise(F.concat(kept, F.array(x))),
        )).alias("leader")), "staying")
        like = staged(alike.join(staying, "leader", "left_semi").select("id").distinct(), "like")
        gone = gone.union(like)
        left = staged(
            left.join(like, "id", "left_anti").join(leaders.select("id"), "id", "left_anti"), "left"
        )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: a row goes if a smaller id that stays is like it.

    Of rows that repeat a staying id, the first by text stays.  Rows
    with a null id stay.  All columns are kept as they are.
    """
    gone = near_copies(docs, id_col, text_col, plan or similar_plan()).select(F.col("id").alias(id_col))
    place = free_name(docs, "place")
    within = Window.partitionBy(id_col).orderBy(text_col)
    kept = (
        docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").select(*docs.columns)
        .withColumn(place, F.row_number().over(within)).where(F.col(place) == 1).drop(place)
    )
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
