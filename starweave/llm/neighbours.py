"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; the signed axis that it is nearest to then is its hash.  A table
joins so many hashes, the last one on fewer axes, that a bucket holds about
``BUCKET`` vectors, however many there are.  A query looks into the buckets
that lose least, in every table.  How many it takes is measured: for a few
queries the true neighbours are searched, and probes are added until
``RECALL`` of them are found.

Queries go to the data: blocks of queries with their probes are sent to all
tasks, each hashes its own vectors, compares those that a probe meets by
their exact distance and keeps the nearest ones of each query.  No vector is
shuffled for the search and no pair leaves a task.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from starweave.llm.common import staged
from starweave.operators.skew import lookup_join, measure_hot

#: Nearest vectors for each query.
NEAREST = 10
#: Tables, and vectors in a bucket on average.
TABLES, BUCKET = 16, 16
#: Share of the true neighbours that the probes must find, and queries by which that is measured.
RECALL, MEASURED = 0.96, 128
#: Bytes of queries with their probes that are sent to the tasks at a time; vectors that a task hashes at a time.
BLOCK_BYTES, CHUNK = 32 << 20, 2048
#: Pairs of which the distances are taken at a time.
PAIRS = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normed Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        halves = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


class Hashes:
    """The hashes of all tables for vectors of one length; equal settings give equal hashes."""

    def __init__(self, size: int, vectors: int, tables: int = TABLES, bucket: int = BUCKET, seed: int = 20240917):
        self.size, self.tables = size, tables
        self.width = 1 << max(0, (size - 1).bit_length())
        bits, self.axes = max(0, round(log2(max(1, vectors) / bucket))), []
        while bits > 0:
            axes = min(self.width.bit_length() - 1, bits - 1)
            self.axes.append(1 << axes)
            bits -= axes + 1
        draw = np.random.default_rng([seed, size])
        self.signs = draw.choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))
        self.codes = int(np.prod([2 * a for a in self.axes], dtype=object))

    def _turned(self, unit: np.ndarray, table: int, place: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.size] = unit
        for signs in self.signs[table, place]:
            x = hadamard(x * signs)
        return x[:, : self.axes[place]]

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Each vector's bucket: the nearest signed axis, for each hash of the table."""
        code = np.zeros(len(unit), np.int64)
        for place, axes in enumerate(self.axes):
            x = self._turned(unit, table, place)
            axis = np.abs(x).argmax(1)
            code = code * (2 * axes) + axis + axes * (x[np.arange(len(x)), axis] < 0)
        return code

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """Each query's ``n`` best buckets (or all), best first: those whose axes are least behind the nearest ones."""
        code, lost = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for place, axes in enumerate(self.axes):
            x = self._turned(unit, table, place)
            x = np.concatenate([x, -x], 1)
            behind = (x.max(1, keepdims=True) - x) ** 2
            best = np.argsort(behind, 1, kind="stable")[:, :n]
            behind = np.take_along_axis(behind, best, 1)
            lost = (lost[:, :, None] + behind[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * (2 * axes) + best[:, None, :]).reshape(len(unit), -1)
            order = np.argsort(lost, 1, kind="stable")[:, :n]
            lost, code = np.take_along_axis(lost, order, 1), np.take_along_axis(code, order, 1)
        return code


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, also where squares would overflow."""
    gap = a - b
    with np.errstate(over="ignore"):
        found = np.sqrt((gap * gap).sum(1))
    odd = ~np.isfinite(found) | (found < 1e-140)
    if odd.any():
        most = np.abs(gap[odd]).max(1)
        scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
        found[odd] = scale * np.sqrt(((gap[odd] / scale[:, None]) ** 2).sum(1))
    return found


class _Nearest:
    """The nearest vectors of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        query, score, number = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, number)))
        order = np.lexsort((number, score, query))
        query, score, number = query[order], score[order], number[order]
        new = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], number[keep]


def _meet(hashes: Hashes, unit: np.ndarray, probes: list[tuple[np.ndarray, np.ndarray]], n_queries: int):
    """Different ``(row, query)`` pairs of which some table has the row in a probed bucket, in portions."""
    rows, queries = [], []
    for t, (code, query) in enumerate(probes):
        own = hashes.buckets(unit, t)
        a, b = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
        n = b - a
        row = np.repeat(np.arange(len(unit)), n)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        rows.append(row)
        queries.append(query[at])
    pairs = np.unique(np.concatenate(rows) * n_queries + np.concatenate(queries)) if rows else np.zeros(0, np.int64)
    return pairs // n_queries, pairs % n_queries


def _search(size: int, ids: np.ndarray, hashes: Hashes | None, k: int, sent):
    """A function over batches of ``id, vector``: the k nearest of every query among a task's rows.

    Without hashes every row of the task is compared with every query of the block.
    """

    def run(batches):
        found = _Nearest(k)
        queries, probes = sent.value
        for batch in batches:
            matrix, number = _matrix(batch.column(1), size), np.asarray(batch.column(0))
            for a in range(0, len(matrix), CHUNK):
                part = matrix[a : a + CHUNK]
                if hashes is None:
                    row, query = (x.ravel() for x in np.indices((len(part), len(queries))))
                else:
                    row, query = _meet(hashes, _unit(part), probes, len(queries))
                for b in range(0, len(row), PAIRS):
                    r, q = row[b : b + PAIRS], query[b : b + PAIRS]
                    found.add(q, _distances(queries[q], part[r]), number[a : a + CHUNK][r])
        yield pa.RecordBatch.from_arrays([pa.array(ids[found.query]), pa.array(found.score), pa.array(found.id)], names=["query", "score", "id"])

    return run


def _block(spark, size: int, block, hashes: Hashes | None, n_probes: int, k: int):
    """The search function of a block of queries, which are broadcast with their probes."""
    ids, vectors = np.array([r["id"] for r in block], np.int64), np.array([r["vector"] for r in block], np.float64).reshape(-1, size)
    probes = []
    for t in range(hashes.tables if hashes else 0):
        code = hashes.probes(_unit(vectors), t, n_probes)
        query = np.repeat(np.arange(len(code)), code.shape[1])
        order = np.argsort(code.ravel(), kind="stable")
        probes.append((code.ravel()[order], query[order]))
    return _search(size, ids, hashes, k, spark.sparkContext.broadcast((vectors, probes)))


def probes_needed(hashes: Hashes, queries: np.ndarray, neighbours: np.ndarray, recall: float = RECALL) -> int:
    """Probes of each table by which that share of ``neighbours`` (queries x k vectors) is found."""
    unit, near = _unit(queries), _unit(neighbours.reshape(-1, hashes.size))
    own = [hashes.buckets(near, t).reshape(len(queries), -1) for t in range(hashes.tables)]
    n = 1
    while n < hashes.codes:
        n *= 4
        rank = np.full(own[0].shape, n)
        for t in range(hashes.tables):
            met = hashes.probes(unit, t, n)[:, None, :] == own[t][:, :, None]
            rank = np.minimum(rank, np.where(met.any(2), met.argmax(2), n))
        if (rank < n).mean() >= recall:
            return int(np.sort(rank.ravel())[ceil(recall * rank.size) - 1]) + 1
    return hashes.codes


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each row of ``queries``, nearest first.

    ``queries`` has the columns of ``vectors``.  The measure is the Euclidean
    distance in double precision, ties go to the smaller id.  All rows of the
    query's own id are left out; an id and vector that repeat count once.
    Rows whose id or vector is null, and vectors that are empty, zero or hold
    null or non-finite components, take no part; vectors are compared with
    those of equal length.  Queries that meet fewer than k candidates are
    compared with all rows, so less than k come only if there are no more.

    Equal vectors are searched once: of each the k + 1 smallest ids are kept,
    which is all that any answer can need.
    """
    spark = vectors.sparkSession
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    clean = lambda frame: frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & finite & F.exists(x, lambda v: v != 0)
    ).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    held = clean(vectors).withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = staged(held.select(F.col("ids")[0].alias("id"), "vector", "ids"), "vectors")
    asked = staged(clean(queries), "queries")
    wanted = staged(asked.groupBy("vector").agg(F.min("id").alias("id")), "query-vectors")
    answers = None
    for size, n, n_queries in [tuple(r) for r in held.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).join(
        wanted.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("q")), "size"
    ).collect()]:
        of = lambda frame: frame.where(F.size("vector") == size)
        found = _answers(spark, of(held), of(wanted), size, n, n_queries, k)
        answers = found if answers is None else answers.unionByName(found)
    schema = "query_id long, rank int, vec_id long, score double"
    if answers is None:
        return spark.createDataFrame([], schema)
    # every query takes the answers of its vector, without itself
    answers = wanted.join(answers.withColumnRenamed("query", "id"), "id").select("vector", "near", F.xxhash64("vector").alias("h"))
    rows = asked.withColumn("h", F.xxhash64("vector"))
    (hot,) = measure_hot(rows, ["h"])
    each = lookup_join(rows, answers, ["h", "vector"], "inner", hot=hot, spread=["id"])
    others = F.slice(F.filter("near", lambda a: a["id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "a")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("a.id").alias("vec_id"), F.col("a.score").alias("score")
    )


def _top(found: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """``query, near``: the k + 1 nearest ``(score, id)`` of each query, equal vectors under all their ids."""
    order = Window.partitionBy("query").orderBy("score", "id")
    best = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1).drop("_place")
    pairs = best.join(held.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k + 1)
    return pairs.groupBy("query").agg(near.alias("near"))


def _answers(spark, held: DataFrame, wanted: DataFrame, size: int, n: int, n_queries: int, k: int) -> DataFrame:
    """Answers for query vectors of one length; block by block, each with a bounded number of queries."""
    narrow, schema = held.select("id", "vector"), "query long, score double, id long"
    hashes = Hashes(size, n)
    key = F.xxhash64("id")

    def blocks(rows: DataFrame, many: int, bytes_each: int):
        pieces = max(1, ceil(many * bytes_each / BLOCK_BYTES))
        for i in range(pieces):
            if block := (rows.where(F.pmod(key, F.lit(pieces)) == i) if pieces > 1 else rows).collect():
                yield block

    def exact(rows: DataFrame, many: int):
        for block in blocks(rows, many, 8 * size + 64):
            yield narrow.mapInArrow(_block(spark, size, block, None, 0, k + 1), schema)

    n_probes = 0
    if hashes.axes:
        sample = wanted.orderBy(key, "id").limit(MEASURED)
        near = _top(next(exact(sample, MEASURED)), held, k).select(F.col("query"), F.explode("near").alias("a"))
        near = near.select("query", F.col("a.id").alias("id"))
        # an id of the answers is one of several of its vector
        known = held.select(F.explode("ids").alias("id"), "vector")
        pairs = near.join(F.broadcast(sample.select(F.col("id").alias("query"), F.col("vector").alias("asked"))), "query")
        pairs = known.join(F.broadcast(pairs), "id").where("id <> query").select("asked", "vector").collect()
        ask, see = (np.array([r[c] for r in pairs], np.float64).reshape(-1, size) for c in ("asked", "vector"))
        n_probes = probes_needed(hashes, ask, see[:, None, :]) if len(pairs) else hashes.codes
    answers = None
    for block in blocks(wanted, n_queries, 8 * size + 16 * hashes.tables * max(1, n_probes)):
        found = narrow.mapInArrow(_block(spark, size, block, hashes if hashes.axes else None, n_probes, k + 1), schema)
        part = staged(_top(found, held, k), "nearest")
        answers = part if answers is None else answers.unionByName(part)
    short = answers.where(F.size("near") <= k).select(F.col("query").alias("id"))
    if n > k + 1 and hashes.axes and (many := short.count()):
        again = None
        for found in exact(wanted.join(short, "id", "left_semi"), many):
            part = staged(_top(found, held, k), "nearest")
            again = part if again is None else again.unionByName(part)
        answers = answers.join(short, answers["query"] == short["id"], "left_anti").unionByName(again)
    return answers
