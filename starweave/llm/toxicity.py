"""Toxicity: character n-grams, naive Bayes log-count ratios, a linear classifier.

Every n-gram of the lower-cased bytes is hashed.  Its log-count ratio says
how much likelier it is in toxic texts (Wang and Manning, 2012); the linear
model is trained on presences scaled by these ratios.  N-grams whose
document counts in the classes do not differ significantly have no weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import blocks, list_column, text_bytes
from starweave.llm.labelled import labelled_texts, sigmoid_score

#: Labelled rows that are learnt from at most; lengths of n-grams; bits of a bucket number.
TRAINING_ROWS, LENGTHS, BITS = 12_000, (3, 4, 5, 6), 20
#: Bytes of documents whose n-grams are held at once; a longer document stands alone.
BLOCK = 1 << 17
#: Standard deviations between the classes' shares below which an n-gram has no weight: of all buckets, less than one by chance.
SIGNIFICANT = 5.0
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


class Model(NamedTuple):
    weight: np.ndarray  # of each bucket: classifier's weight times log-count ratio
    bias: float


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the buckets of all n-grams of a block's documents, and where each starts; none crosses documents."""
    low = _LOWER[data]
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    key, inside = np.zeros(len(low), np.uint32), np.ones(len(low), bool)
    for n in range(1, max(LENGTHS) + 1):
        if len(low) < n:
            return
        size = len(low) - n + 1
        key = key[:size] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(1)
        inside = inside[:size] & ~edge[n - 1 : n - 1 + size] if n > 1 else inside
        if n in LENGTHS:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            at = np.flatnonzero(inside)
            yield ((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))[at], at


def _presences(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) of a block; only buckets with ``wanted`` set."""
    parts = []
    for bucket, start in gram_buckets(data, bounds):
        if wanted is not None:
            keep = np.flatnonzero(wanted[bucket])
            bucket, start = bucket[keep], start[keep]
        doc = np.searchsorted(bounds, start, "right") - 1
        parts.append(np.unique((doc << BITS) | bucket))
    pairs = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _class_counts(sample: DataFrame) -> np.ndarray:
    """Documents of each class (rows 0, 1) that hold an n-gram of each bucket; last column: documents."""
    size = 1 << BITS

    def run(batches):
        counts = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in blocks(bounds, BLOCK):
                doc, bucket = _presences(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], None)
                for c in (0, 1):
                    counts[c, :size] += np.bincount(bucket[y[doc + a] == c], minlength=size)
            counts[:, size] += np.bincount(np.clip(y, 0, 1), minlength=2)
        used = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(used, len(used) // 65536 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["b", "n0", "n1"])

    rows = (
        sample.select("text", "y").mapInArrow(run, "b long, n0 long, n1 long")
        .groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") > 2).toArrow()
    )
    counts = np.zeros((2, size + 1), np.float32)
    counts[:, rows["b"].to_numpy()] = [rows["n0"].to_numpy(), rows["n1"].to_numpy()]
    return counts


def _logistic(
    column: np.ndarray, sizes: np.ndarray, ratio: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights for presences scaled by ``ratio``: Adam on the full batch.  Rows have ``sizes`` columns each."""
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    value = ratio[column].astype(np.float32)
    w, share = np.zeros(len(ratio)), min(max(y.mean(), 1e-3), 1 - 1e-3)
    theta = np.concatenate([w, [np.log(share / (1 - share))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * theta.astype(np.float32)[column], minlength=len(y)) + theta[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(column, value * off.astype(np.float32)[row], minlength=len(ratio)) + penalty * theta[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(sample: DataFrame) -> Model:
    """A model from ``text, y`` rows; the driver sees counts and presences of weighted n-grams only.

    Without rows of both classes all scores are 0 or the one class's label.
    """
    size = 1 << BITS
    sample = sample.persist()
    counts = _class_counts(sample)
    n0, n1 = counts[:, size]
    if not n0 or not n1:
        sample.unpersist()
        return Model(np.zeros(size, np.float32), 30.0 if n1 else -30.0)
    c0, c1 = counts[0, :size], counts[1, :size]
    share = (c0 + c1) / (n0 + n1)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    z[c0 + c1 == 0] = 0
    chosen = np.flatnonzero(z > SIGNIFICANT)
    p, q = 1 + c1, 1 + c0
    ratio = np.log(p / p.sum() * (q.sum() / q))[chosen]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    wanted = place >= 0

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            docs, buckets = [], []
            for a, b in blocks(bounds, BLOCK):
                d, k = _presences(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], wanted)
                docs.append(d + a)
                buckets.append(k)
            d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            k = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            lists = list_column(pa.array(place[k].astype(np.int32)), np.bincount(d, minlength=len(batch)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "x array<int>, y int").toArrow().combine_chunks()
    sample.unpersist()
    lists = rows.column(0).combine_chunks()
    weights, bias = _logistic(
        lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), ratio, rows.column(1).to_numpy().astype(float)
    )
    table = np.zeros(size, np.float32)
    table[chosen] = weights * ratio
    return Model(table, bias)


def scorer(model: Model):
    """A function from a column of texts to scores; null scores as the empty text."""
    wanted = model.weight != 0

    def score(column: pa.Array) -> np.ndarray:
        data, bounds = text_bytes(column)
        out = np.full(len(column), model.bias)
        for a, b in blocks(bounds, BLOCK):
            doc, bucket = _presences(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], wanted)
            out[a:b] += np.bincount(doc, model.weight[bucket], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    return score


def toxicity_model(
    docs: DataFrame, labels: DataFrame, learnable: Column | None = None, label: str = "toxic",
    bound: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Learn from at most ``bound`` labelled documents."""
    return train(labelled_texts(docs, labels, label, learnable, bound, id_col, text_col))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a score of 0 to 1, higher where toxic is likelier; no shuffle.

    Null and empty texts have no n-grams and get the score of the bias;
    equal texts have equal scores.  The score is the last column, ``score``
    or ``name``, with a suffix if ``docs`` has that column.
    """
    return sigmoid_score(docs, text_col, scorer(model), name)
