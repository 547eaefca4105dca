"""Quality: a factorisation machine over hashed words, structure and metadata.

Each word bucket and each statistic has a weight and a low-rank vector; two
features interact by the product of their vectors.  The sum over all pairs is
half of the squared sum minus the sum of squares, so scoring is linear in the
number of features (Rendle, 2010).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import PLAIN_WORDS, blocks, list_column, text_bytes, word_table
from starweave.llm.labelled import labelled_texts, sigmoid_score

#: Labelled rows that are learnt from at most; bits of a word's bucket; rank of the interactions.
TRAINING_ROWS, BITS, RANK = 8_000, 14, 4
THRESHOLD = 0.7
#: Statistics of structure (shares of byte classes, words, lines) and metadata of the text (its sizes).
STATISTICS = (
    "upper", "lower", "digit", "mark", "bar", "sign", "line", "beyond_ascii",
    "word_length", "repeated_words", "marked_words", "words_in_a_line", "log_bytes", "log_words",
)

_CLASS = np.full(256, 8, np.uint8)  # space and control
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:!?'\"-()", b"|", b"$%&#*@^~<>{}[]=+/\\_`", b"\n", range(128, 256))):
    _CLASS[list(_bytes)] = _i


class Features(NamedTuple):
    """Sparse rows: entries by document; columns are buckets, then statistics."""

    doc: np.ndarray
    column: np.ndarray
    value: np.ndarray
    statistics: np.ndarray  # documents x len(STATISTICS)


class Model(NamedTuple):
    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def features(data: np.ndarray, bounds: np.ndarray) -> Features:
    """Length-normed counts of hashed words, and statistics, of a block's documents."""
    found = word_table(data, bounds, PLAIN_WORDS)
    n, size = len(bounds) - 1, np.diff(bounds)
    doc, words = found.doc(), np.diff(found.first)
    pairs, counts = np.unique((doc << BITS) | (found.code >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    at = pairs >> BITS
    norm = np.sqrt(np.bincount(at, counts.astype(float) ** 2, minlength=n))
    classes = np.stack([np.bincount(_CLASS[data[bounds[d] : bounds[d + 1]]], minlength=9) for d in range(n)]) if n else np.zeros((0, 9))
    share = classes[:, :8] / np.maximum(size, 1)[:, None]
    last = data[found.end - 1] if len(found.end) else np.zeros(0, np.uint8)
    per_word = lambda x: np.bincount(doc, x, minlength=n) / np.maximum(words, 1)
    distinct = np.bincount(at, minlength=n)
    statistics = np.column_stack([
        share, per_word(found.end - found.start), 1 - distinct / np.maximum(words, 1),
        per_word((_CLASS[last] >= 3) & (_CLASS[last] <= 5)), np.log1p(words / (1 + classes[:, 6])), np.log1p(size), np.log1p(words),
    ])
    return Features(at, pairs & ((1 << BITS) - 1), counts / norm[at], statistics)


def _scores(model: Model, x: Features, n: int) -> np.ndarray:
    """The machine's sums for a block: linear time by the sum-of-squares identity."""
    dense = np.clip((x.statistics - model.mean) / model.scale, -4, 4)
    words = 1 << BITS
    z = model.bias + dense @ model.weight[words:] + np.bincount(x.doc, model.weight[x.column] * x.value, minlength=n)
    for f in range(model.vectors.shape[1]):
        part = model.vectors[x.column, f] * x.value
        own = dense * model.vectors[words:, f]
        total = np.bincount(x.doc, part, minlength=n) + own.sum(axis=1)
        squares = np.bincount(x.doc, part**2, minlength=n) + (own**2).sum(axis=1)
        z += 0.5 * (total**2 - squares)
    return z


def fit(rows: list[Features], y: np.ndarray, epochs: int = 12, rate: float = 0.02, penalty: float = 2e-4, seed: int = 5) -> Model:
    """Adam over batches of 64 rows; rows have one document each."""
    words, draw = 1 << BITS, np.random.default_rng(seed)
    size = words + len(STATISTICS)
    stats = np.concatenate([r.statistics for r in rows])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    theta = np.zeros((size, RANK + 1))
    theta[:, 1:] = draw.normal(0, 0.02, (size, RANK))
    bias, m, v, steps = np.log(share / (1 - share)), np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        for batch in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 64)):
            steps += 1
            chosen = [rows[i] for i in batch]
            dense = np.clip((stats[batch] - mean) / scale, -4, 4)
            doc = np.concatenate([np.full(len(r.column), k) for k, r in enumerate(chosen)] + [np.repeat(np.arange(len(batch)), len(STATISTICS))])
            column = np.concatenate([r.column for r in chosen] + [np.tile(words + np.arange(len(STATISTICS)), len(batch))])
            value = np.concatenate([r.value for r in chosen] + [dense.ravel()])
            part = theta[column, 1:] * value[:, None]
            total = np.stack([np.bincount(doc, part[:, f], minlength=len(batch)) for f in range(RANK)], axis=1)
            squares = np.bincount(doc, (part**2).sum(axis=1), minlength=len(batch))
            z = bias + np.bincount(doc, theta[column, 0] * value, minlength=len(batch)) + 0.5 * ((total**2).sum(axis=1) - squares)
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            bias -= rate * off.sum()
            slope = (off[doc] * value)[:, None]
            grad_rows = np.concatenate([slope, slope * (total[doc] - part)], axis=1)
            used, inverse = np.unique(column, return_inverse=True)
            grad = np.stack([np.bincount(inverse, grad_rows[:, f], minlength=len(used)) for f in range(RANK + 1)], axis=1)
            grad += penalty * theta[used]
            m[used] = 0.9 * m[used] + 0.1 * grad
            v[used] = 0.99 * v[used] + 0.01 * grad**2
            theta[used] -= rate * m[used] / (np.sqrt(v[used]) + 1e-6)
    return Model(float(bias), theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def quality_model(
    docs: DataFrame, labels: DataFrame, learnable: Column | None = None, label: str = "quality",
    bound: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Learn from at most ``bound`` labelled documents; features are made in the tasks.

    Without labelled rows the score of every text is 0.5.
    """

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for a, b in blocks(bounds):
                x = features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                n = np.bincount(x.doc, minlength=b - a)
                yield pa.RecordBatch.from_arrays([
                    list_column(pa.array(x.column.astype(np.int32)), n), list_column(pa.array(x.value.astype(np.float32)), n),
                    list_column(pa.array(x.statistics.ravel()), np.full(b - a, len(STATISTICS))), batch.column(1).slice(a, b - a),
                ], names=["column", "value", "statistics", "y"])

    sample = labelled_texts(docs, labels, label, learnable, bound, id_col, text_col).select("text", "y")
    got = sample.mapInArrow(run, "column array<int>, value array<float>, statistics array<double>, y int").toArrow()
    size = (1 << BITS) + len(STATISTICS)
    if not got.num_rows:
        return Model(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    got = got.combine_chunks()
    lists = [got.column(i).chunk(0) for i in range(3)]
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    at = lists[0].offsets.to_numpy()
    stats = flat[2].reshape(-1, len(STATISTICS))
    rows = [
        Features(np.zeros(at[i + 1] - at[i], np.int64), flat[0][at[i] : at[i + 1]].astype(np.int64), flat[1][at[i] : at[i + 1]].astype(float), stats[i : i + 1])
        for i in range(got.num_rows)
    ]
    return fit(rows, got.column(3).to_numpy().astype(float))


def scorer(model: Model):
    """A function from a column of texts to scores; null scores as the empty text."""

    def score(column: pa.Array) -> np.ndarray:
        data, bounds = text_bytes(column)
        out = np.zeros(len(column))
        for a, b in blocks(bounds):
            out[a:b] = _scores(model, features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    return score


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a score of 0 to 1, higher where label 1 is likelier; no shuffle.

    Null texts score as the empty text, equal texts alike.  The score is the
    last column, ``score`` or ``name``, with a suffix if ``docs`` has it.
    """
    return sigmoid_score(docs, text_col, scorer(model), name)
