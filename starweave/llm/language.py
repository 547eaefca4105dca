"""Language: a bidirectional gated recurrent network over bytes.

Every byte of a text gets a probability for each language, and a document's
probabilities are their mean.  Texts run through the network in windows that
lie side by side and overlap: the first and last ``WARM`` bytes of a window
only bring the state up and are labelled by its neighbours.  The network is
trained in numpy by backpropagation through time, on stretches of ``STRETCH``
bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from starweave.llm.common import blocks, bounded_sample, free_name, text_bytes

#: Documents that are learnt from at most, stretches of each; bytes of a stretch; hidden units for each direction.
TRAINING_ROWS, STRETCHES, STRETCH, HIDDEN = 3_000, 8, 64, 8
#: Bytes that a window labels, and bytes before and behind them within the document.
LABELLED, WARM = 112, 8
#: Windows that run side by side; training batches and their size.
SIDE_BY_SIDE, STEPS, BATCH = 4096, 200, 512
UNKNOWN = "und"


class Direction(NamedTuple):
    """Gates z, r and candidate n of one direction; the byte table holds inputs and biases of all three."""

    byte: np.ndarray  # 256 x 3H
    hidden: np.ndarray  # H x 3H
    out: np.ndarray  # H x languages


class Network(NamedTuple):
    forward: Direction
    backward: Direction
    bias: np.ndarray
    languages: list[str]


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in rows of ``STRETCH``, the length and the document of each row; zeros fill the last row of a document."""
    size = np.diff(bounds)
    rows = -(-size // STRETCH)
    doc = np.repeat(np.arange(len(size)), rows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = bounds[doc] + nth * STRETCH
    length = np.minimum(STRETCH, bounds[doc + 1] - start)
    padded = np.concatenate([data, np.zeros(STRETCH, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, STRETCH)[start] if len(start) else np.zeros((0, STRETCH), np.uint8)
    short = np.flatnonzero(length < STRETCH)
    out = out.copy()
    out[short] *= np.arange(STRETCH)[None, :] < length[short, None]
    return out, length, doc


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in rows, the first labelled place and the number of labelled places in each row, and its document.

    Every byte is labelled in one row.  Zeros stand behind a document's end.
    """
    width, size = LABELLED + 2 * WARM, np.diff(bounds)
    rows = -(-size // LABELLED)
    doc = np.repeat(np.arange(len(size)), rows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
    first = np.where(nth > 0, WARM, 0)
    start = bounds[doc] + nth * LABELLED
    left = bounds[doc + 1] - start
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[start - first] if len(start) else np.zeros((0, width), np.uint8)
    out, short = out.copy(), np.flatnonzero(first + left < width)
    out[short] *= np.arange(width)[None, :] < (first + left)[short, None]
    return out, first, np.minimum(LABELLED, left), doc


def _run(x: np.ndarray, d: Direction, order: range, logits: np.ndarray, keep: list | None = None) -> None:
    """Carry the state over the bytes ``x`` (positions x rows) in ``order`` and add its logits."""
    n, units = x.shape[1], d.hidden.shape[0]
    h = np.zeros((n, units), np.float32)
    inputs, inner = np.empty((n, 3 * units), np.float32), np.empty((n, 3 * units), np.float32)
    for t in order:
        np.take(d.byte, x[t], axis=0, out=inputs, mode="clip")
        np.matmul(h, d.hidden, out=inner)
        gates = inputs[:, : 2 * units] + inner[:, : 2 * units]
        np.tanh(gates, out=gates)  # the sigmoid is (1 + tanh(x / 2)) / 2; the half is in the weights
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :units], gates[:, units:]
        u = inner[:, 2 * units :]
        c = r * u
        c += inputs[:, 2 * units :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, r, u.copy(), c))
        h = h + z * (c - h)
        logits[t] += h @ d.out


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities for each position of rows ``x``: positions x rows x languages."""
    turned = np.ascontiguousarray(x.T)
    logits = np.tile(net.bias.astype(np.float32), (*turned.shape, 1))
    _run(turned, net.forward, range(len(turned)), logits)
    _run(turned, net.backward, range(len(turned) - 1, -1, -1), logits)
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def document_probabilities(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean over all bytes of each document; a document without bytes gets zeros."""
    x, first, length, doc = windows(data, bounds)
    total = np.zeros((len(bounds) - 1, len(net.languages)))
    place = np.arange(LABELLED + 2 * WARM)[:, None]
    for a in range(0, len(x), SIDE_BY_SIDE):
        part, begin, size = (v[a : a + SIDE_BY_SIDE] for v in (x, first, length))
        labelled = (place >= begin[None, :]) & (place < (begin + size)[None, :])
        rows = np.einsum("tnk,tn->nk", position_probabilities(net, part), labelled.astype(np.float32))
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(doc[a : a + SIDE_BY_SIDE], rows[:, k], minlength=len(total))
    return total / np.maximum(np.diff(bounds), 1)[:, None]


def _back(x: np.ndarray, d: Direction, kept: list, slope: np.ndarray) -> Direction:
    """Gradients of one direction, from the logits' slopes, back through the kept states."""
    units = d.hidden.shape[0]
    g_byte, g_hidden, g_out = np.zeros_like(d.byte), np.zeros_like(d.hidden), np.zeros_like(d.out)
    dh = np.zeros_like(kept[0][1])
    for t, h, z, r, u, c in reversed(kept):
        after = h + z * (c - h)
        g_out += after.T @ slope[t]
        dh = dh + slope[t] @ d.out.T
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z) * 2  # the gate's input is halved before the tanh
        dr = dc * u * r * (1 - r) * 2
        inner = np.concatenate([dz, dr, dc * r], axis=1)
        inputs = np.concatenate([dz, dr, dc], axis=1)
        np.add.at(g_byte, x[t], inputs)
        g_hidden += h.T @ inner
        dh = dh * (1 - z) + inner @ d.hidden.T
    return Direction(g_byte, g_hidden, g_out)


def train(x: np.ndarray, length: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 3) -> Network:
    """Cross-entropy at every position, Adam; batches draw all languages alike."""
    draw, k = np.random.default_rng(seed), len(languages)
    start = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
    parts = [start(256, 3 * HIDDEN), start(HIDDEN, 3 * HIDDEN), start(HIDDEN, k)] + [start(256, 3 * HIDDEN), start(HIDDEN, 3 * HIDDEN), start(HIDDEN, k)] + [np.zeros(k, np.float32)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    by_language = [np.flatnonzero(y == i) for i in range(k)]
    for step in range(1, steps + 1):
        chosen = np.concatenate([draw.choice(rows, max(1, BATCH // k)) for rows in by_language])
        turned = np.ascontiguousarray(x[chosen].T)
        net = Network(Direction(*parts[:3]), Direction(*parts[3:6]), parts[6], languages)
        logits = np.tile(net.bias, (*turned.shape, 1))
        kept: tuple[list, list] = ([], [])
        _run(turned, net.forward, range(STRETCH), logits, kept[0])
        _run(turned, net.backward, range(STRETCH - 1, -1, -1), logits, kept[1])
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(chosen)), y[chosen]] -= 1
        p *= (np.arange(STRETCH)[:, None] < length[chosen][None, :])[:, :, None] / np.float32(length[chosen].sum())
        slopes = [*_back(turned, net.forward, kept[0], p), *_back(turned, net.backward, kept[1], p), p.sum(axis=(0, 1))]
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, slope in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.99 * v[i] + 0.01 * slope**2
            parts[i] = (parts[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(Direction(*parts[:3]), Direction(*parts[3:6]), parts[6], languages)


def language_model(
    docs: DataFrame, learnable: Column | None = None, bound: int = TRAINING_ROWS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Network | None:
    """Learn from at most ``bound`` documents with a language, ``STRETCHES`` stretches spread over each.

    The sample's ids are broadcast; the tasks send the stretches only.
    Returns None if there is nothing to learn from.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), *([] if learnable is None else [learnable.alias("ok")]))
    ids = ids.where("id is not null and lang is not null" + ("" if learnable is None else " and ok"))
    sample = bounded_sample(ids.groupBy("id").agg(F.min("lang").alias("lang")), "id", bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def run(batches):
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                data, bounds = text_bytes(pa.array([text.as_py()], pa.string()))
                x, length, _ = stretches(data, bounds)
                pick = np.unique(np.linspace(0, len(x) - 1, min(len(x), STRETCHES)).astype(int))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang.as_py()] * len(pick), pa.string()), pa.array([x[i].tobytes() for i in pick], pa.binary()), pa.array(length[pick], pa.int64()),
                ], names=["lang", "x", "length"])

    got = texts.select("text", "lang").mapInArrow(run, "lang string, x binary, length long").toPandas().sort_values(["lang", "x"])
    if got.empty:
        return None
    languages = sorted(got["lang"].unique())
    y = got["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, STRETCH)
    return train(x, got["length"].to_numpy(), y, languages)


def predict_language(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language.

    A text that is null or has no letter, and every text if nothing was
    learnt, is ``und`` with score 0.  Nothing is shuffled.
    """
    at = docs.columns.index(text_col)
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            data, bounds = text_bytes(column)
            letter = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            if net is not None:
                for a, b in blocks(bounds, 1 << 20):
                    p = document_probabilities(net, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    known = np.flatnonzero(letter[a:b])
                    lang[a + known] = np.array(net.languages, object)[p[known].argmax(axis=1)]
                    score[a + known] = np.clip(p[known].max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))
