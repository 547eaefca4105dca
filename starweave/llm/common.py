"""Reading, staging and batched word tables shared by the text operators.

The word tables work on whole Arrow batches: a block of documents is one
byte buffer, and words, their bounds and 64-bit hashes are numpy arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starweave.session import parquet_stage

#: Bytes of text that are tokenised at once, and bytes of text in a block of documents.
PIECE, BLOCK = 1 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once in the shared folder and read again."""
    return parquet_stage(frame.sparkSession)(frame, name)


def free_name(frame: DataFrame, wish: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    return wish if wish.lower() not in taken else f"{wish}_{uuid.uuid4().hex[:8]}"


def crc32_of(column: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(frame: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of the id: the same rows in every run.

    The hash threshold leaves about ``bound`` rows, so that the final sort
    never sees more than a small multiple of it, whatever the input.
    """
    key = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))
    n = frame.count()
    if n > bound:
        share = 1.2 * bound / n + 1e-6
        if share < 1:
            frame = frame.where(key < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return frame.orderBy(key, id_col).limit(bound)


class Alphabet(NamedTuple):
    """Which bytes part words, and what each byte counts as in a word's hash."""

    parts: np.ndarray
    value: np.ndarray


def _alphabet(separators: set[int], fold_case: bool) -> Alphabet:
    parts = np.array([b in separators for b in range(256)])
    value = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    if fold_case:
        value[65:91] = value[97:123]
        parts[65:91] = parts[97:123]
    return Alphabet(parts, value)


#: Words are what white space parts: [^\x20\x09-\x0D]+.
PLAIN_WORDS = _alphabet({32, *range(9, 14)}, fold_case=False)
#: Lower-cased words of letters, digits and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
FOLDED_WORDS = _alphabet({*range(48), *range(58, 97), *range(123, 128)}, fold_case=True)


class Words(NamedTuple):
    """Words of a block of documents, in order."""

    start: np.ndarray  # first byte, in the block's buffer
    end: np.ndarray  # byte after the last
    code: np.ndarray  # 64-bit hash
    first: np.ndarray  # the document d has the words first[d] to first[d + 1]

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_BASE = 0x9E3779B97F4A7C15


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse; the largest tables are kept."""
    if _POWERS and len(_POWERS[0]) > size:
        return _POWERS
    _POWERS.clear()
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all their bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end and each text's bounds; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``size`` bytes; a longer one stands alone."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def _pieces(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cut no word."""
    a, n = 0, len(data)
    while a < n:
        size = PIECE
        while True:
            b = min(a + size, n)
            if b == n:
                break
            edge = int(bounds[np.searchsorted(bounds, b, "right") - 1])
            gaps = np.flatnonzero(alphabet.parts[data[max(a, b - 4096) : b]])
            inner = max(a, b - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0
            if max(edge, inner) > a:
                b = max(edge, inner)
                break
            size *= 2
        yield a, b
        a = b


def word_table(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet) -> Words:
    """All words of the documents whose bytes end at ``bounds``."""
    starts, ends, codes = [], [], []
    for a, b in _pieces(data, bounds, alphabet):
        part = data[a:b]
        inside = ~alphabet.parts[part]
        edge = np.zeros(b - a + 1, bool)
        cuts = bounds[np.searchsorted(bounds, a, "left") : np.searchsorted(bounds, b, "right")] - a
        edge[cuts] = True
        edge[[0, -1]] = True
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = True, ~inside[:-1]
        after[-1], after[:-1] = True, ~inside[1:]
        s = np.flatnonzero(inside & (before | edge[:-1]))
        e = np.flatnonzero(inside & (after | edge[1:])) + 1
        power, inverse = _powers(max(PIECE, 1 << (b - a - 1).bit_length()))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(alphabet.value[part] * power[: b - a], out=sums[1:])
        codes.append(mixed((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + a)
        ends.append(e + a)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(start, join(ends, np.int64), join(codes, np.uint64), np.searchsorted(start, bounds, "left"))


def ngram_codes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last n - 1 positions have none."""
    if len(code) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):
        total *= np.uint64(_BASE)
        total += code[i : i + len(total)]
    return mixed(total)


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def list_column(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
