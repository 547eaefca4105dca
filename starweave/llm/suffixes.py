"""Benchmark passages in training text, found through suffix arrays of the documents.

Each block of documents is a shard with a suffix array of its own: the
positions of its words, sorted by the words that follow.  Every test suffix
is searched in it by bisection; runs of neighbouring finds are the longest
verbatim matches, with their places in the item and in the document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from starweave.llm.common import FOLDED_WORDS, blocks, free_name, list_column, text_bytes, word_table

#: Consecutive words that make a leak; bytes of benchmark text that are searched in one pass.
WINDOW, BENCHMARK_BYTES = 10, 16 << 20

MATCH = StructType([
    StructField("item_id", StringType()), StructField("item_start", IntegerType()),
    StructField("start", IntegerType()), StructField("length", IntegerType()),
])
_ARROW_MATCH = [("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]


class Tests(NamedTuple):
    """Test suffixes that are at least one window long, over a dense vocabulary."""

    vocabulary: np.ndarray  # hashes, sorted; a word's number is its place plus one
    words: np.ndarray  # numbers of all items' words, zero between items and at the end
    at: np.ndarray  # where each test suffix starts in ``words``
    need: np.ndarray  # words of its window
    item: np.ndarray  # its item
    offset: np.ndarray  # its first word's number within the item
    names: list[str]


def tests(rows: list[tuple[str, str | None]], window: int = WINDOW) -> Tests:
    """The test suffixes of ``(item id, text)`` rows."""
    data, bounds = text_bytes(pa.array([t for _, t in rows], pa.string()))
    found = word_table(data, bounds, FOLDED_WORDS)
    vocabulary, number = np.unique(found.code, return_inverse=True)
    doc, length = found.doc(), np.diff(found.first)
    place = np.arange(len(doc)) + doc
    words = np.zeros(len(doc) + len(rows) + window, np.int64)
    words[place] = number + 1
    offset = np.arange(len(doc)) - found.first[doc]
    need = np.minimum(length[doc], window)
    starts = offset + need <= length[doc]
    return Tests(vocabulary, words, place[starts], need[starts], doc[starts], offset[starts], [n for n, _ in rows])


def _packed(words: np.ndarray, bits: int, per: int) -> np.ndarray:
    """The ``per`` words from each position on, as one number."""
    padded = np.concatenate([words, np.zeros(per, np.int64)])
    total = np.zeros(len(words), np.int64)
    for i in range(per):
        total = (total << bits) | padded[i : i + len(words)]
    return total


def suffix_array(words: np.ndarray, key: np.ndarray, per: int, depth: int) -> np.ndarray:
    """Positions of known words, sorted by the ``depth`` words that follow each.

    Zero stands for a word that no test has: suffixes that begin with it
    are left out, for nothing can match them.
    """
    order = np.flatnonzero(words)
    order = order[np.argsort(key[order], kind="stable")]
    if not len(order):
        return order
    tied = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
    padded = np.concatenate([key, np.zeros(depth + per, np.int64)])
    for skip in range(per, depth, per):
        size = np.bincount(tied)
        open_ = np.flatnonzero(size[tied] > 1)
        if not len(open_):
            break
        inner = np.lexsort((padded[order[open_] + skip], tied[open_]))
        order[open_] = order[open_[inner]]
        value = padded[order + skip]
        tied = np.concatenate([[0], np.cumsum((tied[1:] != tied[:-1]) | ((size[tied] > 1)[1:] & (value[1:] != value[:-1])))])
    return order


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """For each range the first place whose value is not below (or is above) the target."""
    low, high = low.copy(), high.copy()
    while True:
        todo = low < high
        if not todo.any():
            return low
        mid = (low + high) >> 1
        seen = values[np.minimum(mid, len(values) - 1)]
        right = todo & ((seen <= target) if after else (seen < target))
        low = np.where(right, mid + 1, low)
        high = np.where(todo & ~right, mid, high)


def occurrences(asked: Tests, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (test suffix, position) where the window of the suffix stands in ``words``."""
    bits = max(1, int(len(asked.vocabulary)).bit_length())
    per = max(1, 62 // bits)
    depth = int(asked.need.max(initial=1))
    key = _packed(words, bits, per)
    order = suffix_array(words, key, per, depth)
    test = np.arange(len(asked.at))
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(order), np.int64)
    own = np.concatenate([_packed(asked.words, bits, per), np.zeros(depth + per, np.int64)])
    padded = np.concatenate([key, np.zeros(depth + per, np.int64)])
    for skip in range(0, depth, per):
        values = padded[order + skip]
        use = np.clip(asked.need[test] - skip, 0, per)
        free = (np.int64(1) << ((per - use) * bits)) - 1
        target = own[asked.at[test] + skip] & ~free
        if skip == 0:
            low, high = np.searchsorted(values, target, "left"), np.searchsorted(values, target | free, "right")
        else:
            low, high = _bisect(values, low, high, target, False), _bisect(values, low, high, target | free, True)
        some = low < high
        test, low, high = test[some], low[some], high[some]
    n = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(int(n.sum()))
    return np.repeat(test, n), order[at]


class Matches(NamedTuple):
    doc: np.ndarray
    item: np.ndarray
    item_start: np.ndarray
    start: np.ndarray
    length: np.ndarray


def longest_matches(asked: Tests, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Matches]:
    """Words in each document of a block, and all maximal verbatim matches by document and start."""
    found = word_table(data, bounds, FOLDED_WORDS)
    number = np.zeros(len(found.code), np.int64)
    if len(asked.vocabulary):
        known = np.zeros(1 << 16, bool)
        known[asked.vocabulary >> np.uint64(48)] = True
        maybe = np.flatnonzero(known[found.code >> np.uint64(48)])
        place = np.minimum(np.searchsorted(asked.vocabulary, found.code[maybe]), len(asked.vocabulary) - 1)
        number[maybe] = np.where(asked.vocabulary[place] == found.code[maybe], place + 1, 0)
    doc = found.doc()
    words = np.zeros(len(doc) + len(bounds), np.int64)
    words[np.arange(len(doc)) + doc] = number
    test, at = occurrences(asked, words)
    ends = found.first + np.arange(len(found.first))
    owner = np.searchsorted(ends, at, "right") - 1
    start, offset, item, need = at - ends[owner], asked.offset[test], asked.item[test], asked.need[test]
    # finds that follow each other in the item and in the document are one match
    by = np.lexsort((start, start - offset, item, owner))
    owner, item, start, offset, need = owner[by], item[by], start[by], offset[by], need[by]
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] != 1) | (offset[1:] - offset[:-1] != 1)
    lead = np.flatnonzero(new)
    last = np.concatenate([lead[1:], [len(by)]]) - 1 if len(lead) else lead
    length = start[last] - start[lead] + need[last]
    final = np.lexsort((item[lead], start[lead], owner[lead]))
    pick = lead[final]
    return np.diff(found.first), Matches(owner[pick], item[pick], offset[pick], start[pick], length[final])


def _batches_with_matches(batches: Iterator[pa.RecordBatch], asked: Tests, text: int, into: int | None):
    """Append word counts and matches to each batch, or more matches to a column that exists."""
    names = pa.array(asked.names, pa.string())
    for batch in batches:
        data, bounds = text_bytes(batch.column(text))
        n_words, parts = [], []
        for a, b in blocks(bounds):
            n, m = longest_matches(asked, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            n_words.append(n)
            parts.append(m._replace(doc=m.doc + a))
        all_ = Matches(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts))) if parts else Matches(*[np.zeros(0, np.int64)] * 5)
        flat = pa.StructArray.from_arrays(
            [names.take(pa.array(all_.item)), *(pa.array(x.astype(np.int32)) for x in (all_.item_start, all_.start, all_.length))],
            fields=[pa.field(*f) for f in _ARROW_MATCH],
        )
        lists = list_column(flat, np.bincount(all_.doc, minlength=len(batch)))
        columns, labels = list(batch.columns), list(batch.schema.names)
        if into is None:
            columns += [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), lists]
            labels += ["n_words", "matches"]
        else:
            both = [x.as_py() + y.as_py() for x, y in zip(columns[into], lists)]
            columns[into] = pa.array(both, pa.list_(pa.struct([pa.field(*f) for f in _ARROW_MATCH])))
        yield pa.RecordBatch.from_arrays(columns, names=labels)


def verbatim_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, words_name: str | None = None, matches_name: str | None = None,
) -> DataFrame:
    """``docs`` with the number of words and all longest matches of at least ``window`` words.

    Words are lower-cased runs of letters, digits and non-ASCII characters.
    An item of fewer words, but not none, matches as a whole.  A match is
    ``item_id, item_start, start, length``, counted in words.  The documents
    are not shuffled.  Benchmark text is handed to the tasks in blocks of at
    most ``BENCHMARK_BYTES`` (one pass over the documents for each).  Null
    texts have no words, a null item id is the empty id, an empty benchmark
    matches nothing, items that repeat match each on its own.  The two columns
    are the last ones, ``n_words`` and ``matches`` unless named otherwise; if
    ``docs`` has a column of that name, which stays, a suffix is added.
    """
    words_name, matches_name = free_name(docs, words_name or "n_words"), free_name(docs, matches_name or "matches")
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(total / BENCHMARK_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    text = docs.columns.index(text_col)
    fields = [*docs.schema.fields, StructField(words_name, LongType()), StructField(matches_name, ArrayType(MATCH))]
    schema, out = StructType(fields), docs
    for i in range(passes):
        asked = tests([(r["item"], r["text"]) for r in items.where(part == i).sort("item", "text").collect()], window)
        into = None if i == 0 else len(fields) - 1

        def run(batches, asked=asked, into=into):
            for batch in _batches_with_matches(batches, asked, text, into):
                yield batch.rename_columns([f.name for f in fields])

        out = out.mapInArrow(run, schema)
    return out


def covered(matches: Column) -> Column:
    """How many words of a document lie inside its matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["start"].cast("long").alias("start"), (m["start"] + m["length"]).cast("long").alias("stop")
    )))
    zero = F.lit(0).cast("long")
    return F.aggregate(
        spans, F.struct(zero.alias("upto"), zero.alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["stop"]).alias("upto"),
            (a["n"] + F.greatest(zero, s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark stands, columns unchanged.

    Null and empty texts stay, repeated rows and rows without id are judged
    like any other.
    """
    words, matches = free_name(docs, "n_words"), free_name(docs, "matches")
    found = verbatim_matches(docs, benchmark, text_col, window=window, words_name=words, matches_name=matches)
    return found.where(F.size(matches) == 0).select(*docs.columns)
