"""Substring dedup: passages that recur across documents, removed by automata.

A window is ``SPAN`` consecutive words.  It is to go from a document if its
words also start in a document of smaller id.  Three steps:

1. Anchors.  Each window has one anchor, the least of its short word runs by
   a hash, so equal windows have equal anchors.  The windows around one
   anchor make up its context.  Anchors are counted by key: most stand in one
   document and end here; where all contexts of an anchor agree, the whole
   context recurs.
2. Windows.  Where contexts of an anchor differ (at the edges of a shared
   passage), their windows are counted one by one.
3. Automata.  Each task compiles the confirmed passages of its documents
   into Aho-Corasick automata of bounded size and streams the documents
   through them; every occurrence is marked, and marked words are cut.
"""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import (
    PLAIN_WORDS, Words, _powers, blocks, long_column, mixed, ngram_codes, staged, text_bytes, word_table,
)

#: Words of a window, and of the runs that may be its anchor.
SPAN, RUN = 13, 4
#: Bytes of passages in one automaton, bytes of documents that share automata.
SHARD_BYTES, BATCH_BYTES = 1 << 20, 1 << 20
#: Stands for a null id: such documents come after all others.
LAST_ID = (1 << 63) - 1


class Anchors(NamedTuple):
    """The contexts of a block, in order; windows are named by their first word."""

    windows: np.ndarray  # first words of all windows
    context: np.ndarray  # the context of each window
    key: np.ndarray  # hash of each context's anchor
    around: np.ndarray  # 32-bit hash of the whole context and the anchor's place in it
    doc: np.ndarray  # document of each context


def anchors(found: Words, span: int = SPAN, run: int = RUN) -> Anchors:
    """Contexts of the windows that lie in one document."""
    n, none = len(found.code), np.zeros(0, np.int64)
    if n < span:
        return Anchors(none, none, none.astype(np.uint64), none.astype(np.int32), none)
    key = ngram_codes(found.code, run)
    # runs with two long words come first: they say more than runs of particles
    long_words = np.concatenate([[0], np.cumsum(found.end - found.start > 5)])
    few = long_words[run:] - long_words[:-run] < 2
    rank = (key >> np.uint64(1)) | (few.astype(np.uint64) << np.uint64(63))
    # the leftmost least of span - run + 1 neighbouring runs, by doubling
    width, least, at = 1, rank, np.arange(len(rank))
    total = span - run + 1
    while width < total:
        step = min(width, total - width)
        left = least[:-step] <= least[step:]
        at = np.where(left, at[:-step], at[step:])
        least = np.where(left, least[:-step], least[step:])
        width += step
    doc = found.doc()
    windows = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    at = at[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[windows[1:]] != doc[windows[:-1]])
    lead = np.flatnonzero(new)
    first = windows[lead]
    stop = windows[np.concatenate([lead[1:], [len(windows)]]) - 1] + span if len(lead) else first
    power, inverse = _powers(max(1 << 20, 1 << n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.code * power[:n])])
    whole = (sums[stop] - sums[first]) * inverse[first]
    place = ((at[lead] - first) * 64 + (stop - first)).astype(np.uint64)
    around = (mixed(whole ^ (place << np.uint64(40))) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return Anchors(windows, np.cumsum(new) - 1, key[at[lead]], around, doc[first])


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def _occurrences(docs: DataFrame, span: int) -> DataFrame:
    """``id, anchor, around`` of every context."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, bounds = text_bytes(batch.column(1))
            for a, b in blocks(bounds):
                own = anchors(word_table(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], PLAIN_WORDS), span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own.doc + a]), long_column(own.key), pa.array(own.around)], names=["id", "anchor", "around"]
                )

    return docs.mapInArrow(run, "id long, anchor long, around int")


def _pair_keys(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a document of a block and a hash."""
    return mixed(value.view(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For a list column: the row of each element, and the elements; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _window_codes(code: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each window."""
    total = ngram_codes(code, span)[first]
    other = np.zeros(len(first), np.uint64)
    for i in range(span):
        other = other * np.uint64(0xD6E8FEB86659FD93) + code[first + i]
    return total, (mixed(other) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _mixed_windows(joined: DataFrame, span: int) -> DataFrame:
    """``id, window, check`` of all windows whose anchor has differing contexts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, bounds = text_bytes(batch.column(1))
            row, key = _flat(batch.column(2))
            asked = np.sort(_pair_keys(row, _numbers(key)))
            for a, b in blocks(bounds):
                found = word_table(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], PLAIN_WORDS)
                own = anchors(found, span)
                wanted = np.isin(_pair_keys(own.doc + a, own.key), asked)
                first = own.windows[wanted[own.context]] if len(own.windows) else own.windows
                code, check = _window_codes(found.code, first, span)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[found.doc()[first] + a]), long_column(code), pa.array(check)], names=["id", "window", "check"]
                )

    return joined.mapInArrow(run, "id long, window long, check int")


def _lookup(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key, LAST_ID for one that is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), LAST_ID)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], LAST_ID)


class Passage(NamedTuple):
    text: str  # words parted by one space, with a space at both ends; one character for each byte
    first: int  # in documents of larger id, all its windows are to go


def _passages(words: list[bytes], flagged: np.ndarray, firsts: np.ndarray, span: int) -> list[Passage]:
    """Maximal runs of flagged windows of one document."""
    out = []
    cuts = np.flatnonzero(np.diff(flagged) != 1) + 1
    for run, first in zip(np.split(flagged, cuts), np.split(firsts, cuts)):
        text = b" ".join([b"", *words[run[0] : run[-1] + span], b""]).decode("latin-1")
        out.append(Passage(text, int(first.max())))
    return out


def _automata(passages: set[Passage]):
    """Aho-Corasick automata over shards of at most SHARD_BYTES of passages."""
    shard, size = ahocorasick.Automaton(), 0
    for passage in sorted(passages):
        shard.add_word(passage.text, (len(passage.text), passage.first))
        size += len(passage.text)
        if size >= SHARD_BYTES:
            shard.make_automaton()
            yield shard
            shard, size = ahocorasick.Automaton(), 0
    if size:
        shard.make_automaton()
        yield shard


def _removed(ids: list[int], words: list[list[bytes]], passages: set[Passage]) -> list[np.ndarray]:
    """Which words of each document lie in an occurrence of a passage."""
    texts = [b" ".join([b"", *w, b""]).decode("latin-1") for w in words]
    marks = [None] * len(ids)
    for automaton in _automata(passages):
        for d, text in enumerate(texts):
            for stop, (size, first) in automaton.iter(text):
                if first < ids[d]:
                    if marks[d] is None:
                        marks[d] = np.zeros(len(text) + 2, np.int32)
                    marks[d][stop - size + 2] += 1  # the passage's first word begins after its space
                    marks[d][stop] -= 1
    out = []
    for own, mark in zip(words, marks):
        if mark is None:
            out.append(np.zeros(len(own), bool))
        else:
            begin = 1 + np.cumsum([0] + [len(w) + 1 for w in own[:-1]])
            out.append(np.cumsum(mark)[begin] > 0)
    return out


def _cut_rows(batch: pa.RecordBatch, span: int):
    """Rows ``id, n_words, n_removed, kept`` for a batch of ``id, text, sure, windows``."""
    ids = batch.column(0).to_numpy()
    data, bounds = text_bytes(batch.column(1))
    tables = []
    for column, name in ((batch.column(2), "anchor"), (batch.column(3), "window")):
        row, flat = _flat(column)
        key = _pair_keys(row, _numbers(flat.field(name)))
        order = np.argsort(key)
        tables.append((key[order], _numbers(flat.field("first"))[order]))
    raw = data.tobytes()
    for a, b in blocks(bounds, BATCH_BYTES):
        words = [raw[bounds[d] : bounds[d + 1]].split() for d in range(a, b)]
        found = word_table(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], PLAIN_WORDS)
        own = anchors(found, span)
        passages: set[Passage] = set()
        if len(own.windows):
            sure = _lookup(*tables[0], _pair_keys(own.doc + a, own.key))[own.context]
            rest = np.flatnonzero(sure == LAST_ID)
            if len(tables[1][0]):
                first = own.windows[rest]
                code, _ = _window_codes(found.code, first, span)
                sure[rest] = _lookup(*tables[1], _pair_keys(own.doc[own.context[rest]] + a, code))
            flagged = np.flatnonzero(sure != LAST_ID)
            doc = own.doc[own.context[flagged]]
            for d in np.unique(doc):
                mine = flagged[doc == d]
                passages.update(_passages(words[d], own.windows[mine] - found.first[d], sure[mine], span))
        gone = _removed(ids[a:b].tolist(), words, passages)
        for d, (w, g) in enumerate(zip(words, gone)):
            yield int(ids[a + d]), len(w), int(g.sum()), b" ".join(x for x, out in zip(w, g.tolist()) if not out) if g.any() else b" ".join(w)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``id, n_words, n_removed, kept`` for each row: the text without words of repeated windows.

    ``kept`` are the remaining words, joined by one space.  A null text has
    no words; texts shorter than a window stay.  A null id counts as larger
    than all others (and comes back null); documents of equal id do not
    make each other repeat.  Ids must be of an integer type.  Columns besides
    the two are not looked at.  The documents themselves are shuffled once.
    """
    spark = docs.sparkSession
    slim = docs.select(_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _occurrences(slim, span)
    recurring = (
        found.groupBy("anchor")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("around").alias("low"), F.max("around").alias("high"))
        .where("first < last").select("anchor", "first", (F.col("low") != F.col("high")).alias("differ"))
    )
    sure = F.when(~F.col("differ"), F.struct("anchor", "first"))
    lists = staged(
        found.select("id", "anchor").join(recurring, "anchor").where("differ or id > first")
        .groupBy("id").agg(F.collect_set(sure).alias("sure"), F.collect_set(F.when(F.col("differ"), F.col("anchor"))).alias("open")),
        "recurring",
    )
    dealt = slim.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    windows = _mixed_windows(dealt.join(lists.where("size(open) > 0").select("id", "open"), "id"), span)
    repeated = (
        windows.groupBy("window", "check").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    )
    edges = (
        windows.join(repeated.drop("last"), ["window", "check"]).where("id > first")
        .groupBy("id").agg(F.collect_set(F.struct("window", "first")).alias("windows"))
    )
    joined = dealt.join(lists.select("id", "sure"), "id", "left").join(edges, "id", "left").select("id", "text", "sure", "windows")

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for i, n, g, kept in _cut_rows(batch, span):
                rows.append((i, n, g, kept.decode("utf-8", "replace")))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "n_words", "n_removed", "kept"]
            )

    cut = joined.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
    return cut.withColumn("id", F.when(F.col("id") != LAST_ID, F.col("id")))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

