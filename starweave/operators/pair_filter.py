"""A bitmap of requested pairs that thins out rows before they are aggregated.

Bits of a hash of each pair are set in segments of a table of 64-bit words.
The table is broadcast, so rows of pairs that nobody asked for are dropped
where they are made; a few of them pass, so an exact join has to follow.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each pair, and in a segment; bytes up to which the bitmap is broadcast.
BITS, SEGMENT, BROADCAST_BYTES = 16, 1024, 32 << 20


def _bits(keys: list[str], segments: int) -> tuple[Column, list[Column]]:
    """Segment of a pair, and its two different bits there."""
    h = F.xxhash64(F.lit("pair"), *keys)
    more = F.xxhash64(h)
    first = F.pmod(more, F.lit(SEGMENT)).cast("int")
    step = F.pmod(F.shiftright(more, 20), F.lit(SEGMENT - 1)).cast("int") + 1
    return F.pmod(h, F.lit(segments).cast("long")), [first, F.pmod(first + step, F.lit(SEGMENT))]


def pair_bitmap(pairs: DataFrame, keys: list[str], segments: int) -> DataFrame:
    """``_segment, _words``: the set bits of all pairs."""
    segment, bits = _bits(keys, segments)
    marked = pairs.select(segment.alias("_segment"), F.explode(F.array(*bits)).alias("_bit"))
    words = [F.expr(f"coalesce(bit_or(case when _bit div 64 = {i} then shiftleft(1L, _bit % 64) end), 0L)") for i in range(SEGMENT // 64)]
    return marked.groupBy("_segment").agg(F.array(*words).alias("_words"))


def only_requested(rows: DataFrame, pairs: DataFrame, keys: list[str], n_pairs: int) -> DataFrame:
    """Rows whose pair is among the ``n_pairs`` requested ones, and a hundredth of the others.

    No row of a requested pair is lost.  For more pairs than a broadcast
    bitmap may hold the rows come back as they are.  Null is a key like others.
    """
    segments = max(1, ceil(n_pairs * BITS / SEGMENT))
    if segments * SEGMENT // 8 > BROADCAST_BYTES:
        return rows
    segment, bits = _bits(keys, segments)
    met = rows.withColumn("_segment", segment).join(F.broadcast(pair_bitmap(pairs, keys, segments)), "_segment")
    for bit in bits:
        word = F.element_at("_words", F.shiftright(bit, 6) + 1)
        met = met.where(F.call_function("shiftright", word, F.pmod(bit, F.lit(64))).bitwiseAND(F.lit(1).cast("long")) == 1)
    return met.select(*rows.columns)
