r"""Audit of filters that are applied one after the other.

Which filter removes a document depends on the order.  All that any order
can show follows from one count: the documents of a part by the set of
filters that they fail.  Documents are read once for the filters on their
own text; the filter on copies goes through a counting Bloom sketch first.

The sketch is a table of cells, ``CELLS`` for each document in segments of
``SEGMENT``.  Every task counts the cells of its own documents, the counts
are merged by a shuffle of cells, and a cell keeps one bit: touched more than
once or not.  A text with a cell that was touched once is unique for certain
and goes no further.  Only the texts that may repeat are shuffled, and their
least ids are taken over the full texts.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import ceil, factorial

from pyspark.sql import Column, DataFrame, functions as F

from starweave.llm.common import staged
from starweave.operators.skew import lookup_join, measure_hot

#: The filters by name; their place is their bit in a mask.
FILTERS = "ABCDE"
#: Cells of the sketch for each document, and in a segment (a document's cells are all in one).
CELLS, SEGMENT = 32, 1024
#: A sketch of up to so many bytes is broadcast; a larger one is joined by segment.
BROADCAST_BYTES = 32 << 20

_SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    r"""Bits of the filters on a text of its own; null is the empty text.

    A: under 200 words ``[^\x20\x09-\x0D]+``; B: less than half of the words
    are distinct; C: over 2 % of the code points are ``A-Z``; D: it holds one
    of ``#$%&*|``.
    """
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals > 2 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    )
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _cells(h: Column, segments: int) -> tuple[Column, list[Column]]:
    """Segment of a hash, and its two different cells there."""
    more = F.xxhash64(h, F.lit(1))
    first = F.pmod(more, F.lit(SEGMENT)).cast("int")
    step = F.pmod(F.shiftright(more, 20), F.lit(SEGMENT - 1)).cast("int") + 1
    return F.pmod(h, F.lit(segments).cast("long")), [first, F.pmod(first + step, F.lit(SEGMENT))]


def repeat_sketch(hashes: DataFrame, segments: int, h: str = "h") -> DataFrame:
    """``segment, bits``: 64-bit words with a 1 for every cell that was touched more than once."""
    segment, cells = _cells(F.col(h), segments)
    touched = hashes.select(segment.alias("segment"), F.explode(F.array(*cells)).alias("cell"))
    twice = touched.groupBy("segment", "cell").agg(F.count("*").alias("n")).where("n > 1")
    bit = "shiftleft(1L, cell % 64)"
    words = [F.expr(f"coalesce(bit_or(case when cell div 64 = {i} then {bit} end), 0L)") for i in range(SEGMENT // 64)]
    return twice.groupBy("segment").agg(F.array(*words).alias("bits"))


def may_repeat(rows: DataFrame, sketch: DataFrame, segments: int, h: str = "h") -> DataFrame:
    """The rows whose text may be there more than once; the others are unique for certain."""
    segment, cells = _cells(F.col(h), segments)
    placed = rows.withColumn("segment", segment)
    if segments * SEGMENT // 8 <= BROADCAST_BYTES:
        found = placed.join(F.broadcast(sketch), "segment")
    else:
        (hot,) = measure_hot(placed, ["segment"])
        found = lookup_join(placed, sketch, ["segment"], "inner", hot=hot, spread=[h])
    for cell in cells:
        word = F.element_at("bits", (F.shiftright(cell, 6) + 1))
        found = found.where(F.expr("1L").bitwiseAND(F.call_function("shiftright", word, F.pmod(cell, F.lit(64)))) == 1)
    return found.select(*rows.columns)


def filter_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``id, part, mask``, one row for each row of ``docs``.

    A row fails E if its text is that of a smaller id, in whatever part and
    whatever other filters say.  Null texts are empty texts, and copies of
    each other; a null part is the empty string.  A null id is neither
    smaller nor larger than another, so such a row never fails E.  Rows of
    one id are not smaller than each other.  Other columns do not matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    known = staged(rows.select("id", "part", text_mask(F.col("text")).alias("mask"), F.xxhash64("text").alias("h")), "text-masks")
    segments = max(1, ceil(known.count() * CELLS / SEGMENT))
    sketch = staged(repeat_sketch(known, segments), "repeat-sketch")
    texts = may_repeat(rows.where(F.col("id").isNotNull()).select("id", "text", F.xxhash64("text").alias("h")), sketch, segments)
    # the row with the least id of its text is the one that stays; ids and hashes tell it, no text is joined
    first = texts.groupBy("text").agg(F.min("id").alias("id")).select("id", F.xxhash64("text").alias("h"), F.lit(True).alias("first"))
    doubtful = may_repeat(known, sketch, segments).where(F.col("id").isNotNull()).select("id", "h").distinct()
    copies = doubtful.join(first, ["id", "h"], "left_anti").withColumn("copy", F.lit(1 << FILTERS.index("E")))
    return known.join(copies, ["id", "h"], "left").select("id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail, and those labelled so.

    A document with several labels counts as good (toxic) if one of them says
    so; null ids and null labels say nothing.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    ).where("good = 1 or toxic = 1")
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    )


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter does at every step of every order, from ``part, mask, n, good, toxic``.

    For a set S of filters let P(S) be the documents that pass all of S.  A
    filter f behind the filters S removes P(S) - P(S + f); all other counts
    and the sums over all orders follow likewise, so no order is run.
    """
    size = len(filters)
    full = (1 << size) - 1
    passes = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in range(full + 1)])
    parts = counts.groupBy("part").agg(*[passes(c).alias(c) for c in ("n", "good", "toxic")])

    def over_orders(f: int) -> Column:
        others = [i for i in range(size) if i != f]
        total = F.lit(0).cast("long")
        for k in range(size):
            for chosen in combinations(others, k):
                s = sum(1 << i for i in chosen)
                total = total + factorial(k) * factorial(size - 1 - k) * (F.col("n")[s] - F.col("n")[s | 1 << f])
        return total

    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = (
        parts.withColumn("shapleys", F.array(*[over_orders(f) for f in range(size)]))
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    )
    place = [F.instr("filter_order", letter) for letter in filters]
    upto = lambda inside: sum((F.when(inside(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(place)), F.lit(0))
    before, after = upto(lambda p: p < F.col("step")), upto(lambda p: p <= F.col("step"))
    steps = steps.withColumns({"before": before, "after": after}).withColumn("own", F.col("after") - F.col("before"))
    at = lambda c, s: F.element_at(c, s + 1)
    gone = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    all_fail = at("n", F.lit(0)) - at("n", F.col("own"))
    which = sum((F.when(p == F.col("step"), F.lit(i)).otherwise(F.lit(0)) for i, p in enumerate(place)), F.lit(0))
    return steps.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), gone("n").alias("removed"),
        (all_fail - gone("n")).alias("redundant"), (at("n", F.lit(full) - F.col("own")) - at("n", F.lit(full))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("shapleys", which).alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """All orders of the five filters over ``docs``, for each part; without documents there is no part and no row."""
    counts = mask_counts(filter_masks(docs, id_col, text_col, part_col), labels.withColumnRenamed(id_col, "doc_id"))
    return interactions(staged(counts, "mask-counts"))
