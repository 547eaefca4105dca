"""Mixing sources to target weights.

Documents get hash-random keys.  Within a source they stand in key order,
and prefix sums of their sizes say where the source's budget ends.  A source
is cut into ranges of the key; ranges are summed up first, so that no task
holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starweave.llm.common import free_name, staged

#: Weights of the sources in code-point order, null last; they repeat.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MOST = 3
#: Rows of a source in one range of keys, on average.
RANGE_ROWS = 5000


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Targets are weight times a common level, stopped at ``most`` times the
    size; the level is the one at which they sum up to all sizes.  That is
    what resharing by weight ends at.  With sources by rising
    size-to-weight ratio, those that stop come first, so that running sums
    over the list of sources give the level: it is the list of sources that
    is sorted here, never their documents.  Sources may be null; one without
    words gets nothing.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    listed = sources.select("source", "source_size", weight.alias("weight"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - most * F.coalesce(
        F.sum("source_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )) / F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the first source that does not stop sets the level; those tried after it also fit, but are lower
    tried = listed.withColumn("tried", level)
    fits = F.max(F.when(F.col("tried") * F.col("weight") <= most * F.col("source_size"), F.col("tried"))).over(everyone)
    return tried.select(
        "source", "source_size",
        F.least(F.coalesce(fits, F.lit(0.0)) * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"),
    )


def _dealt(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
) -> DataFrame:
    """What ``mix`` returns, with a hash of the text in ``mark``."""
    text = F.col(text_col).cast("string")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), text, F.lit("")).cast("binary"))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            word_count(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("mark"),
        ),
        "sizes",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = staged(
        source_targets(sums.select("source", "source_size"), weights, most)
        .withColumnRenamed("source", "name").join(sums.drop("source_size"), F.expr("name <=> source")).drop("name"),
        "sources",
    )
    ranges = F.greatest(F.lit(1).cast("long"), F.least(F.lit(1 << 24).cast("long"), F.ceil(F.col("n") / RANGE_ROWS)))
    share = F.conv(F.substring("key", 1, 10), 16, 10).cast("double") / float(16**10)
    # all text functions come before the join, so that they run once for each row
    keyed = rows.withColumn("share", share)
    dealt = keyed.join(
        sources.withColumn("ranges", ranges).withColumnRenamed("source", "name"), F.expr("name <=> source")
    ).withColumn("range", F.floor(F.col("share") * F.col("ranges"))).drop("name")
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum")).select(
        F.col("source").alias("name"), F.col("range").alias("part"),
        F.coalesce(F.sum("sum").over(in_source), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("source", "range").orderBy("key", "size", "id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(offsets, F.expr("name <=> source and part = range")).withColumn(
        "before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
) -> DataFrame:
    """``id, source, size, source_size, target, taken`` for each row of ``docs``.

    ``taken`` counts the words that the mix takes, repeats counted: whole
    epochs of the source first, then documents in the order of their keys
    up to the exact budget (the target, rounded); the document at the cut
    gives only its first words.  The key is the MD5 of the id, or of the text
    where the id is null, so reruns agree and rows without id spread over
    the ranges.  Rows of equal key stand by size, then by a hash of the
    text; what is equal in all of them is the same row to the mix.  Null
    sources are a source of their own, texts without words have size 0 and
    give nothing.
    """
    return _dealt(docs, id_col, source_col, text_col, weights, most).drop("mark")


def with_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, beside ``size, source_size, target, taken``.

    ``taken`` over ``size`` says how often a document is repeated.  Rows
    that repeat an id, or have none, keep their own numbers as long as their
    texts differ.  Rows equal in id, source and text are dealt out in the
    order of a hash of their other columns (maps, which have none, left
    out), so a task that is run again deals as before.
    """
    names = [free_name(docs, n) for n in ("size", "source_size", "target", "taken")]
    id_, number, mark, other = (free_name(docs, n) for n in ("mix_id", "mix_row", "mix_mark", "mix_other"))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    left = docs.withColumns({id_: F.col(id_col), mark: F.xxhash64(F.col(text_col).cast("string")), other: F.xxhash64(*hashed)})
    left = left.withColumn(number, F.row_number().over(Window.partitionBy(id_, source_col, mark).orderBy(other)))
    got = _dealt(docs, id_col, source_col, text_col)
    got = got.withColumn("row", F.row_number().over(Window.partitionBy("id", "source", "mark").orderBy("taken"))).select(
        *[F.col(c).alias(f"got_{c}") for c in got.columns], F.col("row").alias("got_row")
    ).where("got_taken > 0")
    on = (
        F.col("got_id").eqNullSafe(F.col(id_)) & F.col("got_source").eqNullSafe(F.col(source_col).cast("string"))
        & (F.col("got_mark") == F.col(mark)) & (F.col("got_row") == F.col(number))
    )
    return left.join(got, on).select(
        *docs.columns, *[F.col(f"got_{c}").alias(n) for c, n in zip(("size", "source_size", "target", "taken"), names)]
    )
