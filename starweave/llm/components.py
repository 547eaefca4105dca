"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starweave.llm.common import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("node", "head")), F.lit(0)).alias("sum"),
    ).first()
    return row["n"], row["sum"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is tied to the smallest of the neighbourhood."""
    both = edges.union(edges.select(F.col("head").alias("node"), F.col("node").alias("head")))
    least = both.groupBy("node").agg(F.least(F.min("head"), F.col("node")).alias("least"))
    return (
        both.where("head > node").join(least, "node")
        .select(F.col("head").alias("node"), F.col("least").alias("head"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("node").agg(F.min("head").alias("least"))
    joined = edges.join(least, "node")
    return (
        joined.select(F.col("head").alias("node"), F.col("least").alias("head"))
        .union(least.select("node", F.col("least").alias("head")))
        .where("node <> head")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node; the component is its smallest node.

    ``links`` has two long columns, one row for each link, in any direction;
    loops and nulls are left out.  Alternates large-star and small-star
    steps (Kiveris et al., 2014) until the edges stay as they are; each
    step's edges are a written table, so that no step is run again when an
    executor is lost, and at most one row comes to the driver.
    An empty input gives an empty result.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = staged(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("head")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        edges = staged(_small_star(_large_star(edges)), "stars")
        before, state = state, _state(edges)
        if before == state:
            break
    heads = edges.select(F.col("head").alias("node"), F.col("head").alias("component")).distinct()
    return edges.select("node", F.col("head").alias("component")).union(heads)
