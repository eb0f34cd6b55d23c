"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(tied).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to a smaller one; root is the least id of its component.

    ``edges`` has long columns u and v; order, repeats and loops don't matter. The
    number of rounds grows with the logarithm of the longest path, and each round is
    a table in the shared folder. An empty table gives an empty result.
    """
    # The pair of aggregates changes with any change of the edge set, which only ever shrinks or rewires.
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = scratch.keep("edges0", _small_star(edges))
    seen, step = state(now), 0
    while True:
        step += 1
        after = scratch.keep(f"edges{step}", _small_star(_large_star(now)))
        scratch.drop(f"edges{step - 1}")
        found = state(after)
        if found == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, seen = after, found
