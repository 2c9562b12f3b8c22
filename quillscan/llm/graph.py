"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b), both long; the root is the least node of its component. Isolated
    nodes don't occur in links and so not in the result.

    Each round shuffles the links alone and writes them to the shared folder, so that a lost executor costs one round.
    A star's centre may hold most links: each step takes the least neighbour by a pre-aggregated minimum and joins it back, which
    adaptive execution splits when it is skewed. The rounds needed grow with the logarithm of the longest path; if `rounds` don't
    suffice, that is an error."""
    edges = materialize(_down(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "links")
    state = _state(edges)
    for done in range(rounds + 1):
        if not state[0]:
            break
        if done == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(stars.select(F.col("u").alias("node")), "node", "left_anti"))


def _down(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v")


def _state(edges: DataFrame) -> tuple:
    """Unchanged between two rounds only when the links have become stars."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
