"""Connected components of an edge table, without collecting it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the least node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each
    written to the shared folder; ends when a round changes no edge.  Rows with
    a null end and loops are ignored.
    """
    now = table(_tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1_000_003), F.lit(0))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = _round(now)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _round(now: DataFrame) -> DataFrame:
    """A large-star, then a small-star step."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_least(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = table(_tidy(large), "large-star")
    least = _least(large)
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return table(_tidy(small.unionByName(least.select("u", F.col("m").alias("v")))), "small-star")


def _least(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the least neighbour of each ``u``.

    Grouped by more than the key of the join that follows, so that both of its
    sides are shuffled for it and adaptive execution can split the rows of a
    node with very many neighbours.
    """
    return edges.groupBy(F.xxhash64("u").alias("_k"), "u").agg(F.min("v").alias("m")).select("u", "m")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
