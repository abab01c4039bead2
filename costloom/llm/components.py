"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costloom.llm.storage import discard, stored


def _towards_least(links: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the least node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _among_smaller(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the least of them. Rows point from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node but the least of its component; component is that least node.

    ``links`` has integer columns ``a`` and ``b``. Self links, nulls and repeated links do no harm; an empty table
    gives an empty result. Each round is two aggregations with map-side combine and two equi-joins; the links are
    stored after each round, so a lost executor costs one round at most.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    for _ in range(max_rounds):
        now = stored(_among_smaller(_towards_least(now)), "links")
        if last is not None:
            discard(last)
        last = now
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        roles = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.where("up > 1 or (up = 1 and down = 1)").isEmpty():  # every node hangs on a root
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"no stable components after {max_rounds} rounds")
