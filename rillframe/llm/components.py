"""Connected components of a graph of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rillframe.llm.common import dropped, sized


def _round(edges: DataFrame) -> DataFrame:
    """Rows (u, v, moved) with u > v after one large and one small star; edges has u > v and may repeat.

    Large: the larger neighbours of a node move to its least neighbour. Only smaller neighbours can be the least, so that it is an aggregate over u, and a
    hub's many larger neighbours meet one row of it in a join that Spark can split. Small: a node and its smaller neighbours move to the least of them, in order,
    without holding them. No row moves if every edge leads to a root.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("to")).select(F.col("u").alias("v"), "to")
    large = edges.join(least, "v", "left").select("u", F.coalesce("to", "v").alias("v"), F.col("to").isNotNull().alias("jumped"))
    own = Window.partitionBy("u").orderBy("v")
    near = large.select("*", F.first("v").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("low"), F.lag("v").over(own).alias("before"))
    near = near.where("before is null or before <> v")
    is_low = F.col("v") == F.col("low")
    return near.select(F.when(is_low, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"), (~is_low | F.col("jumped")).alias("moved"))


def stars(edges: DataFrame, most: int, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that isn't itself the least that its links reach. edges: a written table of at most `most` rows (u, v) in any order, of one ordered type.

    Each round ends in a table in the shared folder, no longer than the one before. The rounds grow with the logarithm of the longest path, and the driver sees
    two counts a round.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for number in range(most_rounds):
        moved = Observation()
        after, most = sized(_round(now).observe(moved, F.count_if("moved").alias("n")).select("u", "v"), "edges", most)
        if number:
            dropped(now.sparkSession, now)
        now = after
        if not moved.get["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, root being the least node that links reach."""
    found = stars(*sized(edges, "links"))
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())
