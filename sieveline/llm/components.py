"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import join_skewed, saved


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of links (a, b), both of one ordered type.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step only rewires links towards smaller nodes, so
    the number of rows never grows beyond links plus nodes, and about log(n) steps are enough. A hub's links are rows
    of a join that broadcasts the hubs, never one group. Rows with a = b or a null are ignored.
    """
    at = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = saved(at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = join_skewed(both.where("b > a"), least, ["a"], "n", both.count()).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        step = join_skewed(large, least, ["a"], "n", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = saved(step.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links still changed after {most_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
