"""Connected components of a table of links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for each node of links (a, b: long). Each round is a written table."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges = staged(both, "edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("new"))
        # what a root's members found is the root's as well, then every node jumps to its label's label
        roots = hooked.groupBy("label").agg(F.min("new").alias("low"))
        moved = hooked.join(roots, "label").select("node", "label", F.least("new", "low").alias("new"))
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("further"))
        step = moved.join(jump, "new").select("node", F.col("label").alias("was"), F.least("new", "further").alias("label"))
        step = staged(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
