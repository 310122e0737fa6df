"""Connected components of an edge table by contraction: every round hooks each node to its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Stashes, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being some node of its component; nodes of loops alone too.

    Each round keeps the edges between the roots found so far; every stage is a join or a grouped minimum, and each
    round's tables are written to the shared folder.  Self-loops and repeated edges are fine; null ends are dropped.
    """
    held = Stashes(edges.sparkSession, "cc")
    whole = edges.filter("a is not null and b is not null")
    labels = held.put(whole.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    live = held.put(whole.filter("a <> b").distinct(), "edges")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = held.put(both.groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").alias("up")), "parents")
        while True:
            higher = parents.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = held.put(parents.join(higher, "up").select("a", "up", "top"), "jump")
            moved = not jumped.filter("top <> up").isEmpty()
            parents = jumped.select("a", F.col("top").alias("up"))
            if not moved:
                break
        to_root = parents.select(F.col("a").alias("root"), "up")
        labels = held.put(labels.join(to_root, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        ends = live.join(parents.select("a", F.col("up").alias("x")), "a").join(parents.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        live = held.put(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    done = stash(labels, "cc-done")
    held.drop()
    return done
