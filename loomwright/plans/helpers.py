"""Small frames over the engine's helpers, for use in queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.store import scratch_root


def new_objects(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of `after` that `before` has not, if there is just one."""
    fresh = after.subtract(before)
    return fresh.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*fresh.columns)).alias("row")).filter("n = 1").select("row.*")


def hierarchy(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Each child with the list of all its ancestors, nearest first; the longest where it has several parents.

    A round joins each unfinished chain with the chains of its last ancestor, so chains double in length, and writes them to
    the shared folder; it ends when all have reached an ancestor without a parent.  Edges that run in a circle raise ValueError.
    """
    spark = edges.sparkSession
    root = scratch_root(spark)

    def kept(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{root}/round_{number}")
        return spark.read.schema(df.schema).parquet(f"{root}/round_{number}")

    pairs = edges.select(F.col(child).cast("long").alias("c"), F.col(parent).cast("long").alias("top")).filter("top is not null").distinct()
    chains, number = kept(pairs.select("c", "top", F.array("top").alias("chain"), F.lit(True).alias("more")), 0), 0
    while not chains.filter("more").isEmpty():
        if not chains.filter("more and array_contains(chain, c)").isEmpty():
            raise ValueError("a child is its own ancestor")
        onward = chains.select(F.col("c").alias("top"), F.col("top").alias("__top"), F.col("chain").alias("__chain"), F.col("more").alias("__more"))
        longer = chains.filter("more").join(onward, "top", "left").select(
            "c", F.coalesce("__top", "top").alias("top"), F.when(F.col("__top").isNull(), F.col("chain")).otherwise(F.concat("chain", "__chain")).alias("chain"), F.coalesce("__more", F.lit(False)).alias("more")
        )
        number += 1
        chains = kept(chains.filter("not more").unionByName(longer), number)
    return chains.groupBy("c").agg(F.max_by("chain", F.size("chain")).alias("chain"))
