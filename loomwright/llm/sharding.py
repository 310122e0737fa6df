"""Sharding by weighted rendezvous hashing.

Each (key, shard) pair gets a hashed score -ln(u) / weight and the key goes to the shard of least score.  A shard's
share follows its weight, and a new shard takes keys only into itself: the other scores do not change.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import hash52, key_string, small, unit_hash

#: Rows alike in every column are given their numbers so many at a time.
ALIKE = 100_000


def _least(key: Column, weights: Mapping[int, float]) -> Column:
    shards = F.array(*[F.struct(F.lit(int(s)).alias("id"), F.lit(float(w)).alias("w")) for s, w in weights.items() if w > 0])
    score = lambda s: F.struct((-F.ln(unit_hash(F.concat(key, F.lit("#"), s["id"].cast("string")))) / s["w"]).alias("score"), s["id"].alias("id"))
    return F.array_min(F.transform(shards, score))


def rendezvous_shard(df: DataFrame, keys: list[str], weights: Mapping[int, float], added: Mapping[int, float] | None = None, out: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of each row's key, and with `added` shards the shard it has once they exist.  No shuffle.

    Null keys hash as a value of their own; equal keys share a shard; equal scores go to the lower shard id.  Shards of
    weight 0 take nothing; with none above 0, ValueError.  Columns named like the outputs are replaced.
    """
    if not any(w > 0 for w in weights.values()):
        raise ValueError("no shard has a weight above 0")
    key = key_string(*[F.col(k) for k in keys])
    best = "__best"
    done = df.withColumn(best, _least(key, weights))
    if added and any(w > 0 for w in added.values()):
        done = done.withColumn(grown, F.least(F.col(best), _least(key, added))["id"])
    return done.withColumn(out, F.col(best)["id"]).drop(best)


def number_slots(df: DataFrame, shard: str, order: list[str], shards: int, rows_per_block: int = 250_000, out: str = "slot") -> DataFrame:
    """Number each shard's rows from 0 without gaps, by the hash of `order`, then by `order` (nulls first).

    A shard is cut into blocks by the leading bits of the hash, so no task sorts a whole shard; rows alike in every
    column are counted before the sort, so thousands of copies are one row in it.  The block table has at most shards x
    blocks rows.  An empty table gives no rows.
    """
    names = df.columns
    blocks = max(16, -(-df.count() // (rows_per_block * max(1, shards))))
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    hashed = counted.withColumn("__h", hash52(key_string(*[F.col(c) for c in order])))
    hashed = hashed.withColumn("__b", F.floor(F.col("__h").cast("double") / float(1 << 52) * blocks).cast("int"))
    per_block = hashed.groupBy(F.col(shard).alias("__s"), F.col("__b").alias("__k")).agg(F.sum("__n").alias("__rows"))
    before = W.partitionBy("__s").orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select("__s", "__k", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inner = W.partitionBy(shard, "__b").orderBy("__h", *[F.col(c).asc_nulls_first() for c in names if c != shard]).rowsBetween(W.unboundedPreceding, -1)
    local = hashed.withColumn("__at", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    joined = local.join(small(starts, shards * blocks), (F.col(shard) == F.col("__s")) & (F.col("__b") == F.col("__k")))
    first = F.col("__start") + F.col("__at")
    steps = joined.select(*names, "__n", first.alias("__first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(ALIKE).cast("long"))).alias("__step"))
    return steps.select(*names, F.explode(F.sequence(F.col("__first") + F.col("__step"), F.col("__first") + F.least(F.col("__step") + ALIKE, F.col("__n")) - 1)).alias(out))
