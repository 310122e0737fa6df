"""The next row's value in the order of an integer key, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import KeyRanges, small, stash


def with_next(df: DataFrame, key: str, value: str, rows_per_range: int = 2_000) -> DataFrame:
    """Add next_<value>: the value in the next row by (key, value), nulls first; the first row's after the last.

    Where a key, or null, fills several ranges, its rows go by a hash of the value first.

    Columns added besides: `range` and `row`, which number the rows in that order, and `edge`.  Rows are cut into ranges
    of the key, and each range ends in a copy of the first row of the next range that has rows (edge = 1; key and value
    are filled, other columns null), so that windows by range, ordered by row, see every neighbour.  Drop those rows at
    the end.  A single row is its own next; an empty table gives no rows.
    """
    names = df.columns
    ranges = KeyRanges(df, key, -(-df.count() // rows_per_range))
    placed = df.withColumn("range", ranges.index(F.col(key), F.xxhash64(value)))
    least = placed.groupBy("range").agg(F.when(F.max(F.col(key).isNull()), None).otherwise(F.min(key)).alias("__least"))
    used = W.partitionBy().orderBy("range")  # one row a range, without the values
    before = F.coalesce(F.lag("range").over(used), F.max("range").over(W.partitionBy()))
    least = stash(least.select(F.col("range").alias("__range"), "__least", before.alias("__before")), "next-least")
    heads = placed.select(key, value, "range").join(small(least, ranges.count), (F.col("range") == F.col("__range")) & F.col(key).eqNullSafe(F.col("__least")))
    heads = heads.groupBy("__before", "range", key).agg(F.max(F.col(value).isNull()).alias("__none"), F.min(value).alias("__min"))
    types = dict(df.dtypes)
    given = {key: F.col(key), value: F.when(~F.col("__none"), F.col("__min"))}
    edges = heads.select(*[given.get(c, F.lit(None).cast(types[c])).alias(c) for c in names], F.col("__before").alias("range"), F.lit(1).alias("edge"))
    both = placed.withColumn("edge", F.lit(0)).unionByName(edges)
    w = W.partitionBy("range").orderBy("edge", F.col(key).asc_nulls_first(), F.col(value).asc_nulls_first())
    return both.withColumn(f"next_{value}", F.lead(value).over(w)).withColumn("row", F.row_number().over(w))
