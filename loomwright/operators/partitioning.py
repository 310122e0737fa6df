"""One query loaded in slices: key ranges, batches of keys, or key by key.

The source is read once and written by slice (Layout), unless it is small or the ranges are very few, and a slice opens its
folder, or its row groups of one where there are very many.  What else a query reads is filtered by the slice's range, or meets the keys of the slice, which lie by slice as
well.  Slices are numbers until they run: ten thousand of them are planned like ten.

The result is the union of the slices' results.  It equals the whole query's if no group, window or join of the query
crosses a slice, which only the author of the query can promise.  Slices never overlap and cover every row, nulls too.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loomwright.sources.journal import Folder

#: Distinct values that are sampled for each range asked for.
SAMPLES_PER_RANGE = 100
#: The source is written by slice first for so many ranges, or for COPY_FROM where it has COPY_BYTES; else each range reads it.
COPY_ALWAYS, COPY_FROM, COPY_BYTES = 16, 3, 256 << 20
#: The columns that hold a row's slice and folder in a layout, and folders of a layout at most.
SLICE, FOLDER, FOLDERS = "__slice", "__folder", 512
#: Keys of a slice that are broadcast to its sources; beyond, the semi-join shuffles.
KEYS_TO_BROADCAST = 100_000


@dataclass(frozen=True)
class PartitionBy:
    source: str
    columns: tuple[str, ...]
    partitions: int | None = None
    concurrent: bool = False
    sorted_copy: bool | None = None
    validate: bool = False
    prove: bool = False


def partition_config(config: Any) -> tuple[PartitionBy | None, list[str]]:
    """From {from, columns, partitions?, async?, sorted_copy?, validate?, prove?}; what is wrong with it is said, and makes it none or drops the number."""
    if config is None:
        return None, []
    if not isinstance(config, Mapping) or "from" not in config or not config.get("columns"):
        return None, ["partition_by: `from` and `columns` are needed; the load is not sliced"]
    columns, warnings = config["columns"], []
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    number = config.get("partitions")
    if number is not None and (not isinstance(number, int) or isinstance(number, bool) or number < 1):
        warnings.append(f"partition_by: partitions {number!r} is ignored")
        number = None
    return PartitionBy(config["from"], columns, number, bool(config.get("async", False)), config.get("sorted_copy"), bool(config.get("validate", False)), bool(config.get("prove", False))), warnings


def sample_values(df: DataFrame, column: str, limit: int) -> tuple[list, bool]:
    """Up to `limit` distinct values, those of least hash, ascending; and whether null is among them (it always is if there)."""
    values = df.select(F.col(column).alias("x")).distinct().orderBy(F.when(F.col("x").isNotNull(), F.xxhash64("x")).asc_nulls_first()).limit(limit)
    rows = [r["x"] for r in values.orderBy("x").collect()]
    return [x for x in rows if x is not None], any(x is None for x in rows)


def range_bounds(values: Sequence, partitions: int) -> list:
    """Bounds of `partitions` ranges with about as many of the sorted values each; with fewer values than that, each is a bound."""
    if len(values) < partitions:
        return list(values)
    size, extra = divmod(len(values), partitions)
    ends = [(i + 1) * size + min(i + 1, extra) - 1 for i in range(partitions - 1)]
    return [values[e] for e in ends]


def sql_literal(value: Any) -> str:
    """A value as a typed literal of Spark SQL."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return f"timestamp_ntz '{value.isoformat(sep=' ')}'" if value.tzinfo is None else f"timestamp '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"date '{value.isoformat()}'"
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    if isinstance(value, decimal.Decimal):
        return f"cast('{value}' as decimal(38, {max(0, -value.as_tuple().exponent)}))"
    if isinstance(value, int):
        return f"cast({value} as bigint)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Slice:
    """One slice: how it filters a frame, and the same as an SQL condition, which is made when it is asked for."""

    apply: Callable[[DataFrame], DataFrame]
    said: Callable[[], str]

    @property
    def condition(self) -> str:
        return self.said()


def whole() -> Slice:
    return Slice(lambda df: df, lambda: "true")


def range_slices(column: str, bounds: Sequence, with_null: bool) -> list[Slice]:
    """Ranges below, between and from the bounds; nulls go with the last."""

    def one(low: Any, high: Any, null: bool) -> Slice:
        tests: list[tuple[Column, str]] = []
        if low is not None:
            tests.append((F.col(column) >= F.lit(low), f"`{column}` >= {sql_literal(low)}"))
        if high is not None:
            tests.append((F.col(column) < F.lit(high), f"`{column}` < {sql_literal(high)}"))
        keep, said = tests[0]
        for test, text in tests[1:]:
            keep, said = keep & test, f"{said} and {text}"
        if null:
            keep, said = keep | F.col(column).isNull(), f"({said} or `{column}` is null)"
        return Slice(lambda df: df.filter(keep), lambda: f"({said})")

    return [one(low, high, with_null and high is None) for low, high in zip([None, *bounds], [*bounds, None], strict=True)]


def spread_order(count: int, seed: str) -> list[int]:
    """First, last, then those between by a hash: concurrent slices start far from each other."""
    middle = sorted(range(1, count - 1), key=lambda i: hashlib.md5(f"{seed}{i}".encode()).hexdigest())
    return list(dict.fromkeys([0, count - 1, *middle]))


def numbered_keys(df: DataFrame, columns: Sequence[str], place: str, shuffle_seed: str | None = None) -> DataFrame:
    """Distinct key tuples as __k0, __k1, ... with their position from 0: in order, or by a seeded hash.

    The keys are written to `place` in ranges of that order.  A range's rows are numbered where they are, and the ranges'
    counts give where each begins, so no task holds more than a range.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(columns))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]).distinct()
    order = [F.col(n).asc_nulls_first() for n in names]
    if shuffle_seed is not None:
        keys = keys.withColumn("__hash", F.xxhash64(F.lit(shuffle_seed), *names))
        order = [F.col("__hash"), *order]
    ranged = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged.select(*names, F.monotonically_increasing_id().alias("__row")).write.parquet(place)
    held = spark.read.schema(StructType([*[f for f in keys.schema.fields if f.name in names], StructField("__row", LongType())])).parquet(place)
    blocks = held.groupBy(F.shiftright("__row", 33).alias("__block")).agg(F.count(F.lit(1)).alias("__size"))
    ahead = W.partitionBy().orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = blocks.select("__block", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__first"))
    placed = held.withColumn("__block", F.shiftright("__row", 33)).join(F.broadcast(starts), "__block")
    return placed.select(*names, (F.col("__first") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).alias("__position"))


def slice_of_range(column: str, bounds: Sequence, with_null: bool) -> Column:
    """The number of a row's range, as range_slices has them: how many bounds are at most the value; null where the row is in none."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) >= F.lit(bounds[mid]), pick(mid + 1, high)).otherwise(pick(low, mid))

    return F.when(F.col(column).isNull(), F.lit(len(bounds) if with_null else None).cast("int")).otherwise(pick(0, len(bounds)))


def worth_a_copy(df: DataFrame, ranges: int) -> bool:
    """Whether a source is written by slice for so many ranges: by their number, and by the size that the plan knows of its files."""
    return ranges >= COPY_ALWAYS or (ranges >= COPY_FROM and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= COPY_BYTES)


class KeyBatches:
    """Slices of `per_slice` consecutive keys each, matched null-safe; the last may have fewer.

    The numbered keys are written once more with their slice, in its order, so that a slice reads its own row groups.
    """

    def __init__(self, keys: DataFrame, columns: Sequence[str], per_slice: int, place: str, name: str):
        self.spark, self.columns, self.per_slice, self.place, self.name = keys.sparkSession, list(columns), per_slice, place, name
        self.names = [f"__k{i}" for i in range(len(columns))]
        self.views: list[str] = []
        by_slice = keys.select(*self.names, F.floor(F.col("__position") / per_slice).cast("int").alias(SLICE))
        self.schema = by_slice.schema
        by_slice.sortWithinPartitions(SLICE).write.parquet(place)
        self.total = self.numbered().count()
        self.count = -(-self.total // per_slice)

    def numbered(self) -> DataFrame:
        """All keys with their slice."""
        return self.spark.read.schema(self.schema).parquet(self.place)

    def keys(self, i: int) -> DataFrame:
        return self.numbered().filter(F.col(SLICE) == i).drop(SLICE)

    def same(self, df: DataFrame, keys: DataFrame) -> Column:
        on = F.lit(True)
        for c, n in zip(self.columns, self.names, strict=True):
            on = on & df[c].eqNullSafe(keys[n])
        return on

    def slices(self) -> Sequence[Slice]:
        few = F.broadcast if self.per_slice <= KEYS_TO_BROADCAST else (lambda df: df)

        def apply(i: int, df: DataFrame) -> DataFrame:
            part = few(self.keys(i))
            return df.join(part, self.same(df, part), "left_semi")

        def condition(i: int) -> str:
            view = f"{self.name}_{i}"
            self.keys(i).createOrReplaceTempView(view)
            self.views.append(view)
            same = " and ".join(f"k.{n} <=> `{c}`" for c, n in zip(self.columns, self.names, strict=True))
            return f"exists (select 1 from `{view}` k where {same})"

        return LazySlices(self.count, apply, condition)


class LazySlices(Sequence):
    """Slices that are made when they are asked for."""

    def __init__(self, count: int, apply: Callable[[int, DataFrame], DataFrame], condition: Callable[[int], str]):
        self.count, self.apply, self.condition = count, apply, condition

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> Slice:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return Slice(lambda df: self.apply(i, df), lambda: self.condition(i))


class Layout:
    """A source written once with its rows by slice, in up to FOLDERS folders of consecutive slices, and in their order within."""

    def __init__(self, df: DataFrame, number: Column | KeyBatches, columns: Sequence[str], count: int, place: str):
        self.spark, self.place, self.schema, self.count = df.sparkSession, place, df.schema, count
        names = [F.col(f"`{c}`") for c in df.columns]
        if isinstance(number, KeyBatches):
            keys = number.numbered()
            keys = F.broadcast(keys) if number.total <= KEYS_TO_BROADCAST else keys
            numbered = df.join(keys, number.same(df, keys)).select(*names, SLICE)
        else:
            numbered = df.select(*names, number.cast("int").alias(SLICE)).filter(F.col(SLICE).isNotNull())
        folder = F.floor(F.col(SLICE) * F.lit(min(count, FOLDERS)).cast("long") / F.lit(count)).cast("int")
        placed = numbered.withColumn(FOLDER, folder).hint("rebalance", F.col(FOLDER))
        placed.sortWithinPartitions(FOLDER, SLICE, *columns).write.partitionBy(FOLDER).parquet(place)

    def folder(self, i: int) -> int:
        return i * min(self.count, FOLDERS) // self.count

    def condition(self, i: int, null: bool) -> str:
        """A row of numbered() is in the slice; with `null` also one that an outer join has not filled."""
        return f"({SLICE} = {i} and {FOLDER} = {self.folder(i)}{f' or {SLICE} is null' if null else ''})"

    def numbered(self) -> DataFrame:
        """All rows with their slice and its folder; a condition on them reaches the files."""
        more = [StructField(SLICE, IntegerType()), StructField(FOLDER, IntegerType())]
        return self.spark.read.schema(StructType([*self.schema.fields, *more])).parquet(self.place)

    def open(self, i: int) -> DataFrame:
        """The rows of a slice; where none of a folder's slices has rows there is no folder."""
        path = f"{self.place}/{FOLDER}={self.folder(i)}"
        if not Folder(self.spark, path).exists(""):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(SLICE, IntegerType())])).parquet(path).filter(F.col(SLICE) == i).drop(SLICE)


def run_slices(spark: SparkSession, tasks: Sequence[Callable[[], None]], concurrent: bool, workers: int = 8) -> None:
    """Run every task; concurrent ones on a pool, all awaited before the first error is raised."""
    if not concurrent:
        for task in tasks:
            task()
        return
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(tasks)))) as pool:
        running = [pool.submit(task) for task in tasks]
    for done in running:
        done.result()
