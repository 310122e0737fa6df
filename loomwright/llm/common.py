"""Shared helpers: words, stable hashes, key ranges, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as a literal set for trim().
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Largest table, in rows, that the operators hint for a broadcast.  Rows are a few dozen bytes.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-llm-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of this session that is removed when its JVM ends."""
    root = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)  # only what exists can be marked
    fs.deleteOnExit(place)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, ascending; none where it is absent."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stashes:
    """Tables of one computation in the shared folder, which go together once it needs them no more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: lineage ends there, and lost executors cost nothing."""
        self.paths.append(fresh_path(self.spark, f"{self.name}-{name}"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = []


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows are few; beyond the limit Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def key_string(*keys: Column) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])


def hash52(text: Column) -> Column:
    """52 bits of the MD5 of a string, as a long: the same value in any engine with md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def unit_hash(text: Column) -> Column:
    """A number in (0, 1) that a string fixes."""
    return (hash52(text).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lower the session's Arrow batches to `rows` rows, so that a batch of long texts fits into a small Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, rows)


def sample_by_hash(df: DataFrame, key: str, wanted: int, rows: int) -> DataFrame:
    """About `wanted` of `rows` rows, those of least key hash (added as __h): a filter, so no task holds more than its share."""
    return df.withColumn("__h", hash52(key_string(F.col(key)))).filter(F.col("__h") < int((1 << 52) * min(1.0, wanted / max(1, rows))))


def constants(values: list, kind: str) -> Column:
    """An array of numbers that is one literal in the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class KeyRanges:
    """Cuts an integer key into about `ranges` ranges in key order, at most LIMIT.

    Up to CUTS bounds with about as many rows between them are collected; each of those ranges is then cut evenly by
    value.  `index` gives a row's range from 0 and never decreases with the key.  A key that fills several ranges alone,
    and the null key, which comes first, are cut by a second hash where one is given: no range holds many more rows
    than its share.
    """

    CUTS, LIMIT = 1024, 1 << 20

    def __init__(self, df: DataFrame, key: str, ranges: int):
        ranges = max(1, min(ranges, self.LIMIT))
        coarse = min(ranges, self.CUTS)
        shares, got, nulls = [i / coarse for i in range(coarse + 1)], None, 0
        if ranges > 1:
            value = F.col(key).cast("long")
            facts = df.agg(F.percentile_approx(value, shares, max(10_000, 20 * coarse)).alias("cuts"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).first()
            got, nulls = facts["cuts"], -(-ranges * (facts["n"] - facts["known"]) // max(1, facts["n"]))
        times = Counter(got or [0])
        alone = {v: -(-(n - 1) * ranges // coarse) for v, n in times.items() if n > 2}
        edges = sorted({*times, *(v + 1 for v in alone if v + 1 < 1 << 63)})
        self.bounds = edges[1:-1]
        self.edges = [edges[0], *self.bounds, edges[-1] + 1]
        self.parts = [alone.get(e, -(-ranges // coarse)) for e in self.edges[:-1]]
        self.alone = [e in alone for e in self.edges[:-1]]
        self.nulls = nulls
        self.starts = [nulls + x for x in accumulate([0, *self.parts[:-1]])]
        self.count = max(1, nulls + sum(self.parts))

    def coarse(self, key: Column) -> Column:
        """How many bounds are at most the key.  By halving, so many bounds stay cheap."""

        def pick(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(key >= F.lit(self.bounds[mid]), pick(mid + 1, high)).otherwise(pick(low, mid))

        return pick(0, len(self.bounds)).cast("int")

    def index(self, key: Column, tie: Column | None = None) -> Column:
        """A row's range.  `tie` is a hash, by which rows of a key that fills several ranges are told apart."""
        main = self.coarse(key)
        share = F.lit(0.0) if tie is None else F.pmod(tie, F.lit(1 << 20)) / float(1 << 20)
        if max(self.parts) == 1:
            found = main + self.nulls
        else:
            edges = constants([float(e) for e in self.edges], "double")
            left, right = F.get(edges, main), F.get(edges, main + 1)
            size = F.get(constants(self.parts, "int"), main)
            part = F.when(F.get(constants([int(x) for x in self.alone], "int"), main) == 1, share).otherwise((key.cast("double") - left) / (right - left))
            found = F.get(constants(self.starts, "int"), main) + F.coalesce(F.least(F.greatest(F.floor(part * size), F.lit(0)), size - 1), F.lit(0)).cast("int")
        return F.when(key.isNull(), F.floor(share * self.nulls).cast("int")).otherwise(found) if self.nulls else found
