"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table (h1, h2, n_docs) of 128-bit line hashes with the number of documents that hold the line, bucketed and
sorted by hash, so that a batch meets it without a shuffle of the run.  Every batch of documents adds a run of level 0;
`fanout` runs of a level are merged into one of the next, so a hash is rewritten a logarithmic number of times.  Hashes
that a run already shows in enough documents are settled: a new batch anti-joins them away before it adds its own, and
counts them apart, in runs of the few settled hashes, so that no count is lost and another threshold may be asked for later.

A numbered manifest says which runs hold and which batches they count.  A batch, and a compaction, is one entry: whoever opens
the folder after a crash sees it done or not begun, and a load that is made again passes over the batches that it finished.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import BLANKS, KeyRanges, Stashes, ascii_lower, fresh_path, remove_path, stash
from loomwright.sources.journal import Folder, Journal

HASH = ["h1", "h2"]
#: Documents with more common lines than this look them up by halving.
FEW_LINES = 32


def line_list(text: Column) -> Column:
    """The lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, in order: A-Z lower-cased, ASCII white space stripped at both ends."""
    return F.transform(line_list(ascii_lower(text)), lambda line: F.trim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def line_hashes(df: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """One row (key, text's hash, h1, h2) for each document and distinct line key of at least min_chars code points."""
    keys = F.filter(line_keys(F.col(text)), lambda k: F.char_length(k) >= min_chars)
    each = df.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__text"), F.explode(F.transform(F.array_distinct(keys), key_hash)).alias("h"))
    return each.select("__id", "__text", "h.h1", "h.h2")


def is_in(value: Column, ordered: Column) -> Column:
    """Whether a value is in an ascending array: by halving where the array is long, so a text's work grows little faster than its lines."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(27))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ordered, at + step - 1) < value, at + step).otherwise(at))
    return F.when(F.size(ordered) <= FEW_LINES, F.array_contains(ordered, value)).otherwise(F.coalesce(F.get(ordered, below) == value, F.lit(False)))


class LineRuns:
    """The levelled runs under a folder, as its last manifest has them.  A folder that has runs is opened as it was left.

    The driver holds the runs' paths only.  Each run is a bucketed table of the session over its folder; close() drops
    the tables and leaves the files.
    """

    #: Manifests that are kept, and hours after which what no manifest has is taken for what a lost writer has left.
    MANIFESTS, ORPHAN_HOURS = 3, 24

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, path: str | None = None, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or fresh_path(spark, "line-runs")
        self.tables: dict[str, str] = {}
        self.journal = Journal(spark, f"{self.path}/manifest")
        held = self.journal.last() or {"version": 0, "levels": [], "settled": [], "loads": {}, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
        self.version, self.buckets = held["version"], held["buckets"]
        #: Names of runs by level, of runs of settled hashes, and by load its bounds and the batches that are counted.
        self.levels: list[list[str]] = held["levels"]
        self.settled: list[str] = held["settled"]
        self.loads: dict[str, dict] = held["loads"]
        for name, written in Folder(spark, self.path).listing():
            if name not in ("manifest", *self.names) and time.time() - written > 3600 * self.ORPHAN_HOURS:
                remove_path(spark, f"{self.path}/{name}")  # of a writer that was lost before its manifest

    @property
    def names(self) -> list[str]:
        return [r for level in self.levels for r in level] + self.settled

    @property
    def paths(self) -> list[str]:
        return [f"{self.path}/{r}" for r in self.names]

    def _say(self) -> None:
        """Make the present state the one that holds; FileExistsError if another writer has said otherwise."""
        self.version += 1
        self.journal.put(self.version, {"version": self.version, "levels": self.levels, "settled": self.settled, "loads": self.loads, "buckets": self.buckets})
        for number, _ in self.journal.numbers()[: -self.MANIFESTS]:
            self.journal.drop(number)

    def _table(self, run: str) -> DataFrame:
        if run not in self.tables:
            self.tables[run] = f"line_run_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self.tables[run]} (h1 bigint, h2 bigint, n_docs bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{self.path}/{run}'")
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame, kind: str) -> str:
        run = f"{kind}_{uuid.uuid4().hex[:12]}"
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.path}/{run}").format("parquet").saveAsTable(name)
        self.tables[run] = name
        return run

    def bounds_of(self, load: str, bounds: list[int]) -> list[int]:
        """The bounds between a load's batches: those that it had before, where it is made again."""
        if load not in self.loads:
            self.loads[load] = {"bounds": bounds, "batches": []}
            self._say()
        return self.loads[load]["bounds"]

    def add(self, hashes: DataFrame, load: str | None = None, batch: int = 0) -> None:
        """Add a batch's hashes (one row for each document and line); those that are settled already are counted apart.

        A batch of a named load that is counted already is passed over.
        """
        if load is not None and batch in self.loads.setdefault(load, {"bounds": [], "batches": []})["batches"]:
            return
        run, again = hashes.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs")), None
        over = [self._table(r).filter(F.col("n_docs") >= self.min_docs).select(*HASH) for level in self.levels for r in level]
        if over:
            place = f"{self.path}/batch_{uuid.uuid4().hex[:12]}"
            run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", place).format("parquet").saveAsTable(name := f"line_run_{uuid.uuid4().hex}")
            whole = run = self.spark.table(name)
            for settled in over:
                run = run.join(settled.hint("merge"), HASH, "left_anti")
            fresh = self._write(run, "run")
            rest = whole.join(self._table(fresh).select(*HASH).hint("merge"), HASH, "left_anti")
            again = self._write(rest, "settled")
            self.spark.sql(f"drop table if exists {name}")
            remove_path(self.spark, place)
        else:
            fresh = self._write(run, "run")
        self.levels = [[*(self.levels[0] if self.levels else []), fresh], *self.levels[1:]]
        self.settled = [*self.settled, *([again] if again else [])]
        if load is not None:
            self.loads[load]["batches"].append(batch)
        self._say()
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        if len(self.settled) >= self.fanout:
            old, self.settled = self.settled, [self._write(self._merged(self.settled), "settled")]
            self._say()
            self._remove(old)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next level; the old ones go once a manifest no longer has them."""
        old, new = self.levels[level], self._write(self._merged(self.levels[level]), "run")
        self.levels = [*self.levels[:level], [], [*(self.levels[level + 1] if level + 1 < len(self.levels) else []), new], *self.levels[level + 2 :]]
        self._say()
        self._remove(old)

    def _merged(self, runs: list[str]) -> DataFrame:
        read = self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*[f"{self.path}/{r}" for r in runs])
        return read.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def common(self) -> DataFrame:
        """Hashes of the lines that at least min_docs documents hold."""
        return self._merged(self.names).filter(F.col("n_docs") >= self.min_docs).select(*HASH)

    def _remove(self, runs: list[str]) -> None:
        for run in runs:
            if name := self.tables.pop(run, None):
                self.spark.sql(f"drop table if exists {name}")
            remove_path(self.spark, f"{self.path}/{run}")

    def close(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables = {}


def drop_common_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 8, fanout: int = 4, path: str | None = None, load: str | None = None) -> DataFrame:
    """Add n_lines, n_dropped (long) and kept_text: the text without lines whose key at least min_docs documents hold.

    Batches are ranges of the integer key.  Every row is a document, so repeated rows count again; a line counts once in
    a document.  Null and empty texts have one empty line; empty keys always stay.  A document that loses every line has
    an empty kept text.  The key may be null or repeat: with the text's hash it only carries a document's common hashes
    back to its text.  An empty table gives no rows; columns named like the outputs are replaced.

    With `path`, the runs stay there, and documents of earlier calls count as well, whatever their min_docs was.  A call
    that is made again after a loss counts its rows once: `load` names a call, and without a name it is known by its rows, so
    name the calls where the same rows are to count twice.
    """
    spark = df.sparkSession
    held = Stashes(spark, "lines")
    runs = LineRuns(spark, min_docs, fanout, path)
    ranges = KeyRanges(df, key, batches)
    if path:
        if load is None:
            facts = df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), key, text).cast("decimal(38,0)")) for k in (1, 2)]).first()
            load = " ".join(map(str, facts))
        ranges.bounds = runs.bounds_of(load, ranges.bounds)
    place = fresh_path(spark, "line-hashes")
    line_hashes(df, text, key, min_chars).withColumn("batch", ranges.coarse(F.col("__id"))).write.partitionBy("batch").parquet(place)
    each = spark.read.schema(f"__id {dict(df.dtypes)[key]}, __text long, h1 long, h2 long, batch int").parquet(place)
    for k in range(len(ranges.bounds) + 1):
        runs.add(each.filter(F.col("batch") == k), load if path else None, k)
    common = held.put(runs.common(), "common")
    runs.close()
    met = stash(each.join(common, HASH, "left_semi").groupBy("__id", "__text").agg(F.sort_array(F.collect_set(F.struct(*HASH))).alias("__common")), "line-common")
    held.drop()
    remove_path(spark, place)
    rows = df.withColumn("__hash", F.xxhash64(text)).join(met, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")), "left")
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    lines, keys = line_list(F.col(text)), line_keys(F.col(text))
    pairs = F.filter(F.arrays_zip(lines.alias("line"), keys.alias("key")), lambda p: ~is_in(key_hash(p["key"]), F.col("__common")))
    split = rows.select(*names, F.size(lines).cast("long").alias("n_lines"), F.when(F.col("__common").isNull(), lines).otherwise(F.transform(pairs, lambda p: p["line"])).alias("__kept"))
    return split.select(*names, "n_lines", (F.col("n_lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))
