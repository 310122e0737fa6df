"""Versioned tables: a load writes folders that only it can name, and one entry in the table's history publishes them.

    root/<schema>/<table>/load_<token>/slice_<i>/*.parquet    rows
    root/<schema>/<table>/marks_<token>/*.parquet             rows of earlier loads that are gone: file and position
    root/<schema>/<table>/log_<token>/*.parquet               what an overwrite changed, where changes are tracked
    root/<schema>/<table>/stats_<token>/*.parquet             least and greatest value and nulls of a load's files, for some columns
    root/<schema>/<table>/history/<n>.json                    folders, marks, log, statistics, schema and properties of version n

The history decides.  A version lists the folders whose rows it has and the marks of those that are gone, so an append adds a
folder, and a merge a folder and marks; no file is written twice or changed.  Writers do not wait for each other: each
takes the next free number when it publishes, and whoever finds it taken looks at what has happened meanwhile.
Overwrites and appends go on from there; a merge, or an overwrite that has read its own table, was made from a version that
is no longer the last, raises ConcurrentWrite, and is made anew.  A failed load deletes its own folders and no others.

The catalog mirrors the last entry, and is set right whenever the schema is opened: a table over the folders, or a view
that leaves marked rows out.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from loomwright.plans.relation import Relation
from loomwright.sources.journal import Folder, Journal

META, VERSION, TRANSIENT = "loom.metadata", "loom.version", "loom.transient"
#: Where a row lies: its file's name, which no other file has, and its position there.
FILE, POSITION = "__file", "__position"
#: Marked rows that are broadcast to a read; beyond, the join with them shuffles.
MARKS_TO_BROADCAST = 200_000
#: Hours after which a folder that no version lists is taken for what a lost writer has left.
ORPHAN_HOURS = 24
#: Files that a read names one by one after a look at the statistics; where more are left, folders are read whole.
FILES_NAMED = 20_000
#: Suffix of the tables that stand behind views.
ROWS = "__rows"


class ConcurrentWrite(RuntimeError):
    """Another writer has published a version since this one's was read."""


def scratch_root(spark: SparkSession) -> str:
    """A new folder that driver and executors share, beside the checkpoints, which goes when the session's JVM ends.

    Where no checkpoint folder is set it is local to this machine, which only a local session may use.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not shared and held.isDefined():
        shared = held.get()
    if shared:
        root = f"{shared.rstrip('/')}/loom-{uuid.uuid4().hex[:12]}"
    elif re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="spark-loom-")
    else:
        raise ValueError("set spark.checkpoint.dir, or give a root that driver and executors share")
    folder = Folder(spark, root)
    folder.fs.mkdirs(folder.place())  # only what exists can be marked
    folder.fs.deleteOnExit(folder.place())
    return root


def fingerprint(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, as decimals: their sums over rows are a hash of the multiset that adds up over parts."""
    named = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*named).cast("decimal(38,0)"), F.xxhash64(F.lit("loom"), *named).cast("decimal(38,0)")


def hashable(schema: StructType) -> bool:
    return not re.search(r"map<|variant", schema.simpleString())


@dataclass
class Counted:
    """Rows of a multiset and its hash, which add up; the hash is None where the columns cannot be hashed."""

    rows: int = 0
    hash: tuple[int, int] | None = (0, 0)

    def plus(self, other: Counted, sign: int = 1) -> Counted:
        both = self.hash is not None and other.hash is not None
        return Counted(self.rows + sign * other.rows, tuple(a + sign * b for a, b in zip(self.hash, other.hash, strict=True)) if both else None)

    def json(self) -> dict:
        return {"rows": self.rows, "hash": None if self.hash is None else [str(h) for h in self.hash]}

    @classmethod
    def of(cls, entry: Mapping) -> Counted | None:
        held = entry.get("counted")
        return held and cls(held["rows"], held["hash"] and tuple(map(int, held["hash"])))


class Watch:
    """Counts and hashes rows while they are written, so that no other scan is needed."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None):
        self.seen = Observation()
        columns = columns or df.columns
        self.hashed = hashable(df.select(*[F.col(f"`{c}`") for c in columns]).schema)
        sums = [F.coalesce(F.sum(h), F.lit(0)).alias(f"h{i}") for i, h in enumerate(fingerprint(columns))] if self.hashed else []
        self.df = df.observe(self.seen, F.count(F.lit(1)).alias("rows"), *sums)

    @property
    def found(self) -> Counted:
        got = self.seen.get
        return Counted(got["rows"], (int(got["h0"]), int(got["h1"])) if self.hashed else None)


@dataclass
class Load:
    """What a writer has staged: its folder's path and token, and the version that it began from (0: none)."""

    folder: str
    token: str
    base: int
    counted: Counted = field(default_factory=Counted)
    published: bool = False
    #: Columns with statistics of the load's files, once they are written.
    described: list[str] = field(default_factory=list)
    described_at: str = ""

    @property
    def path(self) -> str:
        return f"{self.folder}/load_{self.token}"

    @property
    def marks(self) -> str:
        return f"{self.folder}/marks_{self.token}"

    @property
    def log(self) -> str:
        return f"{self.folder}/log_{self.token}"

    @property
    def stats(self) -> str:
        return f"{self.folder}/stats_{self.token}"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files -----------------------------------------------------------------------

    def folder(self, relation: Relation) -> str:
        return f"{self.root}/{relation.schema}/{relation.bare}"

    def files(self, relation: Relation) -> Folder:
        return Folder(self.spark, self.folder(relation))

    def history(self, relation: Relation) -> Journal:
        return Journal(self.spark, f"{self.folder(relation)}/history")

    def versions(self, relation: Relation) -> list[tuple[int, float]]:
        """(number, time) of the versions that are kept, oldest first."""
        return self.history(relation).numbers()

    def entry(self, relation: Relation) -> dict | None:
        """The current version's entry, None where there is no table."""
        last = self.history(relation).last()
        return None if last is None or last.get("dropped") else last

    def stage(self, relation: Relation) -> Load:
        """A place for a load that begins now."""
        numbers = self.versions(relation)
        return Load(self.folder(relation), uuid.uuid4().hex[:16], numbers[-1][0] if numbers else 0)

    def discard(self, path: str | Load) -> None:
        """Delete a path, or all that a load has written, unless a version has it."""
        if isinstance(path, Load) and path.published:
            return
        folders = [Folder(self.spark, p) for p in ((path.path, f"{path.path}c", path.marks, path.log, path.stats) if isinstance(path, Load) else (path,))]
        for wait in (0.0, 0.2, 0.5, 1.0):  # tasks of a failed job may still be writing
            for f in folders:
                f.delete()
            if not isinstance(path, Load):
                return
            time.sleep(wait)
            if wait and not any(f.exists("") for f in folders):
                return

    def prune(self, relation: Relation, keep_days: float | None, transient: bool, keep_last: int = 1) -> list[int]:
        """Forget versions that are neither among the last nor within the retention, and delete folders that no kept one has.

        Transient tables keep the current version; without a retention the others keep all.
        """
        history, gone, kept = self.history(relation), [], set()
        numbers = history.numbers()
        for number, written in numbers:
            expired = transient or (keep_days is not None and time.time() - written >= keep_days * 86_400)
            if expired and (number, written) not in numbers[-keep_last:]:
                gone.append(number)
            else:
                kept |= _held(history.entry(number))
        for number in gone:
            folders = _held(history.entry(number))
            history.drop(number)
            for f in folders - kept:
                self.discard(f"{self.folder(relation)}/{f}")
        return gone

    def sweep(self, relation: Relation, hours: float = ORPHAN_HOURS) -> list[str]:
        """Delete folders that no version lists and that are older than any load that may still be running."""
        old = [n for n, t in self.files(relation).listing() if re.match(r"(load|marks|log|stats)_", n) and time.time() - t >= hours * 3600]
        if not old:
            return []
        history = self.history(relation)
        held = set().union(*(_held(history.entry(n)) for n, _ in history.numbers()))
        gone = [n for n in old if n not in held]
        for n in gone:
            self.discard(f"{self.folder(relation)}/{n}")
        return gone

    # -- reading ---------------------------------------------------------------------

    def kind(self, relation: Relation) -> str | None:
        """table, view or None."""
        return "table" if self.entry(relation) else self._catalog_kind(relation)

    def _catalog_kind(self, relation: Relation) -> str | None:
        if not self.spark.catalog.tableExists(f"{relation.schema}.{relation.bare}"):
            return None
        return "view" if "VIEW" in self.spark.catalog.getTable(f"{relation.schema}.{relation.bare}").tableType else "table"

    def properties(self, relation: Relation) -> dict[str, str]:
        if entry := self.entry(relation):
            return {**entry["properties"], VERSION: str(entry["version"])}
        return {r["key"]: r["value"] for r in self.spark.sql(f"show tblproperties {relation.sql}").collect()}

    def current(self, relation: Relation) -> int | None:
        entry = self.entry(relation)
        return entry and entry["version"]

    def read(self, relation: Relation, entry: Mapping | None = None) -> DataFrame:
        """The table's rows as a version has them, the last one's where none is given; other relations as the catalog has them."""
        entry = entry or self.entry(relation)
        return self.rows(relation, entry) if entry else self.spark.table(relation.sql)

    def rows(self, relation: Relation, entry: Mapping, positions: bool = False, within: tuple[str, Any, Any, bool] | None = None) -> DataFrame:
        """The rows of a version; with `positions` also where each lies.

        `within` (column, least, greatest, with nulls) leaves out files that hold no such values by their statistics; other rows of
        the files that are left stay.
        """
        schema = StructType.fromJson(entry["schema"])
        names, where = [F.col(f"`{n}`") for n in schema.names], [F.col(FILE), F.col(POSITION)] if positions else []
        paths = self.holding(relation, entry, *within) if within else entry["folders"]
        if not paths:
            df = self.spark.createDataFrame([], StructType(schema.fields))
            return df.select("*", F.lit("").alias(FILE), F.lit(0).cast("long").alias(POSITION)) if positions else df
        df = self._parquet(relation, paths, schema)
        if positions or entry.get("marks"):
            df = df.select(*names, F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POSITION))
        if entry.get("marks"):
            marks = self._parquet(relation, entry["marks"], f"{FILE} string, {POSITION} long")
            df = df.join(F.broadcast(marks) if entry["marked"] <= MARKS_TO_BROADCAST else marks, [FILE, POSITION], "left_anti")
        if positions or entry.get("marks"):
            df = df.select(*names, *where)
        if entry.get("collation"):
            texts = {f.name for f in schema.fields if isinstance(f.dataType, StringType)}
            df = df.select(*[F.collate(F.col(f"`{n}`"), entry["collation"]).alias(n) if n in texts else F.col(f"`{n}`") for n in schema.names], *where)
        return df

    def holding(self, relation: Relation, entry: Mapping, column: str, low: Any, high: Any, nulls: bool) -> list[str]:
        """The files that may hold values of a column from `low` to `high`, or nulls; folders without statistics whole."""
        held = entry.get("stats") or {"columns": [], "by": {}}
        if column not in held["columns"] or not held["by"] or entry.get("collation"):
            return entry["folders"]
        kind = next(f.dataType.simpleString() for f in StructType.fromJson(entry["schema"]).fields if f.name == column)
        stats = self._parquet(relation, list(held["by"].values()), f"file string, `lo_{column}` {kind}, `hi_{column}` {kind}, `nulls_{column}` long")
        met = F.lit(False)
        if low is not None:
            met = met | ((F.col(f"lo_{column}") <= F.lit(high)) & (F.col(f"hi_{column}") >= F.lit(low)))
        if nulls:
            met = met | (F.col(f"nulls_{column}") > 0)
        found = [r["file"] for r in stats.filter(met).select("file").limit(FILES_NAMED + 1).collect()]
        rest = [f for f in entry["folders"] if f not in held["by"]]
        if len(found) > FILES_NAMED:
            return entry["folders"]
        return [*rest, *found]

    def describe(self, load: Load, schema: StructType, columns: list[str], path: str | None = None) -> None:
        """Write the statistics of a load's files; only the named columns are read.  Other types than whole numbers, decimals, dates and texts have none."""
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        columns = [c for c in columns if re.fullmatch(r"(tiny|small|big)?int|date|decimal\(.*\)|string", kinds.get(c, ""))]
        if not columns:
            return
        df = self.spark.read.schema(StructType([f for f in schema.fields if f.name in columns])).option("recursiveFileLookup", "true").parquet(path or load.path)
        facts = [x for c in columns for x in (F.min(f"`{c}`").alias(f"lo_{c}"), F.max(f"`{c}`").alias(f"hi_{c}"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{c}"))]
        file = F.regexp_extract("_metadata.file_path", r"(load_[0-9a-f]+/.*)$", 1).alias("file")
        df.groupBy(file).agg(*facts).coalesce(1).write.parquet(load.stats)
        load.described, load.described_at = columns, _name(path or load.path)

    def within(self, relation: Relation, column: str, low: Any, high: Any) -> DataFrame:
        """The rows whose column lies from `low` to `high`; files that hold none, by their statistics, are not opened."""
        entry = self.entry(relation)
        if entry is None:
            raise ValueError(f"{relation.sql} is no table of this store")
        return self.rows(relation, entry, within=(column, low, high, False)).filter(F.col(f"`{column}`").between(F.lit(low), F.lit(high)))

    def _stats(self, load: Load, folders: list[str], before: Mapping | None) -> dict | None:
        """The statistics of a version: its own load's and those that older folders have for the same columns."""
        by = {f: s for f, s in ((before or {}).get("by") or {}).items() if f in folders and (not load.described or load.described == before["columns"])}
        if load.described_at in folders:
            by[load.described_at] = _name(load.stats)
        return {"columns": load.described or (before or {}).get("columns", []), "by": by} if by else None

    def _parquet(self, relation: Relation, folders: list[str], schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.folder(relation)}/{f}" for f in folders])

    def read_version(self, relation: Relation, number: int) -> DataFrame:
        """A table as a version had it, while that version is kept."""
        return self.rows(relation, self.history(relation).entry(number))

    def changes(self, relation: Relation, old: int, new: int) -> DataFrame:
        """Rows that one version has and the other has not, with an `action` of insert or delete.

        Where each version between them has a log, only those are read: what they add and take away is netted by row.  Else
        both versions are compared whole.
        """
        history = self.history(relation)
        last = history.entry(new)
        logs = [history.entry(n).get("log") for n, _ in history.numbers() if old < n <= new]
        if old > new or not all(logs) or len(logs) != new - old:
            a, b = self.read_version(relation, old), self.rows(relation, last)
            return b.exceptAll(a).selectExpr("*", "'insert' as action").unionByName(a.exceptAll(b).selectExpr("*", "'delete' as action"))
        schema = StructType.fromJson(last["schema"])
        named = [F.col(f"`{n}`") for n in schema.names]
        net = self.spark.createDataFrame([], schema).withColumn("__n", F.lit(0).cast("long"))
        for folders, sign in ((sum((x.get("inserts", []) for x in logs), []), 1), (sum((x.get("deletes", []) for x in logs), []), -1)):
            if folders:
                rows = self._parquet(relation, folders, StructType([*schema.fields, *StructType.fromDDL(f"{FILE} string").fields]) if sign < 0 else schema)
                net = net.unionByName((rows.filter(F.col(FILE).isNotNull()) if sign < 0 else rows).select(*named, F.lit(sign).cast("long").alias("__n")))
        if folders := sum((x.get("net", []) for x in logs), []):
            net = net.unionByName(self._parquet(relation, folders, StructType([*schema.fields, *StructType.fromDDL("__n long").fields])))
        left = net.groupBy(*named).agg(F.sum("__n").alias("__n")).filter(F.col("__n") != 0)
        each = left.select(*named, F.when(F.col("__n") > 0, "insert").otherwise("delete").alias("action"), F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))).alias("__copy"))
        return each.drop("__copy")

    def same_rows(self, one: Relation, other: Relation) -> bool | None:
        """Whether two tables hold the same rows, from their histories alone; None where a history does not say."""
        found = [Counted.of(e) if e else None for e in map(self.entry, (one, other))]
        columns = [[c.lower() for c in StructType.fromJson(e["schema"]).names] if e else None for e in map(self.entry, (one, other))]
        if None in found or columns[0] != columns[1]:
            return None
        if found[0].rows != found[1].rows:
            return False
        return None if None in (found[0].hash, found[1].hash) else found[0].hash == found[1].hash

    # -- writing ---------------------------------------------------------------------

    def write(self, load: Load, df: DataFrame, part: str = "slice_0") -> Counted:
        """Write rows into a part of the load's folder, and count them on the way; parts may be written at the same time."""
        watch = Watch(df)
        watch.df.write.parquet(f"{load.path}/{part}")
        return watch.found

    def log_overwrite(self, relation: Relation, load: Load, before: Mapping, schema: StructType) -> dict:
        """Write what an overwrite changes: each row that has become more or less frequent, and by how much."""
        named = [F.col(f"`{n}`") for n in schema.names]
        then = StructType.fromJson(before["schema"])
        if {(f.name, f.dataType) for f in then.fields} != {(f.name, f.dataType) for f in schema.fields}:
            return {}
        now = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(load.path).select(*named, F.lit(1).cast("long").alias("__n"))
        both = now.unionByName(self.rows(relation, {**before, "collation": None}).select(*named, F.lit(-1).cast("long").alias("__n")))
        both.groupBy(*named).agg(F.sum("__n").alias("__n")).filter(F.col("__n") != 0).write.parquet(load.log)
        return {"net": [_name(load.log)]}

    def publish(self, relation: Relation, load: Load, schema: StructType, properties: Mapping[str, str], replace: bool, collation: str | None = None, comment: str = "", columns: Mapping[str, str] | None = None, log: Mapping | None = None, base: Mapping | None = None, folders: list[str] | None = None, marks: list[str] | None = None, marked: int = 0) -> int:
        """Make what a load has written a version of its own, the current one; returns its number.

        With `base` it was made from that version (a merge, or an overwrite of rows read from the table itself), and
        ConcurrentWrite is raised if another one has been published since.  The entry in the history is the step that
        counts: before it nothing has changed, after it the version holds, even if the catalog is set right only when the schema
        is next opened.  A new definition is tried out beforehand.
        """
        entry = {
            "version": load.base + 1, "folders": [_name(load.path)] if folders is None else folders, "marks": marks or [], "marked": marked, "schema": schema.jsonValue(), "properties": dict(properties), "collation": collation,
            "comment": comment, "columns": dict(columns or {}), "counted": load.counted.json(), "log": dict(log) if log else None,
            "stats": self._stats(load, [_name(load.path)] if folders is None else folders, (base or {}).get("stats")),
        }
        if replace:
            self._try_out(relation, entry, load.token)
        self._put(relation, entry, base and base["version"])
        load.published = True
        self._mirror(relation)
        return entry["version"]

    def _put(self, relation: Relation, entry: dict, base: int | None) -> None:
        """The entry under the next free number."""
        history = self.history(relation)
        while True:
            numbers = history.numbers()
            last = numbers[-1][0] if numbers else 0
            if base is not None and base != last:
                raise ConcurrentWrite(f"{relation.sql}: version {last} has been published since version {base} was read")
            entry["version"] = last + 1
            try:
                history.put(last + 1, entry)
                return
            except FileExistsError:
                continue

    def append(self, relation: Relation, df: DataFrame, evolve: bool) -> list[str]:
        """Add rows as a new version that lists the older folders, too; returns the columns that were added.

        Columns are matched by name and absent ones are null.  New columns need `evolve`, else ValueError.  Versions that others
        publish meanwhile are kept; ConcurrentWrite is raised if one of them has changed the columns or dropped the table.
        """
        load, last = self.stage(relation), self.entry(relation)
        if last is None:
            raise ValueError(f"{relation.sql} is no table of this store")
        known = StructType.fromJson(last["schema"])
        fresh = [f for f in df.schema.fields if f.name.lower() not in {k.name.lower() for k in known.fields}]
        if fresh and not evolve:
            raise ValueError(f"{relation.sql} has no columns {[f.name for f in fresh]}")
        there = {c.lower() for c in df.columns}
        columns = [F.col(f"`{f.name}`").cast(f.dataType) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields]
        schema = StructType([*known.fields, *fresh])
        try:
            added = self.write(load, df.select(*columns, *[F.col(f"`{f.name}`") for f in fresh]))
            self.describe(load, schema, (last.get("stats") or {}).get("columns", []))
            while True:
                now = self.entry(relation)
                if now is None or now["schema"] != last["schema"]:
                    raise ConcurrentWrite(f"{relation.sql}: its columns have changed since the rows were made")
                held = Counted.of(now)
                counted = Counted(held.rows + added.rows, None) if held and fresh else held and held.plus(added)
                entry = {**now, "folders": [*now["folders"], _name(load.path)], "schema": schema.jsonValue(), "counted": counted and counted.json(), "log": {"inserts": [_name(load.path)]}, "stats": self._stats(load, [*now["folders"], _name(load.path)], now.get("stats"))}
                try:
                    self._put(relation, entry, now["version"])
                    break
                except ConcurrentWrite:
                    continue
        except Exception:
            self.discard(load)
            raise
        self._mirror(relation)
        return [f.name for f in fresh]

    def drop(self, relation: Relation) -> None:
        """Drop a table or view by its actual kind; a table's versions stay on disk."""
        if self.entry(relation):
            self._put(relation, {"dropped": True}, None)
        self._forget(relation)

    # -- catalog ---------------------------------------------------------------------

    def _forget(self, relation: Relation) -> None:
        if kind := self._catalog_kind(relation):
            self.spark.sql(f"drop {kind} if exists {relation.sql}")
        self.spark.sql(f"drop table if exists {Relation(relation.bare + ROWS, relation.schema).sql}")

    def _location(self, relation: Relation, folders: list[str]) -> str:
        names = folders or ["none"]
        return f"{self.folder(relation)}/{names[0] if len(names) == 1 else '{' + ','.join(names) + '}'}"

    def _create(self, named: Relation, relation: Relation, entry: Mapping) -> None:
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}{_comment(entry, f.name)}" for f in StructType.fromJson(entry["schema"]).fields)
        default = f" default collation {entry['collation']}" if entry.get("collation") else ""
        comment = f" comment '{_quoted(entry['comment'])}'" if entry.get("comment") else ""
        self.spark.sql(f"create table {named.sql} ({columns}) using parquet options (recursiveFileLookup 'true') location '{_quoted(self._location(relation, entry['folders']))}'{comment}{default} tblproperties ({_pairs(entry)})")

    def _try_out(self, relation: Relation, entry: Mapping, token: str) -> None:
        """Raises what the catalog has against a definition."""
        tried = Relation(f"{relation.bare}__new_{token}", relation.schema)
        self._create(tried, relation, entry)
        self.spark.sql(f"drop table if exists {tried.sql}")

    def _mirror(self, relation: Relation) -> None:
        """Set the catalog right by the history; if another version comes meanwhile, by that one."""
        while entry := self.entry(relation):
            self._forget(relation)
            if not entry.get("marks"):
                self._create(relation, relation, entry)
            else:
                held = Relation(relation.bare + ROWS, relation.schema)
                self._create(held, relation, entry)
                fields = StructType.fromJson(entry["schema"]).fields
                names = ", ".join(f"`{f.name.replace('`', '``')}`" for f in fields)
                marks = f"parquet.`{self._location(relation, entry['marks'])}`"
                shown = ", ".join(f"`{f.name.replace('`', '``')}`{_comment(entry, f.name)}" for f in fields)
                comment = f" comment '{_quoted(entry['comment'])}'" if entry.get("comment") else ""
                self.spark.sql(f"""
                    create view {relation.sql} ({shown}){comment} tblproperties ({_pairs(entry)}) as
                    select {names} from (select *, _metadata.file_name as {FILE}, _metadata.row_index as {POSITION} from {held.sql}) r
                    left anti join (select {FILE}, {POSITION} from {marks}) m on r.{FILE} = m.{FILE} and r.{POSITION} = m.{POSITION}""")
            if self.current(relation) == entry["version"]:
                return

    def _mirrored(self, relation: Relation) -> str | None:
        """The version that the catalog shows."""
        if not self._catalog_kind(relation):
            return None
        return {r["key"]: r["value"] for r in self.spark.sql(f"show tblproperties {relation.sql}").collect()}.get(VERSION)

    def open(self, schema: str) -> list[str]:
        """Set the catalog's tables of a schema right by their histories; returns the tables that were not.

        Definitions that were only tried out go, and so does what lost writers have left.
        """
        mended = []
        held = Folder(self.spark, f"{self.root}/{schema}").listing()
        if not held:
            return mended
        for t in self.spark.catalog.listTables(schema):
            if not t.isTemporary and re.search(r"__new_[0-9a-f]{16}$", t.name):
                self.spark.sql(f"drop table if exists `{schema}`.`{t.name}`")
        for name, _ in held:
            relation = Relation(f'"{name}"', schema, None, "table")
            entry = self.history(relation).last() if not name.startswith("_") else None
            if entry is None:
                continue
            self.sweep(relation)
            shown = self._mirrored(relation)
            if entry.get("dropped"):
                if shown:
                    self._forget(relation)
                    mended.append(name)
            elif shown != str(entry["version"]):
                self._mirror(relation)
                mended.append(name)
        return mended

    def comment(self, relation: Relation, text: str, columns: Mapping[str, str]) -> None:
        """Describe a table in the catalog; the descriptions of a version's entry are in it already."""
        if self._catalog_kind(relation) == "table":
            self.spark.sql(f"comment on table {relation.sql} is '{_quoted(text)}'")
            for name, said in columns.items():
                self.spark.sql(f"alter table {relation.sql} alter column `{name}` comment '{_quoted(said)}'")

    def metadata(self, relation: Relation) -> dict | None:
        kept = self.properties(relation).get(META)
        return json.loads(kept) if kept else None


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def _held(entry: Mapping[str, Any]) -> set[str]:
    """The folders that an entry needs."""
    log, stats = entry.get("log") or {}, (entry.get("stats") or {}).get("by", {})
    return {f.split("/")[0] for fs in (entry.get("folders", ()), entry.get("marks", ()), stats.values(), *log.values()) for f in fs}


def _comment(entry: Mapping, column: str) -> str:
    said = {c.lower(): d for c, d in (entry.get("columns") or {}).items()}.get(column.lower())
    return f" comment '{_quoted(said)}'" if said else ""


def _pairs(entry: Mapping) -> str:
    """Properties as SQL, the version among them."""
    return ", ".join(f"'{_quoted(k)}' = '{_quoted(v)}'" for k, v in sorted({**entry["properties"], VERSION: entry["version"]}.items()))


def _quoted(text: object) -> str:
    return str(text).replace("\\", "\\\\").replace("'", "\\'")
