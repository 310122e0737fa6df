"""Merging a change set with inserts, updates and deletes into a table.

merge_with_deletes is the merge of two frames.  write_delta is the merge of changes into a versioned table: it writes marks of
the rows that are gone and the rows that are new, and leaves the table's files alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.plans.relation import Relation
from loomwright.sources.store import FILE, POSITION, Counted, Load, TableStore, Watch

#: A table is written anew when so large a share of its files' rows is marked, or so many folders would make it up.
COMPACT_SHARE, COMPACT_FOLDERS = 0.25, 24
#: Changes, or inserts, of up to so many bytes are broadcast to the target.
BROADCAST_BYTES = 64 << 20


class AmbiguousMerge(ValueError):
    """A target row is matched by several updates or deletes."""


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and nested values by their length, other columns eight each."""
    sized = [F.octet_length(F.col(f"`{c}`")) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) for c, t in df.dtypes if t in ("string", "binary") or "<" in t]
    total = F.lit(8 * len(df.columns)).cast("long")
    for x in sized:
        total = total + F.coalesce(x, F.lit(0))
    return total


def merge_with_deletes(target: DataFrame, source: DataFrame, keys: str | Sequence[str], action: str | Sequence[str], predicates: Sequence[str | Column] = (), columns: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """The table after the merge, by name: the target's columns, or `columns`.

    Rows match when all keys are equal, nulls alike, and every predicate holds; predicates name the sides `target` and
    `source`.  An update replaces all columns of its match, a delete removes it, an insert without a match is added; all other
    source rows are ignored.  With `check`, AmbiguousMerge is raised when two updates or deletes match one row.

    A sound set of changes has no key twice, which is seen without the target; only keys that do occur twice meet it for the
    check.  Then the target meets updates and deletes, and inserts meet the target's keys.  Up to BROADCAST_BYTES of
    changes are broadcast, so that the target is not shuffled; beyond that both are equi-joins.
    """
    keys = [keys] if isinstance(keys, str) else list(keys or ())
    if not keys:
        raise ValueError("a merge needs a key")
    if not isinstance(action, str):
        if len(action) != 1:
            raise ValueError("a merge has one action column")
        action = action[0]
    names = list(columns or target.columns)
    dest = target.alias("target")

    def matched() -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"target.`{k}`").eqNullSafe(F.col(f"source.`{k}`"))
        for p in predicates:
            on = on & (F.expr(p) if isinstance(p, str) else p)
        return on

    changes = source.filter(F.col(f"`{action}`").isin("update", "delete"))
    counts = changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n"), F.sum(row_bytes(changes)).alias("__bytes"))
    facts = counts.agg(F.sum("__bytes").alias("size"), F.max("__n").alias("most")).first()
    few = F.broadcast if (facts["size"] or 0) <= BROADCAST_BYTES else (lambda df: df)
    if check and (facts["most"] or 0) > 1:
        again = counts.filter("__n > 1").select(*[F.col(f"`{k}`").alias(f"__again{i}") for i, k in enumerate(keys)])
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__again{i}")) for i, k in enumerate(keys)]
        on = same[0]
        for x in same[1:]:
            on = on & x
        numbered = target.join(again, on, "left_semi").withColumn("__row", F.monotonically_increasing_id()).alias("target")
        twice = numbered.join(changes.join(again, on, "left_semi").alias("source"), matched()).groupBy("target.__row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not twice.isEmpty():
            raise AmbiguousMerge("several updates or deletes match one target row")
    marked = few(changes.withColumn("__met", F.lit(True))).alias("source")
    joined = dest.join(marked, matched(), "left")
    met = F.col("source.__met").isNotNull()
    gone = met & (F.col(f"source.`{action}`") == "delete")
    kept = joined.filter(~gone).select(*[F.when(met, F.col(f"source.`{c}`")).otherwise(F.col(f"target.`{c}`")).alias(c) for c in names])
    inserts = source.filter(F.col(f"`{action}`") == "insert")
    size = inserts.agg(F.sum(row_bytes(inserts))).first()[0]
    if size is None:
        return kept
    if predicates or size > BROADCAST_BYTES:
        return kept.unionByName(inserts.alias("source").join(dest, matched(), "left_anti").select(*[F.col(f"source.`{c}`") for c in names]))
    known = dest.join(F.broadcast(inserts.alias("source")), matched(), "inner").select(*[F.col(f"source.`{k}`").alias(f"__known{i}") for i, k in enumerate(keys)]).distinct()
    on = F.col(f"`{keys[0]}`").eqNullSafe(F.col("__known0"))
    for i, k in enumerate(keys[1:], 1):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__known{i}"))
    return kept.unionByName(inserts.join(known, on, "left_anti").select(*[F.col(f"`{c}`") for c in names]))


@dataclass
class Delta:
    """What a merge adds to a version: its folders, marks and log, as publish takes them."""

    folders: list[str]
    marks: list[str]
    marked: int
    log: Mapping | None = None
    #: Scratch folders that go when the delta is published or given up.
    scratch: list[str] = field(default_factory=list)


def write_delta(store: TableStore, relation: Relation, entry: Mapping, load: Load, source: DataFrame, keys: str | Sequence[str], action: str | Sequence[str], predicates: Sequence[str | Column] = (), tracked: bool = False) -> Delta:
    """Stage the merge of `source` into the version `entry`, by the rules of merge_with_deletes.

    The changes are written once, with a number each.  They meet the table in one join, which reads its keys and what the
    predicates name (all columns only where the rows that go are logged) and gives a place and a change's number for each
    match: these are the marks.  Updates and unmatched inserts are the new rows.  Changes of up to BROADCAST_BYTES are
    broadcast.  Where the table has statistics of its first key, files outside of the changes' range are not opened.  When
    COMPACT_SHARE of the rows is marked, or COMPACT_FOLDERS folders make up the table, it is written anew.
    """
    keys = [keys] if isinstance(keys, str) else list(keys or ())
    if not keys:
        raise ValueError("a merge needs a key")
    if not isinstance(action, str):
        if len(action) != 1:
            raise ValueError("a merge has one action column")
        action = action[0]
    spark = store.spark
    names = StructType.fromJson(entry["schema"]).names
    scratch = f"{store.root}/scratch/{load.token}"
    try:
        seen = Observation()
        wanted = source.filter(F.col(f"`{action}`").isin("insert", "update", "delete")).withColumn("__change", F.monotonically_increasing_id())
        wanted.observe(seen, F.coalesce(F.sum(row_bytes(wanted)), F.lit(0)).alias("size")).write.parquet(scratch)
        changes = spark.read.schema(wanted.schema).parquet(scratch)
        within = None
        if keys[0] in (entry.get("stats") or {}).get("columns", []):
            ends = changes.agg(F.min(f"`{keys[0]}`").alias("lo"), F.max(f"`{keys[0]}`").alias("hi"), F.max(F.col(f"`{keys[0]}`").isNull()).alias("none")).first()
            within = keys[0], ends["lo"], ends["hi"], bool(ends["none"])
        few = F.broadcast if seen.get["size"] <= BROADCAST_BYTES else (lambda df: df)
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"target.`{k}`").eqNullSafe(F.col(f"source.`{k}`"))
        for p in predicates:
            on = on & (F.expr(p) if isinstance(p, str) else p)
        said, inserted = F.col(f"source.`{action}`"), F.col(f"source.`{action}`") == "insert"
        met = store.rows(relation, {**entry, "collation": None}, positions=True, within=within).alias("target").join(few(changes.alias("source")), on)
        old = [F.when(~inserted, F.col(f"target.`{c}`")).alias(c) for c in names] if tracked else []
        hits = met.select(*[F.when(~inserted, F.col(f"target.{c}")).alias(c) for c in (FILE, POSITION)], F.col("source.__change").alias("__change"), said.alias("__action"), *old)
        watch = Watch(hits, names) if tracked else None
        facts = Observation()
        (watch.df if watch else hits).observe(facts, F.count(FILE).alias("marked"), F.count(F.lit(1)).alias("hits")).write.parquet(load.marks)
        hits = spark.read.schema(hits.schema).parquet(load.marks)
        marked = facts.get["marked"]
        places = hits.filter(F.col(FILE).isNotNull())
        if marked and not places.groupBy(FILE, POSITION).count().filter("count > 1").isEmpty():
            raise AmbiguousMerge("several updates or deletes match one target row")
        row = [F.col(f"`{c}`") for c in names]
        ids = hits.select("__change", "__action")
        ids = F.broadcast(ids) if facts.get["hits"] <= 100_000 else ids
        updates = changes.join(ids.filter("__action = 'update'"), "__change").select(*row)
        inserts = changes.filter(F.col(f"`{action}`") == "insert").join(ids.filter("__action = 'insert'"), "__change", "left_anti").select(*row)
        added = store.write(load, updates.unionByName(inserts))
        before = Counted.of(entry)
        gone = Counted(marked, _gone_hash(watch, places, names, facts.get["hits"] - marked) if watch else None)
        load.counted = (before or Counted(hash=None)).plus(gone, -1).plus(added)
        new = _base(load.path)
        delta = Delta([*entry["folders"], new], [*entry.get("marks", []), *([_base(load.marks)] if marked else [])], entry.get("marked", 0) + marked)
        if tracked:
            delta.log = {"inserts": [new], "deletes": [_base(load.marks)]}
        total = (before.rows if before else 0) + entry.get("marked", 0) + added.rows
        if delta.marked > COMPACT_SHARE * total or len(delta.folders) > COMPACT_FOLDERS:
            _compact(store, relation, entry, load, delta)
        store.describe(load, StructType.fromJson(entry["schema"]), (entry.get("stats") or {}).get("columns", []), f"{store.folder(relation)}/{delta.folders[-1]}")
        return delta
    finally:
        store.discard(scratch)


def _base(path: str) -> str:
    return path.rpartition("/")[2]


def _gone_hash(watch: Watch, places: DataFrame, names: list[str], inserts: int) -> tuple[int, int] | None:
    """The hash of the old rows of updates and deletes: of all hits, unless inserts are among them, which have none."""
    if not inserts:
        return watch.found.hash
    again = Watch(places, names)
    if not again.hashed:
        return None
    again.df.write.format("noop").mode("overwrite").save()
    return again.found.hash


def _compact(store: TableStore, relation: Relation, entry: Mapping, load: Load, delta: Delta) -> None:
    """Write all rows of the version-to-be into the load's folder alone; the log keeps what only it needs."""
    whole = store.rows(relation, {**entry, "folders": delta.folders, "marks": delta.marks, "marked": delta.marked, "collation": None})
    place = f"{store.folder(relation)}/load_{load.token}c"
    whole.write.parquet(f"{place}/slice_0")
    delta.folders, delta.marks, delta.marked = [_base(place)], [], 0
