"""Aggregate tables that are kept from the change log of the table they sum up.

A model of the kind incremental_aggregate names a table as its body, and in its configuration `group_by` and
`aggregates`, {column: [function, argument]} with count, sum, min or max.  The first load groups the whole table.  Later
ones read what has changed since (store.changes), add it to the groups that it touches, and merge those rows in.  A group
is grouped anew, from its own rows only, where a value that was its least or greatest is deleted, and where floating-point
sums would drift.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.operators.merge import BROADCAST_BYTES, row_bytes, write_delta

if TYPE_CHECKING:
    from loomwright.plans.engine import Engine
    from loomwright.plans.model import Model
    from loomwright.sources.store import Load

#: Properties that say which version of the source a version of the aggregate holds, and of what kind it is.
BASE, KIND = "loom.aggregate.base", "loom.aggregate.kind"
ROWS, ACTION = "__rows", "__action"


@dataclass(frozen=True)
class Plan:
    """What is grouped how: the source's model, the keys, and (column, function, argument) of each aggregate."""

    source: str
    keys: tuple[str, ...]
    parts: tuple[tuple[str, str, str | None], ...]

    @classmethod
    def of(cls, model: Model) -> Plan:
        config = model.config
        keys, wanted = config.get("group_by"), config.get("aggregates")
        if not isinstance(model.body, str) or not keys or not isinstance(wanted, Mapping):
            raise ValueError(f"{model.name}: an incremental_aggregate names a table, and has group_by and aggregates")
        parts = []
        for name, (function, *argument) in wanted.items():
            if function not in ("count", "sum", "min", "max") or (function != "count" and not argument):
                raise ValueError(f"{model.name}: {function} cannot be kept from changes")
            parts.append((name, function, argument[0] if argument else None))
        return cls(model.body.strip().lower(), (keys,) if isinstance(keys, str) else tuple(keys), tuple(parts))

    def whole(self, df: DataFrame) -> DataFrame:
        """The groups of rows: keys, aggregates, the number of rows, and for sums the number of known values."""
        out = [getattr(F, f)(F.col(f"`{a}`") if a else F.lit(1)).alias(name) for name, f, a in self.parts]
        known = [F.count(F.col(f"`{a}`")).alias(f"__known_{name}") for name, f, a in self.parts if f == "sum"]
        return df.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(*out, F.count(F.lit(1)).alias(ROWS), *known)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *(name for name, _, _ in self.parts)]

    def on(self, left: str, right: str) -> Column:
        found = F.lit(True)
        for k in self.keys:
            found = found & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
        return found

    def touched(self, changes: DataFrame) -> DataFrame:
        """For each group of changed rows: by how much counts and sums move, and the extremes of what came and of what went."""
        sign = F.when(F.col("action") == "insert", F.lit(1)).otherwise(F.lit(-1))
        out = [F.sum(sign).alias(ROWS)]
        for name, f, a in self.parts:
            value = F.col(f"`{a}`") if a else F.lit(1)
            if f == "count":
                out.append(F.sum(F.when(value.isNotNull(), sign).otherwise(0)).alias(name))
            elif f == "sum":
                out += [F.sum(sign * value).alias(name), F.sum(F.when(value.isNotNull(), sign).otherwise(0)).alias(f"__known_{name}")]
            else:
                came, went = (getattr(F, f)(F.when(F.col("action") == x, value)) for x in ("insert", "delete"))
                out += [came.alias(name), went.alias(f"__went_{name}")]
        return changes.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(*out)

    def moved(self, state: DataFrame, deltas: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
        """The touched groups with their new values, and __again where they have to be grouped anew."""
        met = deltas.alias("d").join(state.alias("s"), self.on("d", "s"), "left")
        there = F.col(f"s.{ROWS}").isNotNull()
        zero = F.lit(0)
        rows = F.coalesce(f"s.{ROWS}", zero) + F.col(f"d.{ROWS}")
        out, again = [], F.lit(False)
        for name, f, _ in self.parts:
            old, new = F.col(f"s.`{name}`"), F.col(f"d.`{name}`")
            if f == "count":
                out.append((F.coalesce(old, zero) + new).alias(name))
            elif f == "sum":
                known = F.coalesce(F.col(f"s.`__known_{name}`"), zero) + F.col(f"d.`__known_{name}`")
                out.append(F.when(known > 0, F.coalesce(old, zero) + F.coalesce(new, zero)).cast(kinds[name]).alias(name))
                again = again | F.lit(kinds[name] in ("double", "float"))
            else:
                went = F.col(f"d.`__went_{name}`")
                out.append((F.least if f == "min" else F.greatest)(old, new).alias(name))
                again = again | F.coalesce(went <= old if f == "min" else went >= old, F.lit(False))
        known = [(F.coalesce(F.col(f"s.`__known_{n}`"), zero) + F.col(f"d.`__known_{n}`")).alias(f"__known_{n}") for n, f, _ in self.parts if f == "sum"]
        return met.select(*[F.col(f"d.`{k}`").alias(k) for k in self.keys], *out, rows.alias(ROWS), *known, (there & again & (rows > 0)).alias("__again"), there.alias("__there"))


def build_aggregate(engine: Engine, model: Model, full_refresh: bool, load: Load):
    """Load an aggregate table, from the changes since its last load where the logs have them; else whole.

    Returns (verb, version); the verb is replace for a whole load, keep for changes, and none where nothing has changed.
    """
    plan, store = Plan.of(model), engine.store
    relation, source = engine.relation(model.name, "table"), engine.relation(plan.source)
    entry, held = engine._pin(relation.bare), engine._pin(source.bare)
    if held is None:
        raise ValueError(f"{model.name}: {plan.source} is no table of this store")
    kind = json.dumps([plan.source, plan.keys, plan.parts])
    rows = store.read(source, held)
    base = int((entry or {}).get("properties", {}).get(BASE, -1))
    if entry is not None and not full_refresh and base == held["version"] and entry["properties"].get(KIND) == kind:
        return "none", entry["version"]
    properties = {**(entry or {}).get("properties", {}), BASE: str(held["version"]), KIND: kind}
    logs = [store.history(source).entry(n).get("log") for n, _ in store.versions(source) if base < n <= held["version"]]
    whole = plan.whole(rows)
    kept = entry is not None and not full_refresh and entry["properties"].get(KIND) == kind and 0 < base < held["version"] and len(logs) == held["version"] - base and all(logs)
    if not kept or {(f.name, f.dataType) for f in whole.schema.fields} != {(f.name, f.dataType) for f in StructType.fromJson(entry["schema"]).fields}:
        load.counted = store.write(load, whole)
        store.describe(load, whole.schema, list(plan.keys))
        return "replace", store.publish(relation, load, whole.schema, properties, True, comment=model.description)
    kinds = dict(whole.dtypes)
    state = store.rows(relation, entry)
    deltas = plan.touched(store.changes(source, base, held["version"]))
    place = f"{store.root}/scratch/{load.token}-groups"
    try:
        plan.moved(state, deltas, kinds).write.parquet(place)
        moved = engine.spark.read.parquet(place)
        again = moved.filter("__again").select(*plan.keys)
        size = again.agg(F.sum(row_bytes(again))).first()[0]
        fine = moved.filter("not __again").select(*whole.columns, F.when(F.col(ROWS) <= 0, "delete").when(F.col("__there"), "update").otherwise("insert").alias(ACTION))
        fine = fine.filter(F.col(ACTION) != "insert").unionByName(fine.filter((F.col(ACTION) == "insert") & (F.col(ROWS) > 0)))
        if size:
            few = F.broadcast(again) if size <= BROADCAST_BYTES else again
            own = rows.alias("r").join(few.alias("a"), plan.on("r", "a"), "left_semi")
            fine = fine.unionByName(plan.whole(own).withColumn(ACTION, F.lit("update")))
        delta = write_delta(store, relation, entry, load, fine, list(plan.keys), ACTION)
        return "keep", store.publish(relation, load, StructType.fromJson(entry["schema"]), properties, False, comment=model.description, base=entry, folders=delta.folders, marks=delta.marks, marked=delta.marked)
    finally:
        store.discard(place)


def read_aggregate(engine: Engine, model: Model) -> DataFrame:
    """The groups as the model names them, without what only keeping them needs."""
    return engine.ref(model.name).select(*[F.col(f"`{c}`") for c in Plan.of(model).columns])
