"""The engine: holds models and sources, and builds models in the order of their references."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.functions.text import remove_select
from loomwright.operators import partitioning as parts
from loomwright.operators.grants import grant_delta, wanted_grants
from loomwright.operators.merge import write_delta
from loomwright.operators.routines import Routines, rows_frame, version_alias
from loomwright.operators.scripts import run_script
from loomwright.plans.aggregates import build_aggregate
from loomwright.plans.config import Ref, Source, table_config
from loomwright.plans.model import Context, Model
from loomwright.plans.relation import Relation
from loomwright.plans.safety import slice_safety
from loomwright.sources.journal import Journal
from loomwright.sources.store import META, ROWS, TRANSIENT, ConcurrentWrite, Load, TableStore, scratch_root

_SLOT = re.compile(r"\{\{\s*(?:(ref|source)\s*:\s*([\w.]+)|(partition_filter))\s*\}\}")
CATALOG = "name string, kind string, arguments string, language string, is_aggregate string, is_secure string, comment string, created bigint"


@dataclass
class Built:
    """What a run did: the relation, the verb of its definition, the slices loaded and warnings; scripts have a result."""

    relation: Relation
    verb: str
    slices: int = 0
    warnings: list[str] = field(default_factory=list)
    result: Any = None


def definition_verb(kind: str | None, full_refresh: bool, transient_then: bool, transient_now: bool, stored: Mapping | None, current: Mapping, columns_then: set | None, columns_now: set) -> str:
    """replace or keep.

    Replaced: what is absent, no table, refreshed in full, of another permanence, another configuration (unless none is
    stored), or other columns; their order does not count.
    """
    if kind != "table" or full_refresh or transient_then != transient_now:
        return "replace"
    if stored is not None and stored != current:
        return "replace"
    return "keep" if columns_then == columns_now else "replace"


def column_set(schema: StructType) -> set[tuple[str, str]]:
    return {(f.name.lower(), f.dataType.simpleString()) for f in schema.fields}


class Engine:
    """Models of one schema.

    Table files lie under `root`, which driver and executors must share on a cluster.  What is under a given root is
    kept: an engine that is opened later on the same root and schema finds the tables with their versions, the routines
    and the grants as they were left.  Policies are functions of the session and have to be given anew.  Without a root
    everything lies in a scratch folder that goes with the session.
    """

    #: Entries of the registry that are kept, and times that a load is made while other writers are first.
    REGISTRY_ENTRIES, ATTEMPTS = 10, 5

    def __init__(self, spark: SparkSession, root: str | None = None, schema: str | None = None):
        self.spark = spark
        self.schema = schema or f"loom_{uuid.uuid4().hex[:10]}"
        self.store = TableStore(spark, root or scratch_root(spark))
        spark.sql(f"create database if not exists `{self.schema}` location '{self.store.root}/_catalog/{self.schema}'")  # apart from the files, which go with a folder of the database
        self.routines = Routines(spark)
        self.models: dict[str, Model] = {}
        self.sources: dict[tuple[str, str], Callable[[], DataFrame]] = {}
        self.grants: dict[str, set[tuple[str, str]]] = {}
        self.policies: dict[str, Callable[..., Column]] = {}
        self.run_id = uuid.uuid4().hex
        self._frames: dict[tuple[str, str], DataFrame] = {}
        self._pins: dict[str, dict | None] = {}
        self._loading = False
        self._counting = threading.Lock()
        self._layout: parts.Layout | None = None
        self._layout_name, self._layout_frame, self._layout_null = "", None, False
        self._places: list[str] = []
        self._views: list[str] = []
        self._batches: parts.KeyBatches | None = None
        self._read: dict[str, DataFrame] = {}
        self._registry = Journal(spark, f"{self.store.root}/{self.schema}/_registry")
        self._remembered = self._registry.last() or {}
        self.store.open(self.schema)
        self.routines.restore(self._remembered.get("routines", []))
        self.grants |= {name: {tuple(p) for p in pairs} for name, pairs in self._remembered.get("grants", {}).items()}
        self.materializations: dict[str, Callable[[Model, bool], Built]] = {
            "insert_overwrite": self._overwrite, "table": self._overwrite, "merge_with_deletes": self._merge, "incremental_aggregate": self._aggregate, "function": partial(self._routine, "function"),
            "procedure": partial(self._routine, "procedure"), "script": self._script,
        }

    def remember(self) -> None:
        """Write routines and grants to the registry, if they have changed."""
        now = {"routines": self.routines.dump(), "grants": {n: sorted(map(list, pairs)) for n, pairs in sorted(self.grants.items())}}
        if now == {k: self._remembered.get(k) for k in now}:
            return
        numbers = [n for n, _ in self._registry.numbers()]
        self._registry.put((numbers[-1] if numbers else 0) + 1, now)
        self._remembered = json.loads(json.dumps(now))
        for old in numbers[: -self.REGISTRY_ENTRIES]:
            self._registry.drop(old)

    # -- declaration -----------------------------------------------------------------

    def add(self, *models: Model) -> Engine:
        for m in models:
            self.models[m.name.lower()] = m
        return self

    def add_source(self, source: str, table: str, place: str | Callable[[], DataFrame], format: str = "parquet", schema: str | None = None, **options: Any) -> Engine:
        """A path of a format that Spark reads, or a callable that returns the frame."""

        def read() -> DataFrame:
            reader = self.spark.read.format(format).options(**options)
            return (reader.schema(schema) if schema else reader).load(place)

        self.sources[(source.lower(), table.lower())] = place if callable(place) else read
        return self

    def materialization(self, name: str) -> Callable:
        """Register a function (engine, model, full_refresh) -> Built as a way to build models."""

        def register(f: Callable[[Engine, Model, bool], Built]) -> Callable:
            self.materializations[name] = partial(f, self)
            return f

        return register

    # -- lookup ----------------------------------------------------------------------

    def relation(self, name: str, kind: str | None = None) -> Relation:
        return Relation(name, self.schema, None, kind)

    def resolve(self, reference: Ref | Source) -> str:
        """The name that a reference stands for."""
        if isinstance(reference, Source):
            if (reference.source.lower(), reference.table.lower()) not in self.sources:
                raise KeyError(f"no source {reference.source}.{reference.table}")
            return f"{reference.source}.{reference.table}"
        return f"{self.schema}.{self._versioned(reference.model, reference.version)}"

    def _versioned(self, model: str, version: str | None) -> str:
        return f"{model}_v{version}".lower() if version is not None and f"{model}_v{version}".lower() in self.models else model.lower()

    def ref(self, *names: str, version: str | None = None) -> DataFrame:
        """A model's rows.  Within the load of one model every table is read as it was when the load began."""
        name = self._versioned(names[-1], version)
        if not self._loading:
            return self.store.read(self.relation(name))
        if name not in self._read:
            self._read[name] = self.store.read(self.relation(name), self._pin(name))
        return self._read[name]

    def _pin(self, name: str) -> dict | None:
        """The version of a table that this load reads; outside of a load the last one."""
        if not self._loading:
            return self.store.entry(self.relation(name))
        if name not in self._pins:
            self._pins[name] = self.store.entry(self.relation(name))
        return self._pins[name]

    def source(self, source: str, table: str) -> DataFrame:
        """A source's frame; within one model's run it is opened once, so that all slices see the same files."""
        key = (source.lower(), table.lower())
        if key not in self._frames:
            self._frames[key] = self.sources[key]()
        return self._frames[key]

    def read(self, name: str, role: str | None = None) -> DataFrame:
        """A table as a role may see it: its row access policy filters.  A help for co-operating users, no security border."""
        relation = self.relation(name)
        df = self.store.read(relation)
        policy = (self.store.metadata(relation) or {}).get("row_access_policy")
        if policy:
            if policy["policy"] not in self.policies:
                raise PermissionError(f"{name}: its policy {policy['policy']} is not known to this session")
            df = df.filter(self.policies[policy["policy"]](role, *[F.col(c) for c in policy["columns"]]))
        return df

    def append(self, name: str, df: DataFrame) -> list[str]:
        """Add rows to a model's table; new columns only where the model has enable_schema_evolution."""
        relation = self.relation(name)
        return self.store.append(relation, df, bool((self.store.metadata(relation) or {}).get("enable_schema_evolution")))

    def grouped(self, name: str, keys: list[str], *aggregates: Column) -> DataFrame:
        """An aggregate of a table; where an aggregation policy names entity keys, they may not be grouping keys."""
        policy = (self.store.metadata(self.relation(name)) or {}).get("aggregation_policy") or {}
        if shown := sorted(set(policy.get("entity_keys") or ()) & set(keys)):
            raise PermissionError(f"{name}: aggregates may not show {shown}")
        return self.store.read(self.relation(name)).groupBy(*keys).agg(*aggregates)

    def joined(self, name: str, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """A join with a table; where a join policy names allowed keys, the join must be on some of them only."""
        policy = (self.store.metadata(self.relation(name)) or {}).get("join_policy") or {}
        allowed = policy.get("allowed_join_keys")
        if policy and (not keys or (allowed and not set(keys) <= set(allowed))):
            raise PermissionError(f"{name}: joins must be on {allowed}")
        return self.store.read(self.relation(name)).join(other, keys, how)

    def catalog(self) -> DataFrame:
        """One row for each table, view, function and procedure."""
        held = [t for t in self.spark.catalog.listTables(self.schema) if not t.isTemporary and not t.name.endswith(ROWS)]
        rows = [{"name": t.name, "kind": "view" if "VIEW" in t.tableType and not self.store.entry(self.relation(t.name)) else "table", "comment": t.description} for t in held]
        return rows_frame(self.spark, [*rows, *self.routines.rows()], CATALOG)

    def relation_type(self, name: str) -> str | None:
        """table, view, function, procedure or None, by exact name."""
        return self.store.kind(self.relation(name)) or next((k for k in ("function", "procedure") if self.routines.overloads(k, name)), None)

    def columns_in_query(self, sql: str) -> list[str]:
        return self.spark.sql(self.render(sql)).columns

    def is_queryable(self, query: str | Relation) -> bool:
        """Whether a statement can be analysed and run, or a relation be read."""
        try:
            if isinstance(query, Relation):
                return self.store.kind(query) == "table" or bool(self.spark.table(query.sql).schema is not None)
            self.spark.sql(query).limit(0).collect()
        except (AnalysisException, ParseException):
            return False
        return True

    def drop_relation(self, name: str, unless_type: str | None = None, full_refresh: bool = False) -> str:
        """Drop what has the name unless it is of the given type; returns replace or keep."""
        kind = self.relation_type(name)
        if kind is None:
            return "replace"
        if kind == unless_type and not full_refresh:
            return "keep"
        if kind in ("table", "view"):
            self.store.drop(self.relation(name))
        else:
            self.routines.drop(kind, name)
            self.remember()
        return "replace"

    # -- bodies ----------------------------------------------------------------------

    def render(self, sql: str, condition: str = "true", number: int | None = None) -> str:
        """SQL with its references as names of tables and views, and its slots as the slice's condition.

        With the number of a slice the load's source is its layout, which has the slice as a column more.
        """

        def one(m: re.Match) -> str:
            if m[3]:
                return condition
            if m[1] == "ref":
                name = self._versioned(m[2].rpartition(".")[2], None)
                if number is not None and name == self._layout_name:
                    return self._layout_view()
                if not (self._loading and self._pin(name)):
                    return self.relation(name).sql
                view = f"__ref_{self.schema}_{name}"
                self.ref(name).createOrReplaceTempView(view)
                return f"`{view}`"
            if number is not None and m[2].lower() == self._layout_name:
                return self._layout_view()
            source, _, table = m[2].rpartition(".")
            view = f"__source_{self.schema}_{source}_{table}".lower()
            self.source(source, table).createOrReplaceTempView(view)
            return f"`{view}`"

        return _SLOT.sub(one, sql)

    def _layout_view(self) -> str:
        view = f"__slices_{self.schema}_{self._layout_name.replace('.', '_')}"
        with self._counting:
            if view not in self._views:
                self._layout.numbered().createOrReplaceTempView(view)
                self._views.append(view)
        return f"`{view}`"

    def frame(self, model: Model, slice_: parts.Slice | None = None, number: int | None = None) -> DataFrame:
        """The model's query, whole or for one slice; with its number also from the slice's own folder."""
        if isinstance(model.body, str):
            if number is not None and self._layout and self._layout_serves(model.body):
                try:
                    return self.spark.sql(self.render(model.body, self._slice_condition(number), number)).drop(parts.SLICE, parts.FOLDER)
                except AnalysisException:  # the slot stands where the source is not, or the extra column does not fit
                    pass
            return self.spark.sql(self.render(model.body, slice_.condition if slice_ else "true"))
        context = Context(self, slice_ or parts.whole(), number)
        df = model.body(context)
        if slice_ is not None and not context.used_slot:
            raise ValueError(f"{model.name}: partition_by is set, but the body does not slice its sources")
        return df

    def _slice_condition(self, number: int) -> str:
        """A row's slice is the number; rows without one, of outer joins, go where null keys go, if null is a key."""
        return self._layout.condition(number, self._layout_null and number == self._layout.count - 1)

    def _layout_serves(self, sql: str) -> bool:
        """Whether the query reads the load's source alone, and passes no star to a function but count.

        Only then does a condition on the number of the slice mean the same as one on its columns.
        """
        read = {self._slot_name(m) for m in _SLOT.finditer(sql) if not m[3]}
        starred = re.sub(r"count\s*\(\s*\*\s*\)", "", sql, flags=re.I)
        return read == {self._layout_name} and not re.search(r"\(\s*(?:[\w`]+\s*\.\s*)?\*|,\s*(?:[\w`]+\s*\.\s*)?\*\s*\)", starred)

    def _slot_name(self, m: re.Match) -> str:
        return self._versioned(m[2].rpartition(".")[2], None) if m[1] == "ref" else m[2].lower()

    def laid_out(self, df: DataFrame, number: int) -> DataFrame | None:
        """The rows of a slice where `df` is the load's source as it was opened; else none."""
        return self._layout.open(number) if self._layout and df is self._layout_frame else None

    def _slices(self, model: Model, by: parts.PartitionBy) -> Sequence[parts.Slice]:
        """The model's slices; one whole slice when a range split finds fewer than two values."""
        if isinstance(model.body, str) and not any(m[3] for m in _SLOT.finditer(model.body)):
            raise ValueError(f"{model.name}: partition_by is set, but the query has no partition_filter")
        name, known = by.source.lower(), True
        if name in self.models:
            name = self._versioned(name, None)
            keys_from = self.ref(name)
        elif tuple(name.split(".")) in self.sources:
            keys_from = self.source(*name.split("."))
        else:  # a CTE of the model's own query
            known = False
            keys_from = self.spark.sql(self.render(f"{remove_select(model.body)} select * from {by.source}"))
        if len(by.columns) == 1 and (by.partitions or 0) > 1:
            values, with_null = parts.sample_values(keys_from, by.columns[0], parts.SAMPLES_PER_RANGE * by.partitions)
            if len(values) < 2:
                return [parts.whole()]
            bounds = parts.range_bounds(values, by.partitions)
            if known and (by.sorted_copy if by.sorted_copy is not None else parts.worth_a_copy(keys_from, len(bounds) + 1)):
                self._lay_out(name, keys_from, parts.slice_of_range(by.columns[0], bounds, with_null), by.columns, len(bounds) + 1, with_null)
            return parts.range_slices(by.columns[0], bounds, with_null)
        seed = None if by.partitions else self.run_id
        keys = parts.numbered_keys(keys_from, by.columns, self._scratch("keys"), seed)
        batches = self._batches = parts.KeyBatches(keys, by.columns, by.partitions or 1, self._scratch("keys"), f"__keys_{model.name}_{uuid.uuid4().hex[:8]}")
        if known and batches.count > 1 and by.sorted_copy is not False:
            self._lay_out(name, keys_from, batches, by.columns, batches.count, False)
        return batches.slices()

    def _scratch(self, what: str) -> str:
        """A path that goes when the model's run ends."""
        self._places.append(f"{self.store.root}/{what}/{uuid.uuid4().hex}")
        return self._places[-1]

    def _lay_out(self, name: str, df: DataFrame, number: Any, columns: Sequence[str], count: int, with_null: bool) -> None:
        """Write the load's source by slice.  What reads it without a slice still reads it as it was."""
        self._layout = parts.Layout(df, number, columns, count, self._scratch("slices"))
        self._layout_name, self._layout_frame, self._layout_null = name, df, with_null

    # -- runs ------------------------------------------------------------------------

    def order(self, names: Iterable[str] | None = None) -> list[str]:
        """Models after those that they refer to; ValueError on a circle."""
        wanted = [n.lower() for n in names] if names else list(self.models)
        out: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in path:
                raise ValueError(f"models refer to each other in a circle: {' -> '.join([*path, name])}")
            path.append(name)
            for other in self.dependencies(self.models[name]):
                if other in wanted and other != name:
                    visit(other)
            path.pop()
            out.append(name)

        for n in wanted:
            visit(n)
        return out

    def dependencies(self, model: Model) -> list[str]:
        found = [d.lower() for d in model.depends_on]
        if model.materialized == "incremental_aggregate":
            found.append(str(model.body).strip().lower())
        elif isinstance(model.body, str):
            found += [m[2].rpartition(".")[2].lower() for m in _SLOT.finditer(model.body) if m[1] == "ref"]
        by = model.config.get("partition_by")
        if isinstance(by, Mapping) and str(by.get("from", "")).lower() in self.models:
            found.append(str(by["from"]).lower())
        return [d for d in dict.fromkeys(found) if d in self.models]

    def run(self, *names: str, full_refresh: bool = False) -> dict[str, Built]:
        """Build the named models, or all, in order; hooks run around each."""
        out = {}
        for name in self.order(names):
            model = self.models[name]
            self._frames.clear()
            self.spark.sparkContext.setJobDescription(f"{model.materialized} {model.name}")
            try:
                for when in ("pre_outside", "pre"):
                    self._hooks(model, when)
                out[name] = self._load(model, full_refresh)
                for when in ("post", "post_outside"):
                    self._hooks(model, when)
            finally:
                self.spark.sparkContext.setJobDescription(None)
                self._frames.clear()
                while self._places:
                    self.store.discard(self._places.pop())
            if model.materialized != "script":
                self._finish(model, out[name])
        return out

    def _load(self, model: Model, full_refresh: bool) -> Built:
        """Build one model; a table's body, all its slices and its retries apart, reads the versions of this moment."""
        self._loading = model.materialized in ("insert_overwrite", "table", "merge_with_deletes", "incremental_aggregate")
        try:
            for name in self.dependencies(model) if self._loading else ():
                self._pin(name)
            return self.materializations[model.materialized](model, full_refresh)
        finally:
            self._loading, self._layout, self._layout_frame = False, None, None
            self._pins.clear()
            self._read.clear()
            while self._views:
                self.spark.catalog.dropTempView(self._views.pop())
            if self._batches:
                for view in self._batches.views:
                    self.spark.catalog.dropTempView(view)
                self._batches = None

    def _hooks(self, model: Model, when: str) -> None:
        for hook in model.hooks.get(when, ()):
            hook(self) if callable(hook) else self.spark.sql(self.render(hook))

    def _finish(self, model: Model, built: Built) -> None:
        """Grants and descriptions, once the load is published."""
        name = model.name.lower()
        kept = built.verb != "replace" or bool(model.config.get("copy_grants"))
        current = self.grants.get(name, set()) if kept else set()
        self.grants[name] = current
        if "grants" in model.config:
            wanted = wanted_grants(model.config["grants"])
            built.result = built.result or grant_delta(wanted, current)
            self.grants[name] = wanted
        self.remember()
        if built.relation.type == "table" and (model.description or model.columns):
            columns = {c.lower() for c in self.ref(name).columns}
            self.store.comment(built.relation, model.description, {c.strip('"').lower(): d for c, d in model.described().items() if c.strip('"').lower() in columns})

    def _publish(self, model: Model, relation: Relation, load: Load, schema: StructType, verb: str, **more: Any) -> None:
        config = table_config(model.config)
        properties = {META: json.dumps(config.fingerprint, sort_keys=True), TRANSIENT: str(config.transient).lower()}
        properties |= {f"tag.{t['tag']}": str(t["value"]) for t in config.fingerprint.get("tags", ())}
        properties |= {f"contact.{k}": str(v) for k, v in config.fingerprint.get("contacts", {}).items()}
        columns = {c.lower() for c in schema.names}
        described = {c.strip('"').lower(): d for c, d in model.described().items() if c.strip('"').lower() in columns}
        self.store.publish(relation, load, schema, properties, verb == "replace", config.fingerprint.get("default_ddl_collation"), model.description, described, **more)
        self.store.prune(relation, config.fingerprint.get("data_retention_time_in_days"), config.transient)
        self.store.sweep(relation)

    def _verb(self, model: Model, relation: Relation, schema: StructType, full_refresh: bool) -> str:
        config = table_config(model.config)
        kind = self.relation_type(model.name)
        if kind not in (None, "table"):
            self.drop_relation(model.name)
        if kind != "table":
            return "replace"
        properties = self.store.properties(relation)
        stored = json.loads(properties[META]) if META in properties else None
        current = json.loads(json.dumps(config.fingerprint))
        held = StructType.fromJson(self.store.entry(relation)["schema"]) if self.store.entry(relation) else self.spark.table(relation.sql).schema
        return definition_verb(kind, full_refresh, properties.get(TRANSIENT) == "true", config.transient, stored, current, column_set(held), column_set(schema))

    def _write(self, load: Load, df: DataFrame, cluster_by: list[str] | None, part: str = "slice_0") -> None:
        if cluster_by:
            df = df.repartitionByRange(*[F.expr(c) for c in cluster_by]).sortWithinPartitions(*[F.expr(c) for c in cluster_by])
        added = self.store.write(load, df, part)
        with self._counting:
            load.counted = load.counted.plus(added)

    def _again(self, model: Model, full_refresh: bool, build: Callable[[Model, bool, Load], Built]) -> Built:
        """Build, and build anew if another writer was first; a load that fails takes its own files with it."""
        for attempt in range(self.ATTEMPTS):
            load = self.store.stage(self.relation(model.name, "table"))
            try:
                return build(model, full_refresh, load)
            except ConcurrentWrite:
                self.store.discard(load)
                if attempt + 1 == self.ATTEMPTS:
                    raise
                self._frames.clear()
                self._pins.clear()
                self._read.clear()
                self._layout = self._layout_frame = None
            except Exception:
                self.store.discard(load)
                raise
        raise AssertionError("no attempt was made")

    def _overwrite(self, model: Model, full_refresh: bool) -> Built:
        return self._again(model, full_refresh, self._overwrite_once)

    def _overwrite_once(self, model: Model, full_refresh: bool, load: Load) -> Built:
        relation = self.relation(model.name, "table")
        config = table_config(model.config)
        by, warnings = parts.partition_config(model.config.get("partition_by"))
        if by and by.prove and (told := slice_safety(self, model))[0] != "safe":
            raise ValueError(f"{model.name}: its slices are not proven to be the whole query: {': '.join(told)}")
        slices = self._slices(model, by) if by else [None]
        plain = len(slices) == 1
        schema = self.frame(model, slices[0] if len(slices) else None).schema if by else self.frame(model).schema
        verb = self._verb(model, relation, schema, full_refresh)
        names = schema.names

        def one(i: int) -> None:
            self._write(load, self.frame(model, slices[i], i if self._layout else None).select(*[f"`{n}`" for n in names]), config.fingerprint.get("cluster_by"), f"slice_{i}")

        order = parts.spread_order(len(slices), self.run_id) if by and by.concurrent else list(range(len(slices)))
        if not len(slices):
            self._write(load, self.spark.createDataFrame([], schema), None)
        parts.run_slices(self.spark, [partial(one, i) for i in order], bool(by and by.concurrent and not plain))
        if by and by.validate:
            self._validate(model, load.path, schema)
        self.store.describe(load, schema, config.fingerprint.get("cluster_by", []))
        own = self._pins.get(relation.bare)
        before = own or (self.store.entry(relation) if config.fingerprint.get("change_tracking") else None)
        log = self.store.log_overwrite(relation, load, before, schema) if before and verb == "keep" and config.fingerprint.get("change_tracking") else None
        self._publish(model, relation, load, schema, verb, log=log, base=before if own or log else None)
        return Built(relation, verb, len(slices), [*config.warnings, *warnings])

    def _validate(self, model: Model, path: str, schema: StructType) -> None:
        """ValueError unless the slices together hold the rows of the whole query: no group, window or join crossed a slice."""
        sliced = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        whole = self.frame(model, parts.whole()).select(*[f"`{n}`" for n in schema.names])
        if content_hash(sliced).first() != content_hash(whole).first():
            raise ValueError(f"{model.name}: the slices together are not the whole query's rows")

    def _merge(self, model: Model, full_refresh: bool) -> Built:
        """The first load, and a full refresh, take the query as it is; later ones merge it as changes."""
        return self._again(model, full_refresh, self._merge_once)

    def _merge_once(self, model: Model, full_refresh: bool, load: Load) -> Built:
        relation = self.relation(model.name, "table")
        entry = self._pin(relation.bare)
        changes = self.frame(model)
        if full_refresh or not entry:
            if self.relation_type(model.name) not in (None, "table"):
                self.drop_relation(model.name)
            config, keys = table_config(model.config), model.config.get("unique_key") or []
            self._write(load, changes, config.fingerprint.get("cluster_by"))
            self.store.describe(load, changes.schema, config.fingerprint.get("cluster_by") or ([keys] if isinstance(keys, str) else list(keys)))
            self._publish(model, relation, load, changes.schema, "replace")
            return Built(relation, "replace", 1)
        tracked = bool(table_config(model.config).fingerprint.get("change_tracking"))
        delta = write_delta(self.store, relation, entry, load, changes, model.config["unique_key"], model.config["merge_action"], model.config.get("incremental_predicates", ()), tracked)
        self._publish(model, relation, load, StructType.fromJson(entry["schema"]), "keep", base=entry, folders=delta.folders, marks=delta.marks, marked=delta.marked, log=delta.log)
        return Built(relation, "keep", 1)

    def _aggregate(self, model: Model, full_refresh: bool) -> Built:
        def once(model: Model, full_refresh: bool, load: Load) -> Built:
            if self.relation_type(model.name) not in (None, "table"):
                self.drop_relation(model.name)
            verb, _ = build_aggregate(self, model, full_refresh, load)
            return Built(self.relation(model.name, "table"), verb, 1)

        return self._again(model, full_refresh, once)

    def _routine(self, kind: str, model: Model, full_refresh: bool) -> Built:
        if self.relation_type(model.name) not in (None, kind):
            self.drop_relation(model.name)
        body = self.render(model.body) if isinstance(model.body, str) else model.body
        if model.config.get("sql_header"):
            self.spark.sql(self.render(model.config["sql_header"]))
        routine, verb = self.routines.define(kind, model.name, model.config, body, full_refresh=full_refresh, resolve=self.resolve, comment=model.description)
        wanted = model.config.get("overload_version")
        if wanted is True:
            wanted = model.latest_version
        if wanted is not None and wanted is not False and str(wanted) != str(model.version):
            self.routines.define(kind, version_alias(model.name, model.version, str(wanted)), model.config, body, full_refresh=full_refresh, resolve=self.resolve, comment=model.description)
        return Built(self.relation(model.name, kind), verb, result=routine)

    def _script(self, model: Model, full_refresh: bool) -> Built:
        """Drop the script's target unless it is of the wanted type, or if `drop_if` finds rows in the catalog; then run."""
        kind = model.config.get("script_materialization")
        verb = "keep"
        if kind:
            verb = self.drop_relation(model.name, kind, full_refresh)
            if model.config.get("drop_if") and self.relation_type(model.name):
                view = f"__catalog_{self.schema}"
                self.catalog().filter(F.col("name") == model.name.lower()).createOrReplaceTempView(view)
                if not self.spark.sql(model.config["drop_if"].replace("$1", f"`{view}`")).isEmpty():
                    verb = self.drop_relation(model.name)
        body = self.render(model.body) if isinstance(model.body, str) else partial(model.body, Context(self))
        result = run_script(self.spark, (lambda _: body()) if callable(body) else body, model.config.get("language", "sql"), model.config.get("handler"))
        return Built(self.relation(model.name, kind if kind in ("table", "view") else None), verb, result=result)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): the number of rows and an order-free hash of a multiset of rows."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("hash"))

