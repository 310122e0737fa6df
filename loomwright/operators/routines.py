"""Functions and procedures as models: registered from text, rebuilt only when their definition changes.

Scalar and table functions in SQL become Spark SQL functions, which the optimizer inlines; those in Python become Arrow
UDFs, grouped-aggregate pandas UDFs or table functions.  Spark has one function a name, so overloads register under a
second name that carries their signature, and `call` picks by the number and, where a frame is given, the types of the
arguments.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import pickle
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomwright.functions.collections import is_non_string_iterable, join_strings
from loomwright.plans.config import compile_config

_clock = itertools.count(1)
#: Errors that say that something else has the name.
CLASHES = ("ALREADY_EXISTS", "ROUTINE", "DUPLICATE")
#: Groups whose states a task of a two-step aggregate keeps at a time.
AGGREGATE_GROUPS = 100_000
#: Numbers from narrow to wide.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def clauses(config: Any, resolve: Callable | None = None) -> tuple[list[str], dict[str, str]]:
    """Compiled clause lines, and the `key = value` and `key value` ones by lower-case key.  A mapping is one group."""
    items = [] if config is None else [config] if isinstance(config, str | Mapping) or not is_non_string_iterable(config) else list(config)
    args = (resolve,) if resolve else ()
    lines, known = [], {}
    for item in items:
        text = compile_config(item, *args)
        lines.append(text)
        if isinstance(item, Mapping):
            known |= {str(k).lower(): compile_config(v, *args).strip("'") for k, v in item.items()}
        elif m := re.fullmatch(r"\s*(\w+)\s*(?:=\s*|\s+)'?(.*?)'?\s*", text):
            known[m[1].lower()] = m[2]
    return lines, known


def parameters(config: Any) -> list[tuple[str, str]]:
    """(name, type) of each parameter from `a int, b decimal(3, 1)` or a list of such."""
    text = join_strings(config) if config else ""
    out, depth, start = [], 0, 0
    for i, c in enumerate(f"{text},"):
        depth += {"(": 1, "<": 1, ")": -1, ">": -1}.get(c, 0)
        if c == "," and depth == 0:
            if part := text[start:i].strip():
                name, _, kind = part.partition(" ")
                out.append((name, spark_type(kind.strip())))
            start = i + 1
    return out


def spark_type(name: str) -> str:
    """A type's name in Spark SQL; integers are 64 bits wide, text has no length."""
    plain = name.strip().lower()
    known = {"int": "bigint", "integer": "bigint", "number": "bigint", "float": "double", "varchar": "string", "text": "string", "array": "array<string>", "variant": "variant"}
    return known.get(re.sub(r"\(.*\)$", "", plain) if plain.startswith(("varchar", "text")) else plain, plain)


def widens(given: str, wanted: str) -> bool:
    """Whether a type is another one or a narrower number."""
    if given == wanted or given == "void":
        return True
    return given in NUMBERS and wanted in NUMBERS and NUMBERS.index(given) <= NUMBERS.index(wanted)


def table_columns(returns: str) -> str | None:
    """The column list of a `table(...)` return type in Spark's types; None for scalar types."""
    if m := re.fullmatch(r"(?is)\s*table\s*\((.*)\)\s*", returns):
        return ", ".join(f"{n} {t}" for n, t in parameters(m[1]))
    return None


def fingerprint(**parts: Any) -> dict[str, str]:
    """A digest of every part of a definition."""
    return {k: hashlib.md5(json.dumps(v, sort_keys=True, default=str).encode()).hexdigest() for k, v in parts.items()}


def definition_verb(stored: Mapping | None, current: Mapping, secure_then: bool | None, secure_now: bool) -> str:
    """replace, alter or keep: another definition replaces, another secrecy alters, nothing new keeps."""
    if stored is None or stored != current:
        return "replace"
    return "alter" if secure_then != secure_now else "keep"


def version_alias(name: str, current: str | None, wanted: str) -> str:
    """The name under which another version is reached: `f_v2` for version 1 is `f_v1`, for 0 it is `f`; `f` for 3 is `f_v3`."""
    quote = '"' if name.endswith('"') else ""
    base = name.removesuffix('"')
    if current and re.search(rf"(?i)_v{re.escape(str(current))}$", base):
        base = base[: len(base) - len(str(current))]
    else:
        base = f"{base}_v"
    return (base[:-2] if str(wanted) == "0" else f"{base}{wanted}") + quote


@dataclass
class Routine:
    kind: str
    name: str
    params: list[tuple[str, str]]
    returns: str
    body: str
    language: str
    handler: str | None = None
    aggregate: bool = False
    secure: bool = False
    lines: list[str] = field(default_factory=list)
    stored: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    created: int = 0

    @property
    def signature(self) -> str:
        return f"({', '.join(t for _, t in self.params)})"

    @property
    def mangled(self) -> str:
        return f"{self.name}__{hashlib.md5(self.signature.encode()).hexdigest()[:8]}"

    def row(self) -> dict[str, Any]:
        """What the catalog shows; a secure routine's body is not shown."""
        return {
            "name": self.name, "kind": self.kind, "arguments": f"{self.name}{self.signature} RETURN {self.returns}", "language": self.language, "is_aggregate": "Y" if self.aggregate else "N",
            "is_secure": "Y" if self.secure else "N", "comment": self.comment, "body": None if self.secure else self.body, "created": self.created,
        }


class Routines:
    """The registry of functions and procedures of an engine."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[tuple[str, str, str], Routine] = {}

    def overloads(self, kind: str, name: str) -> list[Routine]:
        return [r for (k, n, _), r in self.known.items() if k == kind and n == name.lower()]

    def rows(self, kind: str | None = None) -> list[dict[str, Any]]:
        return [r.row() for r in self.known.values() if kind in (None, r.kind)]

    def dump(self) -> list[dict[str, Any]]:
        """The routines as plain values, oldest first."""
        return [asdict(r) | {"params": [list(p) for p in r.params]} for r in sorted(self.known.values(), key=lambda r: r.created)]

    def restore(self, rows: Sequence[Mapping[str, Any]]) -> None:
        """Define again what dump() gave, in its order, as far as Spark has it not."""
        for row in rows:
            r = Routine(**{**row, "params": [tuple(p) for p in row["params"]]})
            self._register(r)
            self.known[(r.kind, r.name, r.signature)] = r
        global _clock
        _clock = itertools.count(max([next(_clock), *(r.created + 1 for r in self.known.values())]))

    def define(self, kind: str, name: str, config: Mapping[str, Any], body: str, *, full_refresh: bool = False, resolve: Callable | None = None, comment: str = "") -> tuple[Routine, str]:
        """Create, replace, alter or keep a routine; returns it and what was done."""
        if not config.get("returns"):
            raise ValueError(f"{kind} {name}: `returns` is needed")
        lines, known = clauses(config.get(f"{kind}_config") or config.get("function_config"), resolve)
        routine = Routine(
            kind, name.lower(), parameters(config.get("parameters")), str(config["returns"]), body, known.get("language", "sql").lower(), known.get("handler"), bool(config.get("aggregate")) and kind == "function",
            bool(config.get("secure")), lines, comment=comment,
        )
        routine.stored = fingerprint(parameters=routine.params, returns=routine.returns, config=lines, body=body, aggregate=routine.aggregate)
        key = (kind, routine.name, routine.signature)
        old = self.known.get(key)
        verb = "replace" if full_refresh else definition_verb(old.stored if old else None, routine.stored, old.secure if old else None, routine.secure)
        if verb == "replace":
            try:
                self._register(routine)
            except AnalysisException as error:
                if not any(word in (error.getCondition() or "") for word in CLASHES):
                    raise
                self._register_alone(routine)
            routine.created = next(_clock)
            self.known[key] = routine
        elif verb == "alter":
            old.secure = routine.secure
        return self.known[key], verb

    def _register_alone(self, routine: Routine) -> None:
        """After a clash: drop all overloads of the name and try once more; what was there comes back if that fails, too."""
        before = sorted(self.overloads(routine.kind, routine.name), key=lambda r: r.created)
        for other in before:
            self.drop(other.kind, other.name, other.signature)
        try:
            self._register(routine)
        except Exception:
            for other in before:
                self._register(other)
                self.known[(other.kind, other.name, other.signature)] = other
            raise

    def drop(self, kind: str, name: str, signature: str | None = None) -> int:
        """Drop a routine's overload, or all of the name; returns how many went."""
        gone = [r for r in self.overloads(kind, name) if signature in (None, r.signature)]
        for r in gone:
            del self.known[(kind, r.name, r.signature)]
            if kind == "function":
                for n in (r.mangled, *([r.name] if not self.overloads(kind, r.name) else [])):
                    self.spark.sql(f"drop temporary function if exists `{n}`")
                if left := self.overloads(kind, r.name):  # the bare name goes back to the latest that is left
                    self._register_as(max(left, key=lambda x: x.created), r.name)
        return len(gone)

    # -- registration with Spark -----------------------------------------------------

    def _register(self, r: Routine) -> None:
        if r.language == "python":
            self._import(r)
        if r.kind == "procedure":
            if r.language == "python":
                _handler(r)
            return
        for name in (r.name, r.mangled):
            self._register_as(r, name)

    def _import(self, r: Routine) -> None:
        """Give the files of the `imports` clause to the workers: Python files and archives to import, others to open."""
        said = next((m[1] for x in r.lines if (m := re.search(r"(?is)\bimports\s*=?\s*[\[(]([^\])]*)[\])]", x))), "")
        for path in re.findall(r"[^\s,'\"]+", said):
            if path.endswith((".py", ".zip", ".egg")):
                self.spark.sparkContext.addPyFile(path)
            else:
                self.spark.sparkContext.addFile(path)

    def _register_as(self, r: Routine, name: str) -> None:
        args, columns = ", ".join(f"{n} {t}" for n, t in r.params), table_columns(r.returns)
        if r.language == "sql":
            returns = f"table({columns})" if columns else spark_type(r.returns)
            self.spark.sql(f"create or replace temporary function `{name}`({args}) returns {returns} return {r.body}")
        elif r.language != "python":
            raise ValueError(f"{r.name}: language {r.language} is not known")
        elif columns:
            self.spark.udtf.register(name, F.udtf(_table_class(_handler(r)), returnType=columns))
        elif r.aggregate:
            self.spark.udf.register(name, _aggregate(_handler(r), spark_type(r.returns)))
        else:
            self.spark.udf.register(name, F.udf(_handler(r), spark_type(r.returns), useArrow=True))

    def overload(self, kind: str, name: str, count: int, types: Sequence[str] | None = None) -> Routine:
        """The overload with `count` parameters; among several, the one with these types, or the one that they widen to.

        ValueError when none or several fit.
        """
        found = [r for r in self.overloads(kind, name) if len(r.params) == count]
        if len(found) > 1 and types is not None:
            exact = [r for r in found if [t for _, t in r.params] == list(types)]
            found = exact or [r for r in found if all(widens(a, b) for a, (_, b) in zip(types, r.params, strict=True))]
        if len(found) != 1:
            raise ValueError(f"{len(found)} {kind}s {name} take {count} arguments{f' of types {list(types)}' if types else ''}")
        return found[0]

    def call(self, name: str, *columns: Column | str, on: DataFrame | None = None) -> Column:
        """A scalar or aggregate function's column; `on` is the frame whose columns' types tell overloads of equal length apart."""
        types = [t for _, t in on.select(*[F.col(c) if isinstance(c, str) else c for c in columns]).dtypes] if on is not None else None
        return F.call_function(self.overload("function", name, len(columns), types).mangled, *columns)

    def aggregate(self, df: DataFrame, keys: Sequence[str], name: str, *columns: str, out: str = "result") -> DataFrame:
        """(keys, out): an aggregate function whose handler has accumulate, merge and finish, in two steps.

        Each task keeps one state for each group that it meets, at most AGGREGATE_GROUPS at a time, and only states are
        shuffled and merged; no group's rows come together in one task.  Other handlers belong into call().
        """
        r = self.overload("function", name, len(columns), [dict(df.dtypes)[c] for c in columns])
        body, handler_name, n = r.body, r.handler, len(keys)
        if not all(hasattr(_handler(r), m) for m in ("accumulate", "merge", "finish")):
            raise ValueError(f"{name}: the handler has no accumulate, merge and finish")
        schema = StructType([df.schema[k] for k in keys])

        def partial(batches):
            handler, states = run_python(body, handler_name), {}

            def flush() -> pd.DataFrame:
                rows = [(*key, cloudpickle.dumps(state)) for key, state in states.items()]
                states.clear()
                return pd.DataFrame(rows, columns=[*keys, "__state"])

            for batch in batches:
                for row in zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in [*keys, *columns]], strict=True):
                    state = states.get(row[:n])
                    if state is None:
                        if len(states) >= AGGREGATE_GROUPS:
                            yield flush()
                        state = states[row[:n]] = handler()
                    state.accumulate(*row[n:])
            yield flush()

        def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            state = run_python(body, handler_name)()
            for other in group["__state"]:
                state.merge(pickle.loads(other))
            return pd.DataFrame([(*key, state.finish())], columns=[*keys, out])

        states = df.select(*keys, *columns).mapInPandas(partial, StructType([*schema.fields, StructField("__state", BinaryType())]))
        result = StructType.fromDDL(f"`{out}` {spark_type(r.returns)}")
        return states.groupBy(*keys).applyInPandas(merged, StructType([*schema.fields, *result.fields]))

    def call_procedure(self, name: str, *args: Any) -> Any:
        """Run a procedure: SQL with its arguments bound by name gives a DataFrame, Python its handler's result."""
        kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
        r = self.overload("procedure", name, len(args), [kinds.get(type(a), "void") for a in args])
        if r.language == "python":
            return _handler(r)(self.spark, *args)
        return self.spark.sql(r.body, args={n: v for (n, _), v in zip(r.params, args, strict=True)} or None)


def run_python(body: str, handler: str | None) -> Any:
    """Run a body's text in a namespace of its own and return the handler that it defines."""
    space: dict[str, Any] = {}
    exec(compile(body, f"<{handler or 'body'}>", "exec"), space)  # noqa: S102  a model's body is its author's code
    name = (handler or "handler").rpartition(".")[2]
    if name not in space:
        raise ValueError(f"the body defines no handler {name}")
    return space[name]


def _handler(r: Routine) -> Any:
    return run_python(r.body, r.handler)


def _table_class(handler: Any) -> type:
    """A table function's class: the handler itself if it has eval, one with `process`, or a generator function."""
    if isinstance(handler, type):
        return handler if hasattr(handler, "eval") else type("Table", (), {"__init__": lambda self: setattr(self, "h", handler()), "eval": lambda self, *a: iter(self.h.process(*a))})
    return type("Table", (), {"eval": lambda self, *a: iter(handler(*a))})


def _aggregate(handler: Any, returns: str) -> Callable:
    """A grouped aggregate of a function over series, or of a class with accumulate and finish."""

    def run(*series: pd.Series) -> Any:
        if not isinstance(handler, type):
            return handler(*series)
        state = handler()
        for row in zip(*series, strict=True):
            state.accumulate(*row)
        return state.finish()

    run.__annotations__ = {}
    return F.pandas_udf(run, returns, F.PandasUDFType.GROUPED_AGG)


def rows_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: str | StructType) -> DataFrame:
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

