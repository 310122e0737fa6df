"""Configuration values that are rendered late: references, and containers with a spelling of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from loomwright.functions.text import escape_text


@dataclass(frozen=True)
class Ref:
    """Another model, with a version; `file` names a file beside it, `text` asks for a quoted string."""

    model: str
    package: str | None = None
    version: str | None = None
    file: str | None = None
    text: bool = False


@dataclass(frozen=True)
class Source:
    source: str
    table: str
    file: str | None = None
    text: bool = False


@dataclass(frozen=True)
class Tagged:
    """A container with its spelling: dict, list, set, tuple, iterator, or a string to be quoted."""

    kind: str
    value: Any


def config_ref(*names: str, v: Any = None, version: Any = None, file: str | None = None, string: bool = False) -> Ref:
    """(model) or (package, model)."""
    if len(names) not in (1, 2):
        raise ValueError("a reference has a model, or a package and a model")
    found = version if version is not None else v
    return Ref(names[-1], names[0] if len(names) == 2 else None, None if found is None else str(found), file, string)


def config_source(source: str, table: str, file: str | None = None, string: bool = False) -> Source:
    return Source(source, table, file, string)


def config_dict(value: Mapping) -> Tagged:
    return Tagged("dict", value)


def config_list(value: Iterable) -> Tagged:
    return Tagged("list", list(value))


def config_set(value: Iterable) -> Tagged:
    return Tagged("set", list(value))


def config_tuple(value: Iterable) -> Tagged:
    return Tagged("tuple", list(value))


def config_iterator(value: Iterable) -> Tagged:
    return Tagged("iterator", list(value))


def config_string(value: Any) -> Tagged:
    return Tagged("string", value)


def config_recursive(*values: Any) -> list:
    """Each value with its containers tagged by their Python type, at every depth."""

    def tag(value: Any) -> Any:
        if isinstance(value, Mapping):
            return Tagged("dict", {k: tag(v) for k, v in value.items()})
        for kind, types in (("list", list), ("set", set | frozenset), ("tuple", tuple)):
            if isinstance(value, types):
                return Tagged(kind, [tag(v) for v in (sorted(value, key=str) if kind == "set" else value)])
        if isinstance(value, Iterable) and not isinstance(value, str | bytes):
            return Tagged("iterator", [tag(v) for v in value])
        return value

    return [tag(v) for v in values]


def by_key(mapping: Mapping) -> list[tuple[Any, Any]]:
    """Entries by key, without regard to case."""
    return sorted(mapping.items(), key=lambda kv: str(kv[0]).lower())


def compile_config(value: Any, resolve: Callable[[Ref | Source], str] = lambda r: getattr(r, "model", None) or f"{r.source}.{r.table}", quote: bool | None = False) -> str:
    """A configuration value as text.

    Scalars are quoted if `quote`, or for strings if quote is None.  Lists become [a, b]; tagged containers take their own
    brackets, iterators none; a plain mapping becomes `k = v` pairs by key; references become names, `/file` appended.
    """
    deep = lambda v, q: compile_config(v, resolve, q)
    if isinstance(value, Ref | Source):
        name = resolve(value) + (f"/{value.file}" if value.file else "")
        return f"'{escape_text(name)}'" if value.text or quote else name
    if isinstance(value, Tagged):
        if value.kind == "string":
            return f"'{escape_text(deep(value.value, False))}'"
        if value.kind == "dict":
            return "{" + ", ".join(f"'{escape_text(k)}': {deep(v, None)}" for k, v in by_key(value.value)) + "}"
        left, right = {"list": "[]", "set": "{}", "tuple": "()"}.get(value.kind, ("", ""))
        return left + ", ".join(deep(v, None if quote is False and value.kind != "iterator" else quote) for v in value.value) + right
    if isinstance(value, Mapping):
        return ", ".join(f"{k} = {deep(v, quote)}" for k, v in by_key(value))
    if isinstance(value, Iterable) and not isinstance(value, str | bytes):
        return "[" + ", ".join(deep(v, quote) for v in value) + "]"
    if isinstance(value, bool):
        value = str(value).lower()
        return f"'{value}'" if quote else value
    return f"'{escape_text(value)}'" if quote or (quote is None and isinstance(value, str)) else str(value)


#: Configuration of a table: name -> check of its value.
_CHECKS: dict[str, Callable[[Any], bool]] = {
    "cluster_by": lambda v: isinstance(v, str) or (isinstance(v, list) and all(isinstance(x, str) for x in v)),
    "enable_schema_evolution": lambda v: isinstance(v, bool),
    "data_retention_time_in_days": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0,
    "max_data_extension_time_in_days": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0,
    "change_tracking": lambda v: isinstance(v, bool),
    "default_ddl_collation": lambda v: isinstance(v, str),
    "row_access_policy": lambda v: isinstance(v, Mapping) and {"policy", "columns"} <= set(v),
    "aggregation_policy": lambda v: isinstance(v, Mapping) and "policy" in v,
    "join_policy": lambda v: isinstance(v, Mapping) and "policy" in v,
    "tags": lambda v: isinstance(v, list),
    "contacts": lambda v: isinstance(v, Mapping),
}


@dataclass(frozen=True)
class TableConfig:
    """Checked configuration of a table; `fingerprint` is what a later run compares."""

    fingerprint: dict[str, Any]
    transient: bool
    copy_grants: bool
    warnings: tuple[str, ...]


def table_config(config: Mapping[str, Any]) -> TableConfig:
    """Invalid values are dropped with a warning; malformed tags silently; a text `cluster_by` is a list of one."""
    found: dict[str, Any] = {}
    warnings = []
    aliases = {"default_DDL_collation": "default_ddl_collation"}
    given = {aliases.get(k, k): v for k, v in config.items()}
    for name, check in _CHECKS.items():
        value = given.get(name)
        if value is None:
            continue
        if not check(value):
            warnings.append(f"{name}: invalid value {value!r} is ignored")
            continue
        if name == "cluster_by":
            value = [value] if isinstance(value, str) else value
        if name == "tags":
            value = [dict(t) for t in value if isinstance(t, Mapping) and {"tag", "value"} <= set(t)]
        found[name] = value
    if given.get("tmp_relation_type") not in (None, "table", "view"):
        warnings.append(f"tmp_relation_type: {given['tmp_relation_type']!r} is ignored")
    return TableConfig(found, bool(given.get("transient", False)), bool(given.get("copy_grants", False)), tuple(warnings))
