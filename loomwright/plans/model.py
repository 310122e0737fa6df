"""Models: what a user declares, and the context in which a body runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

from loomwright.functions.text import qualified_identifier
from loomwright.operators.partitioning import Slice, whole

if TYPE_CHECKING:
    from loomwright.plans.engine import Engine

#: Names that a body may use: {{ref:model}}, {{source:name.table}}, {{partition_filter}}.
Body = str | Callable[["Context"], DataFrame]


@dataclass
class Model:
    """A named unit of work.  `body` is SQL text or a callable that returns a DataFrame (a script's may return nothing)."""

    name: str
    body: Body
    materialized: str = "insert_overwrite"
    config: Mapping[str, Any] = field(default_factory=dict)
    description: str = ""
    columns: Mapping[str, str | None] = field(default_factory=dict)
    version: str | None = None
    latest_version: str | None = None
    package: str | None = None
    depends_on: Sequence[str] = ()
    #: Statements or callables by position: pre_outside, pre, post, post_outside (outside or inside the load).
    hooks: Mapping[str, Sequence[str | Callable[[Engine], Any]]] = field(default_factory=dict)

    def described(self) -> dict[str, str]:
        """{column: description} for the columns that have one, names in their normal spelling."""
        return {qualified_identifier(c): d for c, d in self.columns.items() if d is not None}


@dataclass
class Context:
    """What a body sees: the session, other tables, and the slice that is being loaded."""

    engine: Engine
    slice_: Slice = field(default_factory=whole)
    #: The number of the slice where the load's source lies by slice.
    number: int | None = None
    used_slot: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.engine.spark

    def ref(self, *names: str, version: str | None = None) -> DataFrame:
        return self.engine.ref(*names, version=version)

    def source(self, source: str, table: str) -> DataFrame:
        return self.engine.source(source, table)

    def slice(self, df: DataFrame) -> DataFrame:
        """The rows of df that belong to the slice: of the source as it was opened, what lies in the slice's folder."""
        self.used_slot = True
        own = None if self.number is None else self.engine.laid_out(df, self.number)
        return self.slice_.apply(df) if own is None else own
