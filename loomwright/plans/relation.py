"""Names of things that models build."""

from __future__ import annotations

from dataclasses import dataclass, replace

from loomwright.functions.text import qualified_identifier


@dataclass(frozen=True)
class Relation:
    """database.schema.identifier with the kind of thing it is."""

    identifier: str | None
    schema: str | None = None
    database: str | None = None
    type: str | None = None

    def normalize(self) -> Relation:
        """Unquoted parts in upper case, quoted ones as they are."""
        return replace(self, **{p: qualified_identifier(getattr(self, p)) for p in ("identifier", "schema", "database")})

    def with_suffix(self, suffix: str) -> Relation:
        """The suffix goes to the most specific part that is set, inside its quotes."""
        for part in ("identifier", "schema", "database"):
            name = getattr(self, part)
            if name is not None:
                quoted = len(name) >= 2 and name.startswith('"') and name.endswith('"')
                return replace(self, **{part: f'{name[:-1]}{suffix}"' if quoted else f"{name}{suffix}"})
        return self

    @property
    def bare(self) -> str:
        """The identifier as Spark's catalog stores it."""
        name = self.identifier or ""
        return name[1:-1] if len(name) >= 2 and name.startswith('"') and name.endswith('"') else name.lower()

    @property
    def sql(self) -> str:
        """The name in Spark SQL."""
        parts = [p for p in (self.schema, self.bare) if p]
        return ".".join(f"`{p.strip(chr(34)).replace('`', '``')}`" for p in parts)
