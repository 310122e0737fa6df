"""Grants of an object, kept by the engine: what to grant and what to revoke."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import qualified_identifier


def wanted_grants(config: Mapping[str, str | Iterable[str]]) -> set[tuple[str, str]]:
    """(grantee, privilege) of {privilege: roles}, both in their normal spelling."""
    out = set()
    for privilege, roles in config.items():
        for role in [roles] if isinstance(roles, str) else roles:
            out.add((qualified_identifier(role), privilege.lower()))
    return out


def grant_delta(wanted: set[tuple[str, str]], current: set[tuple[str, str]]) -> dict[str, dict[str, list[str]]]:
    """{grant: {grantee: privileges}, revoke: ...} that lead from the current grants to the wanted ones."""
    out: dict[str, dict[str, list[str]]] = {"grant": {}, "revoke": {}}
    for verb, pairs in (("grant", wanted - current), ("revoke", current - wanted)):
        for grantee, privilege in sorted(pairs):
            out[verb].setdefault(grantee, []).append(privilege)
    return out


def grants_delta_table(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """(grantee, privilege, verb) from two tables of (grantee, privilege): a full outer join of their distinct rows."""
    a, b = wanted.distinct().withColumn("w", F.lit(1)), current.distinct().withColumn("c", F.lit(1))
    joined = a.join(b, ["grantee", "privilege"], "full_outer")
    verb = F.when(F.col("c").isNull(), "grant").when(F.col("w").isNull(), "revoke")
    return joined.withColumn("verb", verb).filter("verb is not null").select("grantee", "privilege", "verb")
