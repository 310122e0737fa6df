"""Scripts: single statements, piped statements, blocks, concurrent statements and Python bodies."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomwright.functions.text import split_top_level, sql_tokens
from loomwright.operators.routines import run_python

_names = itertools.count(1)


def run_piped(spark: SparkSession, script: str) -> DataFrame | None:
    """Statements joined by `->>`: `$n` in one is the result of the n-th statement before it."""
    views: list[str] = []
    result: DataFrame | None = None
    for statement in split_top_level(script, "->>"):
        result = spark.sql(re.sub(r"\$(\d+)", lambda m: _earlier(views, int(m[1])), statement))
        view = f"__result_{next(_names)}"
        result.createOrReplaceTempView(view)
        views.append(view)
    return result


def _earlier(views: list[str], back: int) -> str:
    if not 1 <= back <= len(views):
        raise ValueError(f"${back}: there are {len(views)} results before this statement")
    return f"`{views[-back]}`"


def _first_word(sql: str) -> str:
    return next((t.lower() for _, t in sql_tokens(sql) if t.strip() and not t.startswith(("--", "/*"))), "")


def run_script(spark: SparkSession, script: str | Callable[[SparkSession], Any], language: str = "sql", handler: str | None = None, workers: int = 8) -> Any:
    """Run a script and return its last result.

    SQL: a `begin ... end` block runs as it is, in Spark's scripting language.  Otherwise statements are parted by
    semicolons; each may be piped; `async (statement)` starts one beside the others and `await all` waits for those begun,
    as the script's end does.  The first error among them is raised after all have ended.  Python: the text defines a handler,
    which gets the session; a callable is called with it.  An empty script returns None.
    """
    if callable(script):
        return script(spark)
    if language.lower() == "python":
        return run_python(script, handler)(spark)
    if language.lower() != "sql":
        raise ValueError(f"language {language} is not known")
    if _first_word(script) == "begin":
        return spark.sql(script.strip().rstrip(";"))
    result: Any = None
    running: list[Future] = []

    def await_all() -> None:
        done = list(running)
        running.clear()
        errors = [e for e in (f.exception() for f in done) if e]
        if errors:
            raise errors[0]

    with ThreadPoolExecutor(max_workers=workers) as pool:
        for statement in split_top_level(script, ";"):
            if re.fullmatch(r"(?is)await\s+all", statement):
                await_all()
            elif m := re.fullmatch(r"(?is)async\s*\((.*)\)", statement):
                running.append(pool.submit(run_piped, spark, m[1]))
            else:
                result = run_piped(spark, statement)
        await_all()
    return result
