"""What the plan says of a sliced query, held against the rows of its slices."""

import pytest
from pyspark.sql import functions as F

from loomwright.plans.engine import Engine
from loomwright.plans.model import Model
from loomwright.plans.safety import slice_safety

T, P = "{{source:s.t}}", "{{partition_filter}}"
CASES = [
    ("safe", f"select k, sum(v) as n from {T} where {P} group by k"),
    ("safe", f"select k, v from {T} where {P} and v > 3"),
    ("safe", f"select v + 1 as v from {T} where {P}"),
    ("safe", f"select k as a, w, count(*) as n from {T} where {P} group by w, k"),
    ("safe", f"with a as (select * from {T} where {P}), b as (select k, max(v) as m from a group by k) select a.k, a.v, b.m from a join b on a.k <=> b.k"),
    ("safe", f"select k, v, row_number() over (partition by k order by v, w) as r from {T} where {P}"),
    ("safe", f"select distinct k, w from {T} where {P}"),
    ("safe", f"select t.k, o.v from (select * from {T} where {P}) t left join {{{{source:s.o}}}} o on t.v = o.v"),
    ("safe", f"select k, v from {T} where {P} union all select k, w from {T} where {P}"),
    ("safe", f"select k, count(*) as n from (select k from {T} where {P} union all select k from {T} where {P}) group by k"),
    ("safe", f"select k from {T} where {P} except select k from {{{{source:s.o}}}}"),
    ("safe", f"select t.k, x from {T} t lateral view explode(array(v, w)) e as x where {P}"),
    ("unsafe", f"select w, count(*) as n from {T} where {P} group by w"),
    ("unsafe", f"select count(*) as n from {T} where {P}"),
    ("unsafe", f"select distinct w from {T} where {P}"),
    ("unsafe", f"select k, v, row_number() over (order by v) as r from {T} where {P}"),
    ("unsafe", f"select k, v from {T} where {P} limit 3"),
    ("unsafe", f"select a.k, b.v from (select * from {T} where {P}) a join (select * from {T} where {P}) b on a.w = b.w"),
    ("unsafe", f"select k from {T} where {P} union all select k from {{{{source:s.o}}}}"),
    ("unsafe", f"select o.v, t.k from {{{{source:s.o}}}} o left join (select * from {T} where {P}) t on t.v = o.v"),
    ("unsafe", f"select m, count(*) as n from (select k, max(v) as m from {T} where {P} group by k) group by m"),
    ("unknown", f"select v from {{{{source:s.o}}}} o where exists (select 1 from {T} t where t.v = o.v and {P})"),
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add_source("s", "t", lambda: spark.range(60).selectExpr("nullif(id % 5, 4) as k", "id % 7 as v", "id % 3 as w"))
    return e.add_source("s", "o", lambda: spark.range(9).selectExpr("id % 4 as k", "id as v"))


@pytest.mark.parametrize("said,sql", CASES)
def test_what_the_plan_says(engine, said, sql):
    by = {"from": "s.t", "columns": ["k"]}
    assert slice_safety(engine, Model("m", sql, config={"partition_by": by}))[0] == said
    if said == "unknown":
        return
    engine.add(Model("m", sql, config={"partition_by": by}), Model("whole", sql.replace(P, "true")))
    engine.run("m", "whole")
    same = sorted(map(str, engine.ref("m").collect())) == sorted(map(str, engine.ref("whole").collect()))
    assert same or said == "unsafe"
    assert not same or said == "safe" or "limit" in sql


def test_callables_and_composite_keys(engine):
    by = {"from": "s.t", "columns": ["k", "w"]}
    whole = lambda c: c.slice(c.source("s", "t")).groupBy("k", "w").agg(F.sum("v").alias("n"))
    part = lambda c: c.slice(c.source("s", "t")).groupBy("k").agg(F.sum("v").alias("n"))
    assert slice_safety(engine, Model("m", whole, config={"partition_by": by})) == ("safe", "")
    assert slice_safety(engine, Model("m", part, config={"partition_by": by})) == ("unsafe", "grouping without the slice's columns")
    with pytest.raises(ValueError, match="partition_by"):
        slice_safety(engine, Model("m", whole))


def test_only_proven_slices_are_loaded(engine):
    by = {"from": "s.t", "columns": ["k"], "prove": True}
    assert engine.add(Model("proven", CASES[0][1], config={"partition_by": by})).run("proven")["proven"].slices == 5
    with pytest.raises(ValueError, match="not proven"):
        engine.add(Model("refused", CASES[12][1], config={"partition_by": by})).run("refused")
    assert engine.relation_type("refused") is None
