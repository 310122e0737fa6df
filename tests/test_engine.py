"""The engine end to end: definitions, slices, merges, routines, scripts and failures."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomwright import queries
from loomwright.operators import partitioning as parts
from loomwright.operators.merge import AmbiguousMerge, merge_with_deletes
from loomwright.plans.engine import Engine, content_hash, definition_verb
from loomwright.plans.helpers import hierarchy
from loomwright.plans.model import Context, Model
from loomwright.sources.store import TableStore
from loomwright.streaming.merge_stream import stream_changes


@pytest.fixture
def engine(spark, sf_dir):
    e = Engine(spark)
    for t in ("orders", "nation", "region"):
        e.add_source("tpch", t, f"{sf_dir}/{t}.parquet")
    return e


def frame(spark, rows, schema="k long, v long"):
    return spark.createDataFrame(rows, schema)


def test_verbs():
    same = ({"a": 1}, {"a": 1}, {("x", "int")}, {("x", "int")})
    assert definition_verb("table", False, False, False, *same) == "keep"
    assert definition_verb(None, False, False, False, *same) == definition_verb("view", False, False, False, *same) == "replace"
    assert definition_verb("table", True, False, False, *same) == definition_verb("table", False, True, False, *same) == "replace"
    assert definition_verb("table", False, False, False, {"a": 2}, *same[1:]) == "replace"
    assert definition_verb("table", False, False, False, None, *same[1:]) == "keep"
    assert definition_verb("table", False, False, False, *same[:3], {("x", "string")}) == "replace"


def test_configuration_decides_the_verb(engine):
    def run(**config):
        engine.add(Model("t", "select n_nationkey, n_name from {{source:tpch.nation}}", config=config))
        return engine.run("t")["t"].verb

    assert [run(), run(), run(cluster_by=["n_name"]), run(cluster_by=["n_name"]), run(transient=True), run(transient=True)] == ["replace", "keep", "replace", "keep", "replace", "keep"]
    assert len(engine.store.versions(engine.relation("t"))) == 1
    assert engine.run("t", full_refresh=True)["t"].verb == "replace" and engine.ref("t").count() == 25


def test_failed_slice_leaves_the_table(engine):
    engine.add(Model("t", "select 1 as k")).run("t")

    def body(c: Context):
        return c.slice(c.source("tpch", "nation")).select(F.when(F.col("n_nationkey") > 20, F.raise_error(F.lit("stop"))).otherwise(F.lit(1)).cast("int").alias("k"))

    engine.add(Model("t", body, config={"partition_by": {"from": "tpch.nation", "columns": ["n_nationkey"], "partitions": 3, "async": True}}))
    with pytest.raises(Exception, match="stop"):
        engine.run("t")
    assert engine.ref("t").collect() == [(1,)] and len(engine.store.versions(engine.relation("t"))) == 1


def test_missing_slot_and_circles_raise(engine):
    by = {"from": "tpch.nation", "columns": ["n_nationkey"], "partitions": 3}
    with pytest.raises(ValueError, match="partition_filter"):
        engine.add(Model("t", "select * from {{source:tpch.nation}}", config={"partition_by": by})).run("t")
    with pytest.raises(ValueError, match="does not slice"):
        engine.add(Model("u", lambda c: c.source("tpch", "nation"), config={"partition_by": by})).run("u")
    engine.add(Model("a", "select * from {{ref:b}}"), Model("b", "select * from {{ref:a}}"))
    with pytest.raises(ValueError, match="circle"):
        engine.run("a", "b")
    with pytest.raises(KeyError):
        engine.run("nothing")


@pytest.mark.parametrize("kind,values", [("bigint", [5, 1, 9, None, 3, 3, 7]), ("string", ["b", "a", None, "é", "it's", ""]), ("double", [1.5, float("nan"), None, -2.0, float("inf")]), ("timestamp", None)])
@pytest.mark.parametrize("p", [2, 3, 5])
def test_ranges_cover_without_overlap(spark, kind, values, p):
    if values is None:
        df = spark.sql("select timestamp '2024-01-01' + make_interval(0,0,0,id) as k from range(9) union all select null")
    else:
        df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    sample, with_null = parts.sample_values(df, "k", 4)
    slices = parts.range_slices("k", parts.range_bounds(sample, p), with_null)
    counts = [s.apply(df).count() for s in slices]
    df.createOrReplaceTempView("ranged")
    assert sum(counts) == df.count() and with_null
    if kind != "timestamp":
        assert counts == [spark.sql(f"select * from ranged where {s.condition}").count() for s in slices]


@pytest.mark.parametrize("n,p,batches", [(10, 4, 3), (9, 4, 3), (8, 4, 2), (6, 4, 2), (5, 4, 2), (1, 4, 1), (0, 4, 0)])
def test_key_batches(spark, tmp_path, n, p, batches):
    df = spark.createDataFrame([(None if i == 0 else i, i % 2) for i in range(n)] * 2, "a int, b int")
    held = parts.KeyBatches(parts.numbered_keys(df, ["a", "b"], f"{tmp_path}/keys"), ["a", "b"], p, f"{tmp_path}/slices", f"keys_{n}_{p}")
    slices = held.slices()
    df.createOrReplaceTempView("keyed")
    assert len(slices) == batches and sum(s.apply(df).count() for s in slices) == 2 * n
    assert sum(spark.sql(f"select * from keyed where {s.condition}").count() for s in slices) == 2 * n
    if n:
        layout = parts.Layout(df, held, ["a"], batches, f"{tmp_path}/layout")
        assert [layout.open(i).count() for i in range(batches)] == [s.apply(df).count() for s in slices]


MERGE = "k int, a int, v string, act string"


def simulate(target, source):
    out = {(k, a): (k, a, v, act) for k, a, v, act in target}
    before = set(out)
    for k, a, v, act in source:
        if act == "update" and (k, a) in before:
            out[(k, a)] = (k, a, v, act)
        elif act == "delete":
            out.pop((k, a), None)
    return sorted([*out.values(), *[r for r in source if r[3] == "insert" and r[:2] not in before]], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_merge_against_a_simulator(spark, seed):
    rng = random.Random(seed)
    keys = [(k, a) for k in (None, 1, 2, 3) for a in (None, 1, 2)]
    target = [(k, a, f"t{k}{a}", "insert") for k, a in keys if rng.random() < 0.6]
    source = [(k, a, f"s{k}{a}", rng.choice(["insert", "update", "delete", "INSERT", None])) for k, a in keys if rng.random() < 0.8]
    got = merge_with_deletes(frame(spark, target, MERGE), frame(spark, source, MERGE), ["k", "a"], "act").collect()
    assert sorted((tuple(r) for r in got), key=str) == simulate(target, source)


def test_documented_merge_and_errors(spark):
    schema = "id int, val string, act string"
    target = frame(spark, [(1, "a", "insert"), (2, "b", "insert")], schema)
    source = frame(spark, [(3, "c", "insert"), (2, "x", "update"), (1, None, "delete")], schema)
    assert sorted(tuple(r) for r in merge_with_deletes(target, source, "id", ["act"]).collect()) == [(2, "x", "update"), (3, "c", "insert")]
    twice = source.union(frame(spark, [(2, "y", "delete")], schema))
    with pytest.raises(AmbiguousMerge):
        merge_with_deletes(target, twice, "id", "act")
    with pytest.raises(ValueError, match="key"):
        merge_with_deletes(target, source, [], "act")
    outside = merge_with_deletes(target, source, "id", "act", ["target.val = 'a'"])
    assert sorted(r["id"] for r in outside.collect()) == [2, 3]
    doubled = frame(spark, [(9, "p", "insert"), (9, "q", "insert")], schema)
    assert merge_with_deletes(target, doubled, "id", "act").count() == 4


def test_functions_and_overloads(engine, spark):
    def define(name, body, **config):
        engine.add(Model(name, body, "function", {"returns": "int", **config}))
        return engine.run(name)[name]

    assert define("plus", "x + 1", parameters="x int").verb == "replace" and define("plus", "x + y", parameters="x int, y int").verb == "replace"
    assert define("plus", "x + 1", parameters="x int").verb == "keep" and define("plus", "x + 1", parameters="x int", secure=True).verb == "alter"
    row = spark.range(1).select(engine.routines.call("plus", F.lit(1).cast("long")), engine.routines.call("plus", F.lit(1).cast("long"), F.lit(5).cast("long"))).first()
    assert list(row) == [2, 6]
    shown = {r["arguments"]: r["body"] for r in engine.routines.rows("function")}
    assert None in shown.values() and len(shown) == 2
    with pytest.raises(ValueError, match="returns"):
        engine.routines.define("function", "f", {}, "1")
    with pytest.raises(ValueError, match="0 functions"):
        engine.routines.call("plus")
    assert engine.drop_relation("plus") == "replace" and engine.relation_type("plus") is None


def test_python_routines(engine, spark):
    python = [{"language": "python", "handler": "'Sum'"}]
    body = "class Sum:\n    def __init__(self):\n        self.total = 0\n    def accumulate(self, v):\n        self.total += v\n    def finish(self):\n        return self.total\n"
    engine.add(Model("total_of", body, "function", {"parameters": "v int", "returns": "int", "aggregate": True, "function_config": python})).run()
    assert spark.range(5).agg(engine.routines.call("total_of", "id")).first()[0] == 10
    engine.add(Model("twice", "class T:\n    def process(self, n):\n        yield (n, n * 2)\n", "function", {"parameters": "n int", "returns": "table(a int, b int)", "function_config": [{"language": "python", "handler": "'T'"}]})).run("twice")
    assert tuple(spark.sql("select * from twice(4)").first()) == (4, 8)
    with pytest.raises(Exception, match="handler"):
        engine.add(Model("broken", "x = 1", "procedure", {"returns": "int", "procedure_config": {"language": "python", "handler": "'gone'"}})).run("broken")


def test_scripts(engine, spark):
    def script(body, **config):
        return engine.add(Model("s", body, "script", config)).run("s")["s"]

    assert script("select 1 as x ->> select x + 1 as y from $1 ->> select y, x from $1, $2").result.first() == (2, 1)
    with pytest.raises(ValueError, match="results"):
        script("select 1 ->> select * from $2")
    with pytest.raises(Exception, match="not_there"):
        script("async (select * from not_there); select 1; await all")
    assert script("begin declare v int default 3; select v as v; end;").result.first()["v"] == 3
    assert script("").result is None and script(lambda c: c.source("tpch", "region").count()).result == 5
    engine.add(Model("made", "select 1 as x")).run("made")
    engine.add(Model("made", "select 2", "script", {"script_materialization": "view"}))
    assert engine.run("made")["made"].verb == "replace" and engine.relation_type("made") is None


def test_policies_grants_and_types(engine, spark):
    engine.add(Model("t", "select n_nationkey, n_regionkey from {{source:tpch.nation}}", config={"grants": {"select": ["a"]}, "aggregation_policy": {"policy": "p", "entity_keys": ["n_nationkey"]}, "join_policy": {"policy": "j", "allowed_join_keys": ["n_regionkey"]}}))
    assert engine.run("t")["t"].result == {"grant": {"A": ["select"]}, "revoke": {}} and engine.run("t")["t"].result == {"grant": {}, "revoke": {}}
    assert engine.grouped("t", ["n_regionkey"], F.count(F.lit(1))).count() == 5
    with pytest.raises(PermissionError):
        engine.grouped("t", ["n_nationkey"], F.count(F.lit(1)))
    with pytest.raises(PermissionError):
        engine.joined("t", engine.ref("t"), ["n_nationkey"])
    assert engine.joined("t", engine.source("tpch", "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).count() == 25
    spark.sql(f"create view `{engine.schema}`.w as select 1 as x")
    engine.add(Model("w", "select 2 as x")).run("w")
    assert engine.relation_type("w") == "table" and engine.relation_type("nope") is None
    assert engine.drop_relation("w", "table") == "keep" and engine.drop_relation("w") == "replace" and engine.relation_type("w") is None


def test_empty_and_sliced_equal_whole(engine):
    empty = engine.add(Model("none", lambda c: c.slice(c.source("tpch", "nation").filter("false")), config={"partition_by": {"from": "tpch.nation", "columns": ["n_nationkey", "n_name"], "partitions": 10}}))
    empty.run("none")
    assert engine.ref("none").count() == 0
    sql = "select o_custkey, sum(o_totalprice) as total, max(o_orderkey) as k from {{source:tpch.orders}} where {{partition_filter}} group by o_custkey"
    engine.add(Model("whole", sql))
    for k, by in enumerate([{"columns": ["o_custkey"], "partitions": 3}, {"columns": ["o_custkey"], "partitions": 4, "async": True}]):
        engine.add(Model(f"part{k}", sql, config={"partition_by": {"from": "tpch.orders", **by}}))
    engine.run("whole", "part0", "part1")
    want = content_hash(engine.ref("whole").select("o_custkey", "k")).first()
    assert all(content_hash(engine.ref(f"part{k}").select("o_custkey", "k")).first() == want for k in (0, 1))


def test_append_and_evolution(engine, spark):
    engine.add(Model("t", "select 1 as k, 'a' as v", config={"enable_schema_evolution": True}), Model("u", "select 1 as k"))
    engine.run()
    assert engine.append("t", spark.sql("select 2 as K, true as fresh")) == ["fresh"] and engine.append("t", spark.sql("select 'b' as v")) == []
    assert sorted(map(str, (tuple(r) for r in engine.ref("t").collect()))) == ["(1, 'a', None)", "(2, None, True)", "(None, 'b', None)"]
    with pytest.raises(ValueError, match="no columns"):
        engine.append("u", spark.sql("select 2 as k, 3 as other"))


def test_sample_bounds_count_all_keys(spark, sf_dir, monkeypatch):
    """lo, hi and n are the table's, however few keys the sample may hold."""
    limits = []
    monkeypatch.setattr(queries, "sample_values", lambda df, c, limit: limits.append(limit) or parts.sample_values(df, c, min(limit, 20)))
    found = queries.partition_sample_bounds(spark, sf_dir).first()
    keys = {r["o_custkey"] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").collect()}
    assert tuple(found) == (min(keys), max(keys), len(keys), 7) and limits == [800]


def test_hierarchy_of_any_depth(spark):
    """A chain of 150, a child with two parents, null ends; circles are refused."""
    rows = [(k, k + 1) for k in range(150)] + [(200, 150), (200, 0), (300, None), (None, 150), (301, 300)]
    found = {r["c"]: r["chain"] for r in hierarchy(frame(spark, rows, "c long, p long"), "c", "p").collect()}
    want = {k: list(range(k + 1, 151)) for k in range(150)} | {200: list(range(151)), None: [150], 301: [300]}
    assert found == want
    for circle in ([(1, 1)], [(1, 2), (2, 3), (3, 1), (0, 1)]):
        with pytest.raises(ValueError, match="ancestor"):
            hierarchy(frame(spark, circle, "c long, p long"), "c", "p")


def test_overloads_by_type_and_two_step_aggregates(engine, spark):
    define = lambda body, **config: engine.add(Model("shown", body, "function", {"returns": "varchar", **config})).run("shown")
    define("concat('int ', x)", parameters="x int")
    define("concat('text ', x)", parameters="x varchar")
    df = spark.sql("select 1 as n, 'a' as t")
    assert tuple(df.select(engine.routines.call("shown", "n", on=df), engine.routines.call("shown", "t", on=df)).first()) == ("int 1", "text a")
    with pytest.raises(ValueError, match="2 functions"):
        engine.routines.call("shown", "n")
    with pytest.raises(ValueError, match="types"):
        engine.routines.call("shown", F.array("n"), on=df)
    python = [{"language": "python", "handler": "'Mean'"}]
    body = "class Mean:\n    def __init__(self):\n        self.s = self.n = 0\n    def accumulate(self, v):\n        if v is not None:\n            self.s += v\n            self.n += 1\n    def merge(self, other):\n        self.s += other.s\n        self.n += other.n\n    def finish(self):\n        return self.s / self.n if self.n else None\n"
    engine.add(Model("mean_of", body, "function", {"parameters": "v float", "returns": "float", "aggregate": True, "function_config": python})).run("mean_of")
    rows = spark.range(1000).selectExpr("nullif(id % 3, 0) as k", "if(id % 7 = 0, null, cast(id as double)) as v").repartition(5)
    found = {r["k"]: r["result"] for r in engine.routines.aggregate(rows, ["k"], "mean_of", "v").collect()}
    assert found == pytest.approx({r["k"]: r["m"] for r in rows.groupBy("k").agg(F.avg("v").alias("m")).collect()})


def test_broken_definition_keeps_the_overloads(engine, spark):
    for body, params in (("x + 1", "x int"), ("x + y", "x int, y int")):
        engine.add(Model("f", body, "function", {"parameters": params, "returns": "int"})).run("f")
    with pytest.raises(Exception):
        engine.add(Model("f", "x + + )", "function", {"parameters": "x varchar", "returns": "int"})).run("f")
    assert len(engine.routines.overloads("function", "f")) == 2 and spark.sql("select f(1, 2)").first()[0] == 3
    assert spark.range(1).select(engine.routines.call("f", F.lit(1).cast("long"))).first()[0] == 2
    engine.routines.drop("function", "f", "(bigint, bigint)")
    assert spark.sql("select f(1)").first()[0] == 2


def test_imports_reach_the_workers(engine, spark, tmp_path):
    (tmp_path / "helper_of_f.py").write_text("def triple(x):\n    return 3 * x\n")
    config = {"parameters": "x int", "returns": "int", "function_config": [{"language": "python", "handler": "'run'"}, f"imports = ('{tmp_path}/helper_of_f.py')"]}
    engine.add(Model("tripled", "def run(x):\n    from helper_of_f import triple\n    return triple(x)\n", "function", config)).run("tripled")
    assert spark.range(3).select(engine.routines.call("tripled", "id").alias("x")).agg(F.sum("x")).first()[0] == 9


def test_a_given_root_is_kept(spark, tmp_path):
    """What lies under a given root outlives the engine and its catalog, and files of others there are left alone."""
    root = f"{tmp_path}/own"
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "foreign.txt").write_text("x")
    one = Engine(spark, root, "kept_a")
    one.add(Model("t", "select 1 as k, 'a' as v", config={"grants": {"select": ["r"]}, "copy_grants": True, "enable_schema_evolution": True}, description="said", columns={"k": "key"}), Model("plus", "x + 1", "function", {"parameters": "x int", "returns": "int"}), Model("gone", "select 1 as x"))
    one.run()
    one.append("t", spark.sql("select 2 as k, true as w"))
    one.drop_relation("gone")
    spark.sql("drop database kept_a cascade")
    spark.sql("drop temporary function if exists plus")
    two = Engine(spark, root, "kept_a")
    assert sorted((r["k"], r["v"], r["w"]) for r in two.ref("t").collect()) == [(1, "a", None), (2, None, True)]
    assert [r["k"] for r in two.store.read_version(two.relation("t"), 1).collect()] == [1] and two.relation_type("gone") is None
    assert spark.catalog.getTable("kept_a.t").description == "said" and two.grants["t"] == {("R", "select")}
    assert spark.sql("select plus(1)").first()[0] == 2
    two.add(*one.models.values())
    done = two.run("t", "plus")
    assert done["plus"].verb == "keep" and done["t"].result == {"grant": {}, "revoke": {}} and (tmp_path / "own" / "foreign.txt").exists()
    assert Engine(spark, root, "kept_b").relation_type("t") is None


def test_files_stay_when_the_session_ends(tmp_path):
    """In a session of its own: its end deletes nothing under a given root, and a scratch folder goes."""
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from loomwright.plans.engine import Engine
from loomwright.plans.model import Model
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
for root in ({str(tmp_path / "own")!r}, None):
    e = Engine(spark, root, "s").add(Model("t", "select 1 as k"))
    e.run()
    print("ROOT", e.store.root)
spark.stop()
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    roots = [x.split()[1] for x in said.stdout.splitlines() if x.startswith("ROOT")]
    assert len(roots) == 2 and list((tmp_path / "own").rglob("*.parquet")) and not os.path.exists(roots[1])


@pytest.mark.parametrize("step", ["before", "catalog"])
def test_a_crash_while_publishing(spark, tmp_path, monkeypatch, step):
    """Before the history's entry nothing has changed; after it the version holds, though the catalog is behind until it is opened again."""
    e = Engine(spark, f"{tmp_path}/r", f"crash_{step}").add(Model("t", "select 1 as k"))
    e.run()
    real = TableStore._mirror if step == "catalog" else None

    def stop(*args, **kwargs):
        raise OSError("lost")

    for replace, body in ((False, "select 2 as k"), (True, "select 3 as k, 4 as w")):
        monkeypatch.setattr("loomwright.sources.store.TableStore._mirror" if step == "catalog" else "loomwright.sources.journal.Journal.put", stop)
        with pytest.raises(OSError):
            e.add(Model("t", body)).run("t")
        monkeypatch.undo()
        e = Engine(spark, f"{tmp_path}/r", f"crash_{step}")
        assert e.ref("t").columns == (["k", "w"] if replace and real else ["k"])
        assert e.ref("t").first()["k"] == ((3 if replace else 2) if real else 1)
        assert [t.name for t in spark.catalog.listTables(f"crash_{step}") if not t.isTemporary] == ["t"]


def test_sliced_loads_of_a_sorted_copy(engine):
    sql = "select o_custkey, count(*) as n from {{source:tpch.orders}} where {{partition_filter}} group by o_custkey"
    by = {"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 20, "async": True, "validate": True}
    engine.add(Model("t", sql, config={"partition_by": by}), Model("u", sql.replace("{{source:tpch.orders}}", "{{ref:w}}"), config={"partition_by": {**by, "from": "w"}}), Model("w", "select * from {{source:tpch.orders}}"))
    assert engine.run("t")["t"].slices == 20
    assert engine.run("w", "u")["u"].slices == 20 and not engine._places and not engine._views
    assert content_hash(engine.ref("t")).first() == content_hash(engine.ref("u")).first()
    crossing = "select count(*) as n from {{source:tpch.orders}} where {{partition_filter}}"
    with pytest.raises(ValueError, match="whole query"):
        engine.add(Model("v", crossing, config={"partition_by": {**by, "partitions": 3}})).run("v")
    assert engine.relation_type("v") is None


def test_stream_keeps_few_versions(engine, spark, tmp_path):
    engine.add(Model("target", "select o_orderkey as k, 'insert' as act from {{source:tpch.orders}}", "merge_with_deletes", {"unique_key": "k", "merge_action": "act"})).run("target")
    for part in range(4):
        frame(spark, [(part * 10 + 1, "delete"), (10**9 + part, "insert")], "k long, act string").write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    assert stream_changes(engine, f"{tmp_path}/in", schema, "target", ["k"], "act", f"{tmp_path}/c", files_per_batch=1) >= 4
    assert len(engine.store.versions(engine.relation("target"))) == 2
    before = engine.ref("target").count()
    assert stream_changes(engine, f"{tmp_path}/in", schema, "target", ["k"], "act", f"{tmp_path}/c") == 0 and engine.ref("target").count() == before
