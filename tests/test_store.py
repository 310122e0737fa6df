"""Versioned tables: writers beside each other, merges as marks, change logs, pinned reads, slices from one scan."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomwright.operators import merge, partitioning
from loomwright.plans import aggregates
from loomwright.plans.engine import Engine, content_hash
from loomwright.plans.model import Context, Model
from loomwright.sources import store as stores
from loomwright.sources.journal import Folder
from loomwright.sources.store import ConcurrentWrite, TableStore
from loomwright.streaming.merge_stream import live_rows, stream_changes, stream_ordered

MERGE = {"unique_key": "k", "merge_action": "act"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def two(spark, tmp_path, schema, *models):
    """Two engines on one root and schema, as two sessions would have them."""
    return [Engine(spark, f"{tmp_path}/r", schema).add(*models) for _ in "ab"]


def folders(store, relation, kind="load"):
    return {n for n, _ in store.files(relation).listing() if n.startswith(f"{kind}_")}


def test_one_name_goes_to_one_writer(spark, tmp_path):
    """Of many writers of one entry just one succeeds, and its text is whole."""
    won, place = [], f"{tmp_path}/j"

    def put(i):
        try:
            Folder(spark, place).put("1.json", f"{i}" * 1000)
            won.append(i)
        except FileExistsError:
            pass

    os.makedirs(place)
    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and Folder(spark, place).get("1.json") == f"{won[0]}" * 1000 and os.listdir(place) == ["1.json"]


def test_a_failed_writer_leaves_the_other_alone(spark, tmp_path):
    """A publishes eleven rows while B is at work; B fails and takes only its own folder with it."""
    a, b = two(spark, tmp_path, "two_fail", Model("t", "select id from range(3)"))
    a.run()

    def body(c: Context):
        a.add(Model("t", "select id from range(11)")).run("t")
        return c.spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="stop"):
        b.add(Model("t", body)).run("t")
    relation = a.relation("t")
    for e in (a, b):
        assert e.ref("t").count() == 11 and e.store.read_version(relation, 2).count() == 11 and e.store.read_version(relation, 1).count() == 3
    assert folders(a.store, relation) == {f for n, _ in a.store.versions(relation) for f in a.store.history(relation).entry(n)["folders"]} and spark.table("two_fail.t").count() == 11


def test_overwrites_beside_each_other_both_hold(spark, tmp_path):
    """Slices of two loads never share a folder; the later one to publish is the current version, whole."""
    a, b = two(spark, tmp_path, "two_over", Model("t", "select id from range(3)"))
    a.run()
    b.add(Model("t", lambda c: (a.add(Model("t", "select id from range(11)")).run("t"), c.spark.range(7))[1]))
    b.run("t")
    held = [b.store.read_version(b.relation("t"), n).count() for n, _ in b.store.versions(b.relation("t"))]
    assert held == [3, 11, 7] or held == [3, 11, 11, 7]
    assert a.ref("t").count() == spark.table("two_over.t").count() == 7


def once(engine, monkeypatch, meanwhile):
    """Run `meanwhile` just before the first publish of `engine`."""
    real, left = engine.store.publish, [meanwhile]

    def publish(*args, **kwargs):
        if left:
            left.pop()()
        return real(*args, **kwargs)

    monkeypatch.setattr(engine.store, "publish", publish)


def test_no_change_of_two_writers_is_lost(spark, tmp_path, monkeypatch):
    """A merge, an append and a stream that are published while a merge is made: the merge is made anew from them."""
    first = Model("t", "select id as k, 'a' as v, 'insert' as act from range(20)", "merge_with_deletes", MERGE)
    a, b = two(spark, tmp_path, "two_merge", first)
    a.run()
    changed = lambda k, v, act="update": Model("t", f"select {k}L as k, '{v}' as v, '{act}' as act", "merge_with_deletes", MERGE)
    once(b, monkeypatch, lambda: a.add(changed(1, "from a")).run("t"))
    b.add(changed(2, "from b")).run("t")
    once(b, monkeypatch, lambda: a.append("t", spark.sql("select 100L as k, 'appended' as v, 'insert' as act")))
    b.add(changed(3, "", "delete")).run("t")
    spark.sql("select 4L as k, 'streamed' as v, 'update' as act").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    once(b, monkeypatch, lambda: a.add(changed(5, "late")).run("t"))
    assert stream_changes(b, f"{tmp_path}/in", schema, "t", ["k"], "act", f"{tmp_path}/c") == 1
    found = {r["k"]: r["v"] for r in a.ref("t").collect()}
    assert {k: found.get(k) for k in (1, 2, 3, 4, 5, 6, 100)} == {1: "from a", 2: "from b", 3: None, 4: "streamed", 5: "late", 6: "a", 100: "appended"}
    assert rows(spark.table("two_merge.t")) == rows(a.ref("t")) and b.ref("t").count() == 20


def test_a_writer_that_is_never_first_gives_up(spark, tmp_path, monkeypatch):
    a, b = two(spark, tmp_path, "two_never", Model("t", "select id as k, 'insert' as act from range(3)", "merge_with_deletes", MERGE))
    a.run()
    real = b.store.publish
    monkeypatch.setattr(b.store, "publish", lambda *x, **y: (a.append("t", spark.sql("select 9L as k, 'insert' as act")), real(*x, **y)))
    with pytest.raises(ConcurrentWrite):
        b.add(Model("t", "select 1L as k, 'delete' as act", "merge_with_deletes", MERGE)).run("t")
    assert a.ref("t").filter("k = 1").count() == 1 and a.ref("t").count() == 3 + b.ATTEMPTS
    assert len(folders(b.store, b.relation("t"))) == 1 + b.ATTEMPTS and not folders(b.store, b.relation("t"), "marks")


def test_an_overwrite_of_its_own_rows_is_made_anew(spark, tmp_path, monkeypatch):
    a, b = two(spark, tmp_path, "two_self", Model("t", "select id from range(3)"))
    a.run()
    once(b, monkeypatch, lambda: a.append("t", spark.sql("select 50L as id")))
    b.add(Model("t", "select id from {{ref:t}} union all select max(id) + 100 from {{ref:t}}")).run("t")
    assert rows(b.ref("t")) == [(0,), (1,), (150,), (2,), (50,)]


def test_orphans_are_swept(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/r", "swept").add(Model("t", "select 1 as k"))
    e.run()
    relation = e.relation("t")
    lost = e.store.stage(relation)
    e.store.write(lost, spark.range(3))
    spark.range(2).write.parquet(lost.marks)
    assert e.store.sweep(relation) == [] and len(e.store.sweep(relation, 0)) == 2
    assert e.ref("t").count() == 1 and len(folders(e.store, relation)) == 1


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("tracked", [False, True])
def test_a_small_merge_writes_little(spark, tmp_path, tracked):
    """Changes of one in a hundred rows write less than a tenth of the table; old versions read as they were."""
    e = Engine(spark, f"{tmp_path}/r", f"little_{tracked}")
    config = {**MERGE, "change_tracking": tracked}
    e.add(Model("t", "select id as k, sha2(cast(id as string), 256) as v, 'insert' as act from range(20000)", "merge_with_deletes", config)).run()
    relation = e.relation("t")
    before, whole = rows(e.ref("t")), size_of(e.store.folder(relation))
    changes = "select id as k, 'new' as v, case when id % 3 = 0 then 'update' when id % 3 = 1 then 'delete' else 'insert' end as act from range(0, 20100, 100)"
    e.add(Model("t", changes, "merge_with_deletes", config)).run()
    assert size_of(e.store.folder(relation)) - whole < 0.1 * whole and e.store.entry(relation)["marks"]
    want = {k: (k, v, act) for k, v, act in before}
    for k in range(0, 20100, 100):
        if k % 3 == 0 and k in want:
            want[k] = (k, "new", "update")
        elif k % 3 == 1:
            want.pop(k, None)
        elif k % 3 == 2 and k not in want:
            want[k] = (k, "new", "insert")
    want = sorted(want.values(), key=str)
    assert rows(e.ref("t")) == rows(spark.table(f"{e.schema}.t")) == want and rows(e.store.read_version(relation, 1)) == before
    again = Engine(spark, f"{tmp_path}/r", f"little_{tracked}")
    assert rows(again.ref("t")) == want and again.relation_type("t") == "table"


def test_merges_against_a_simulator(spark, tmp_path, monkeypatch):
    """Random merges, appends and overwrites: rows, versions, changes, hashes, with the table written anew on the way."""
    monkeypatch.setattr(stores, "MARKS_TO_BROADCAST", 3)
    monkeypatch.setattr(merge, "COMPACT_FOLDERS", 2)
    rng = random.Random(5)
    e = Engine(spark, f"{tmp_path}/r", "simulated")
    config = {**MERGE, "change_tracking": True}
    relation, held, versions = e.relation("t"), {}, []
    values = lambda new: "values " + ", ".join(f"({k}L, '{v}', '{a}')" for k, v, a in new)
    for step in range(9):
        keys = rng.sample(range(40), 20 if not step else rng.randint(1, 6))
        if step in (0, 6):
            new = [(k, f"{step}", "insert") for k in keys]
            e.add(Model("t", f"select * from ({values(new)}) t(k, v, act)", "merge_with_deletes", config)).run(full_refresh=True)
            held = {k: (k, v, a) for k, v, a in new}
        elif step == 3:
            e.append("t", spark.sql(f"select * from ({values([(100, 'x', 'y')])}) t(k, v, act)"))
            held[100] = (100, "x", "y")
        else:
            new = [(k, f"{step}", rng.choice(["insert", "update", "delete"])) for k in keys]
            e.add(Model("t", f"select * from ({values(new)}) t(k, v, act)", "merge_with_deletes", config)).run()
            for k, v, a in new:
                if a == "delete":
                    held.pop(k, None)
                elif (k in held) == (a == "update"):
                    held[k] = (k, v, a)
        versions.append(dict(held))
        assert rows(e.ref("t")) == rows(spark.table("simulated.t")) == sorted(held.values(), key=str)
    numbers = [n for n, _ in e.store.versions(relation)]
    assert [rows(e.store.read_version(relation, n)) for n in numbers] == [sorted(v.values(), key=str) for v in versions]
    assert any(len(e.store.history(relation).entry(n)["folders"]) == 1 for n in numbers[1:6])
    for old, new in ((1, 3), (2, 6), (3, 4), (5, 9), (7, 9), (4, 4)):
        a, b = (e.store.read_version(relation, n) for n in (old, new))
        want = b.exceptAll(a).selectExpr("*", "'insert' as action").union(a.exceptAll(b).selectExpr("*", "'delete' as action"))
        assert rows(e.store.changes(relation, old, new)) == rows(want), (old, new)
    counted = stores.Counted.of(e.store.entry(relation))
    e.add(Model("copy", "select * from {{ref:t}}")).run("copy")
    assert counted.rows == len(held) and e.store.same_rows(relation, e.relation("copy")) is True
    e.append("copy", spark.sql("select 1L as k, 'z' as v, 'z' as act"))
    assert e.store.same_rows(relation, e.relation("copy")) is False


def test_aggregates_are_kept_from_changes(spark, tmp_path):
    """After random merges and appends the kept groups are those of the whole table; deleted extremes are found anew."""
    rng = random.Random(11)
    e = Engine(spark, f"{tmp_path}/r", "kept")
    config = {**MERGE, "change_tracking": True}
    wanted = {"n": ["count"], "known": ["count", "v"], "total": ["sum", "v"], "least": ["min", "v"], "most": ["max", "d"], "weight": ["sum", "x"]}
    model = Model("sums", "t", "incremental_aggregate", {"group_by": ["g", "h"], "aggregates": wanted})
    row = lambda k, act: f"({k}L, {rng.choice(['null', 1, 2, 3])}, {rng.choice(['null', chr(39) + 'a' + chr(39)])}, {rng.choice(['null', rng.randrange(-5, 9)])}, {rng.randrange(100)}.25BD, {rng.random()}D, '{act}')"
    verbs = []
    for step in range(7):
        if step == 4:
            e.append("t", spark.sql(f"select * from values {row(500, 'x')}, {row(501, 'x')} t(k, g, h, v, d, x, act)"))
        elif step != 6:
            keys = rng.sample(range(40), 30 if not step else 8)
            values = ", ".join(row(k, "insert" if not step else rng.choice(["insert", "update", "delete"])) for k in keys)
            e.add(Model("t", f"select k, cast(g as int) as g, cast(h as string) as h, cast(v as bigint) as v, cast(d as decimal(10,2)) as d, x, act from values {values} t(k, g, h, v, d, x, act)", "merge_with_deletes", config)).run("t")
        verbs.append(e.add(model).run("sums")["sums"].verb)
        want = e.ref("t").groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("d").alias("most"), F.round(F.sum("x"), 9).alias("weight"))
        got = aggregates.read_aggregate(e, model)
        assert rows(got.withColumn("weight", F.round("weight", 9))) == rows(want), step
    assert verbs == ["replace", "keep", "keep", "keep", "keep", "keep", "none"]
    e.add(Model("t", "select 1L as k, 1 as g, 'a' as h, 2L as v, cast(3 as decimal(10,2)) as d, 0.5D as x, 'insert' as act", "merge_with_deletes", config)).run("t", full_refresh=True)
    assert e.run("sums")["sums"].verb == "replace" and rows(aggregates.read_aggregate(e, model).select("g", "n", "total")) == [(1, 1, 2)]
    with pytest.raises(ValueError, match="cannot be kept"):
        e.add(Model("bad", "t", "incremental_aggregate", {"group_by": "g", "aggregates": {"m": ["median", "v"]}})).run("bad")


def test_changes_read_the_log_alone(spark, tmp_path):
    """With the tables' own files gone, changes of a tracked merge can still be read."""
    e = Engine(spark, f"{tmp_path}/r", "logged")
    config = {**MERGE, "change_tracking": True}
    e.add(Model("t", "select id as k, 'a' as v, 'insert' as act from range(1000)", "merge_with_deletes", config)).run()
    e.add(Model("t", "select id as k, 'b' as v, if(id < 3, 'update', 'delete') as act from range(5)", "merge_with_deletes", config)).run()
    e.store.discard(f"{e.store.folder(e.relation('t'))}/{e.store.history(e.relation('t')).entry(1)['folders'][0]}")
    found = rows(e.store.changes(e.relation("t"), 1, 2))
    assert found == sorted([(k, "a", "insert", "delete") for k in range(5)] + [(k, "b", "update", "insert") for k in range(3)], key=str)


def test_merge_errors_leave_nothing(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/r", "ambiguous").add(Model("t", "select id as k, 'insert' as act from range(3)", "merge_with_deletes", MERGE))
    e.run()
    for sql in ("select 1L as k, 'update' as act union all select 1L, 'delete'", "select 1L as k, if(id = 0, 'update', raise_error('stop')) as act from range(2)"):
        with pytest.raises(Exception, match="several|stop"):
            e.add(Model("t", sql, "merge_with_deletes", MERGE)).run("t")
    assert len(e.store.files(e.relation("t")).listing()) == 3 and not os.listdir(f"{tmp_path}/r/scratch")
    e.add(Model("t", "select 7L as k, 'update' as act union all select 7L, 'update' union all select 8L, 'insert' union all select 8L, 'insert'", "merge_with_deletes", MERGE)).run("t")
    assert rows(e.ref("t")) == [(0, "insert"), (1, "insert"), (2, "insert"), (8, "insert"), (8, "insert")]


def test_statistics_leave_files_out(spark, tmp_path):
    """Reads and merges of a narrow range open the files that hold it; appended and merged files have statistics as well."""
    e = Engine(spark, f"{tmp_path}/r", "stats")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    e.add(Model("t", "select nullif(id, 5) as k, cast(id as string) as v, 'insert' as act from range(0, 1000, 1, 8)", "merge_with_deletes", {**MERGE, "cluster_by": ["k"]})).run()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    relation, data = e.relation("t"), lambda df: sum("/load_" in f for f in df.inputFiles())
    assert data(e.ref("t")) >= 4
    e.append("t", spark.sql("select 5000L as k, 'x' as v, 'insert' as act"))
    e.add(Model("t", "select 5000L as k, 'y' as v, 'update' as act union all select 700L, 'z', 'delete'", "merge_with_deletes", {**MERGE, "cluster_by": ["k"]})).run()
    entry = e.store.entry(relation)
    assert entry["stats"]["columns"] == ["k"] and set(entry["stats"]["by"]) == set(entry["folders"])
    for low, high, want in ((10, 12, [10, 11, 12]), (699, 701, [699, 701]), (4000, 6000, [5000]), (2000, 3000, [])):
        found = e.store.within(relation, "k", low, high)
        assert sorted(r["k"] for r in found.collect()) == want and data(found) <= 2 < data(e.ref("t"))
    files = lambda low, high, nulls: e.store.holding(relation, entry, "k", low, high, nulls)
    assert len(files(None, None, True)) == 1 and len(files(0, 6000, True)) >= 3 and files(0, 1, False) != entry["folders"]
    assert rows(e.store.within(relation, "v", "y", "y")) == [(5000, "y", "update")] and e.ref("t").filter("k is null").count() == 1
    assert e.ref("t").count() == 1000 and e.store.read_version(relation, 1).count() == 1000


# -- one state for a whole load, one scan for all slices -----------------------------


@pytest.mark.parametrize("sql", [True, False])
@pytest.mark.parametrize("copied", [True, False])
def test_a_publish_between_slices_does_not_show(spark, tmp_path, monkeypatch, sql, copied):
    """All slices read the versions of the moment when the load began, though another engine publishes after the first."""
    monkeypatch.setattr(partitioning, "COPY_BYTES", 0 if copied else 1 << 40)
    e, other = two(spark, tmp_path, f"pinned_{sql}_{copied}", Model("side", "select 1 as x"))
    e.run()
    e.add(Model("src", "select id as k from range(12)")).run("src")
    seen = []

    def note(k):
        if not seen:
            seen.append(k)
            other.add(Model("side", "select 2 as x"), Model("src", "select id as k from range(100)")).run("side", "src")
        return k

    real = e._write
    e._write = lambda load, df, c, part="slice_0": (real(load, df, c, part), note(part))[0]
    by = {"from": "src", "columns": ["k"], "partitions": 4}
    if sql:
        e.add(Model("t", "select k, x from {{ref:src}} cross join {{ref:side}} where {{partition_filter}}", config={"partition_by": by}))
    else:
        e.add(Model("t", lambda c: c.slice(c.ref("src")).crossJoin(c.ref("side")), config={"partition_by": by}))
    e.run("t")
    assert rows(e.ref("t")) == sorted(((k, 1) for k in range(12)), key=str) and other.ref("side").first()["x"] == 2 and e.ref("side").first()["x"] == 2


def test_the_source_is_read_once(spark, tmp_path, monkeypatch):
    """Rows that the source hands out are counted: all slices together cost one scan, and one for the keys."""
    assert not partitioning.worth_a_copy(spark.range(1000), 8) and partitioning.worth_a_copy(spark.range(1000), 16)
    monkeypatch.setattr(partitioning, "COPY_BYTES", 0)
    e = Engine(spark, f"{tmp_path}/r", "once")
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        read.add(1)
        return k

    e.add_source("s", "t", lambda: spark.range(1000).select(counted(F.col("id")).alias("k"), (F.col("id") % 7).alias("v")))
    sql = "select k % 40 as g, count(*) as n from {{source:s.t}} where {{partition_filter}} group by k % 40"
    for name, by in (("ranges", {"columns": ["k"], "partitions": 8}), ("batches", {"columns": ["v"], "partitions": 2}), ("per_key", {"columns": ["v"]})):
        before = read.value
        e.add(Model(name, sql, config={"partition_by": {"from": "s.t", **by}})).run(name)
        assert e.ref(name).agg(F.sum("n")).first()[0] == 1000
        assert read.value - before <= 3000, (name, read.value - before)


BODIES = [
    "select {k}, count(*) as n from {{source:s.t}} where {{partition_filter}} group by {k}",
    "with a as (select * from {{source:s.t}} where {{partition_filter}}) select {k}, count(*) as n from a natural join (select distinct {k} from {{source:s.t}} where {{partition_filter}}) group by {k}",
    "select {k}, hash(*) as h from {{source:s.t}} where {{partition_filter}}",
    "select {k}, n - (select count(*) from {{source:s.t}}) as n from (select {k}, count(*) as n from {{source:s.t}} where {{partition_filter}} group by {k})",
    "select {k}, count(*) as n from {{source:s.o}} where {{partition_filter}} group by {k}",
]


@pytest.mark.parametrize("by", [{"partitions": 3}, {}, {"partitions": 2, "columns": ["k", "v"], "async": True}])
def test_bodies_see_their_slice_and_the_whole(spark, tmp_path, monkeypatch, by):
    """Whatever a query does beside its slot, the slices together are the whole query's rows, nulls too."""
    monkeypatch.setattr(partitioning, "COPY_BYTES", 0)
    e = Engine(spark, f"{tmp_path}/r", "bodies")
    source = lambda: spark.range(90).selectExpr("nullif(id % 6, 5) as k", "id % 2 as v")
    e.add_source("s", "t", source).add_source("s", "o", source)
    by = {"from": "s.t", "columns": ["k"], **by}
    for i, body in enumerate(BODIES):
        body = body.replace("{k}", ", ".join(by["columns"]))
        e.add(Model(f"sliced{i}", body, config={"partition_by": by}), Model(f"whole{i}", body.replace("{{partition_filter}}", "true")))
    e.run()
    for i, body in enumerate(BODIES):
        assert rows(e.ref(f"sliced{i}")) == rows(e.ref(f"whole{i}")), body


def test_ten_thousand_keys_are_planned_at_once(spark, tmp_path):
    """The slices of ten thousand keys are numbers until they run; each opens its own folder."""
    import time

    e = Engine(spark, f"{tmp_path}/r", "many")
    e.add_source("s", "t", lambda: spark.range(20_000).selectExpr("id % 10000 as k", "id as v"))
    model = Model("t", lambda c: c.slice(c.source("s", "t")))
    e._loading = True
    began = time.monotonic()
    slices = e._slices(model, partitioning.partition_config({"from": "s.t", "columns": ["k"]})[0])
    took = time.monotonic() - began
    frame = e.frame(model, slices[1234], 1234)
    got = frame.collect()
    assert len(slices) == 10_000 and took < 60 and len(got) == 2 and len({r["k"] for r in got}) == 1 and len(frame.inputFiles()) < 5
    assert rows(e.frame(model, slices[1234])) == sorted((tuple(r) for r in got), key=str)


def test_content_hash_of_slices_adds_up(spark, tmp_path):
    """The hash in the history is the one of the rows, whether they came whole, in slices, or by merges."""
    e = Engine(spark, f"{tmp_path}/r", "hashes")
    e.add_source("s", "t", lambda: spark.range(300).selectExpr("id as k", "cast(id as string) as v"))
    e.add(Model("a", "select * from {{source:s.t}}"), Model("b", "select * from {{source:s.t}} where {{partition_filter}}", config={"partition_by": {"from": "s.t", "columns": ["k"], "partitions": 5, "async": True}}), Model("c", "select k + 1 as k, v from {{source:s.t}}"))
    e.run()
    assert e.store.same_rows(e.relation("a"), e.relation("b")) is True and e.store.same_rows(e.relation("a"), e.relation("c")) is False
    assert content_hash(e.ref("a")).first() == content_hash(e.ref("b")).first() and TableStore(spark, e.store.root).same_rows(e.relation("a"), e.relation("nothing")) is None


CHANGES = "k long, v string, act string, seq long, at long"


@pytest.mark.parametrize("lateness", [10**9, 40])
def test_changes_in_any_order(spark, tmp_path, lateness):
    """Shuffled and repeated changes give what their own order gives; those that are too late are passed over."""
    rng = random.Random(9)
    changes = [(rng.choice([None, *range(12)]), f"v{i}", rng.choice(["insert", "update", "delete"]), i, i) for i in range(150)]
    late = [c for i, c in enumerate(changes) if i in (20, 70, 111)]
    sent = [c for c in changes if c not in late]
    jumbled = sorted([*sent, *rng.sample(sent, 40)], key=lambda c: c[4] + rng.randrange(30))
    batches = [jumbled[i : i + 40] for i in range(0, len(jumbled), 40)]
    batches[-1] = [*batches[-1], *late]
    e = Engine(spark, f"{tmp_path}/r", f"ordered_{lateness}").add(Model("t", lambda c: c.spark.createDataFrame([], CHANGES)))
    e.run()
    for batch in batches:
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert stream_ordered(e, f"{tmp_path}/in", spark.createDataFrame([], CHANGES).schema, "t", ["k"], "act", "seq", "at", lateness, f"{tmp_path}/c", 1) == 1
    in_time = changes if lateness > 1000 else [c for c in changes if c not in late or c[4] >= max(x[4] for b in batches[:-1] for x in b) - lateness]
    want = {}
    for c in sorted(in_time, key=lambda c: c[3]):
        want[c[0]] = c
    assert rows(live_rows(e, "t", "act")) == sorted((c for c in want.values() if c[2] != "delete"), key=str)
    remembered = e.ref("t").filter("act = 'delete'").count()
    assert remembered == sum(c[2] == "delete" and (lateness > 1000 or c[4] >= 149 - lateness) for c in want.values())
    assert stream_ordered(e, f"{tmp_path}/in", e.ref("t").schema, "t", ["k"], "act", "seq", "at", lateness, f"{tmp_path}/c") == 0
