"""Queries that run each part of the engine end to end over the test tables, with DuckDB SQL for the same rows.

Every table query builds a model, publishes it and reads it back; none is a shortcut to the plain query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import collections as coll
from loomwright.functions import text as txt
from loomwright.operators.grants import grants_delta_table
from loomwright.operators.partitioning import SAMPLES_PER_RANGE, range_bounds, sample_values
from loomwright.plans.aggregates import read_aggregate
from loomwright.plans.config import config_dict, config_list
from loomwright.plans.engine import Engine, content_hash
from loomwright.plans.helpers import hierarchy, new_objects
from loomwright.plans.model import Context, Model
from loomwright.streaming.merge_stream import live_rows, stream_changes, stream_ordered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    found = Engine(spark)
    for t in TABLES:
        found.add_source("tpch", t, f"{sf_dir}/{t}.parquet")
    return found


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _expect(holds: bool, found: object) -> None:
    if not holds:
        raise AssertionError(found)


def build(e: Engine, name: str, body, **config) -> DataFrame:
    """Run one model and read its table."""
    e.add(Model(name, body, config=config)).run(name)
    return e.ref(name)


PRICING = """
    select l_returnflag, l_linestatus, cast(round(sum(l_quantity), 2) as double) as sum_qty, cast(round(sum(l_extendedprice * (1 - l_discount)), 2) as double) as revenue,
        count(*) as n from {table} group by l_returnflag, l_linestatus"""
BY_CUSTOMER = "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total, max(o_orderdate) as latest from {table} group by o_custkey"


def by_customer(c: Context) -> DataFrame:
    orders = c.slice(c.source("tpch", "orders"))
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("latest"))


# -- overwriting ---------------------------------------------------------------------


@query(PRICING.format(table="lineitem"))
def insert_overwrite_full(spark, sf_dir):
    return build(engine(spark, sf_dir), "pricing", PRICING.format(table="{{source:tpch.lineitem}}"))


@query(PRICING.format(table="lineitem"))
def insert_overwrite_rerun(spark, sf_dir):
    e = engine(spark, sf_dir).add(Model("pricing", PRICING.format(table="{{source:tpch.lineitem}}"), config={"cluster_by": ["l_returnflag"]}))
    e.run()
    e.run()
    return e.ref("pricing")


@query("select r_regionkey, r_name, length(r_name) as width from region")
def insert_overwrite_schema_change(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "regions", "select r_regionkey, r_name from {{source:tpch.region}}")
    return build(e, "regions", "select r_regionkey, r_name, length(r_name) as width from {{source:tpch.region}}").select("r_regionkey", "r_name", F.col("width").cast("long").alias("width"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def insert_overwrite_reordered_columns(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "nations", "select n_nationkey, n_name, n_regionkey from {{source:tpch.nation}}")
    e.add(Model("nations", "select n_regionkey, n_nationkey, n_name from {{source:tpch.nation}}"))
    if e.run("nations")["nations"].verb != "keep":
        raise AssertionError("another order of columns must not replace the table")
    return e.ref("nations")


@query("select r_regionkey, 1 as step from region union all select r_regionkey + 100, 2 from region")
def insert_overwrite_self_reference(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "steps", "select r_regionkey, 1 as step from {{source:tpch.region}}")
    return build(e, "steps", "select * from {{ref:steps}} union all select r_regionkey + 100, 2 from {{ref:steps}}")


@query("select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer group by c_mktsegment")
def insert_overwrite_clustered_dag(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add(Model("segments", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from {{ref:clients}} group by c_mktsegment"))
    e.add(Model("clients", "select * from {{source:tpch.customer}}", config={"cluster_by": ["c_nationkey", "c_custkey"], "transient": True, "tags": [{"tag": "owner", "value": "sales"}]}))
    e.run()
    return e.ref("segments")


def _ranges(name: str, concurrent: bool, partitions: int = 8):
    def run(spark, sf_dir):
        return build(engine(spark, sf_dir), "customers", by_customer, partition_by={"from": "tpch.orders", "columns": ["o_custkey"], "partitions": partitions, "async": concurrent})

    run.__name__ = name
    return query(BY_CUSTOMER.format(table="orders"))(run)


insert_overwrite_range_sync = _ranges("insert_overwrite_range_sync", False)
insert_overwrite_range_async = _ranges("insert_overwrite_range_async", True)


@query("select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderpriority")
def insert_overwrite_range_string(spark, sf_dir):
    sql = "with mine as (select * from {{source:tpch.orders}} where {{partition_filter}}) select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from mine group by o_orderpriority"
    return build(engine(spark, sf_dir), "priorities", sql, partition_by={"from": "mine", "columns": "o_orderpriority", "partitions": 3})


@query("select o_orderdate, count(*) as n from orders group by o_orderdate")
def insert_overwrite_range_timestamp(spark, sf_dir):
    sql = "select o_orderdate, count(*) as n from {{source:tpch.orders}} where {{partition_filter}} group by o_orderdate"
    return build(engine(spark, sf_dir), "days", sql, partition_by={"from": "tpch.orders", "columns": ["o_orderdate"], "partitions": 6, "async": True})


KEYED = "select nullif(o_custkey % 50, 0) as k, o_totalprice as price from {table}"


@query(f"select k, count(*) as n, round(sum(price), 2) as total from ({KEYED.format(table='orders')}) group by k")
def insert_overwrite_range_nulls(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "keyed", KEYED.format(table="{{source:tpch.orders}}"))
    sql = "select k, count(*) as n, round(sum(price), 2) as total from {{ref:keyed}} where {{partition_filter}} group by k"
    return build(e, "by_key", sql, partition_by={"from": "keyed", "columns": ["k"], "partitions": 4})


@query("select 7 as k, count(*) as n from orders")
def insert_overwrite_range_fallback(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "single", "select 7 as k, o_orderkey from {{source:tpch.orders}}")
    return build(e, "one", "select k, count(*) as n from {{ref:single}} where {{partition_filter}} group by k", partition_by={"from": "single", "columns": ["k"], "partitions": 5})


PAIRS = "select l_returnflag, nullif(l_linestatus, 'O') as status, cast(sum(l_quantity) as bigint) as qty, count(*) as n from {table} group by l_returnflag, nullif(l_linestatus, 'O')"


def _batches(name: str, concurrent: bool):
    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        build(e, "items", "select l_returnflag, nullif(l_linestatus, 'O') as status, l_quantity from {{source:tpch.lineitem}}")
        sql = "select l_returnflag, status, cast(sum(l_quantity) as bigint) as qty, count(*) as n from {{ref:items}} where {{partition_filter}} group by l_returnflag, status"
        return build(e, "pairs", sql, partition_by={"from": "items", "columns": ["l_returnflag", "status"], "partitions": 4, "async": concurrent})

    run.__name__ = name
    return query(PAIRS.format(table="lineitem"))(run)


insert_overwrite_key_batches = _batches("insert_overwrite_key_batches", False)
insert_overwrite_key_batches_async = _batches("insert_overwrite_key_batches_async", True)


@query("select n_regionkey, count(*) as nations, max(n_name) as last_name from nation group by n_regionkey")
def insert_overwrite_per_key(spark, sf_dir):
    def body(c: Context) -> DataFrame:
        return c.slice(c.source("tpch", "nation")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.max("n_name").alias("last_name"))

    return build(engine(spark, sf_dir), "regions", body, partition_by={"from": "tpch.nation", "columns": ["n_regionkey"], "async": True})


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders")
def insert_overwrite_window(spark, sf_dir):
    sql = "select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as place from {{source:tpch.orders}} where {{partition_filter}}"
    return build(engine(spark, sf_dir), "places", sql, partition_by={"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 4})


@query("""
    with spent as (select o_custkey as custkey, sum(o_totalprice) as total from orders group by 1), seen as (select user_id as custkey, count(*) as n from events group by 1)
    select custkey, round(total, 2) as total, n from spent join seen using (custkey)""")
def insert_overwrite_join_partitioned(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "spent_rows", "select o_custkey as custkey, o_totalprice from {{source:tpch.orders}}")
    build(e, "seen_rows", "select user_id as custkey, event_id from {{source:tpch.events}}")
    sql = """
        with spent as (select custkey, sum(o_totalprice) as total from {{ref:spent_rows}} where {{partition_filter}} group by custkey),
        seen as (select custkey, count(*) as n from {{ref:seen_rows}} where {{partition_filter}} group by custkey)
        select custkey, round(total, 2) as total, n from spent natural join seen"""
    return build(e, "both", sql, partition_by={"from": "spent_rows", "columns": ["custkey"], "partitions": 3})


@query("select min(o_custkey) as lo, max(o_custkey) as hi, count(distinct o_custkey) as n, cast(7 as bigint) as bounds from orders")
def partition_sample_bounds(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    values, _ = sample_values(orders, "o_custkey", SAMPLES_PER_RANGE * 8)
    found = orders.select("o_custkey").distinct().agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"), F.count("o_custkey").alias("n"))
    return found.withColumn("bounds", F.lit(len(range_bounds(values, 8))).cast("bigint"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def table_time_travel(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "states", "select o_orderkey, o_orderstatus from {{source:tpch.orders}} where o_orderstatus = 'F'")
    build(e, "states", "select o_orderkey, o_orderstatus from {{source:tpch.orders}}")
    return e.store.read_version(e.relation("states"), 1)


@query("""
    select o_orderkey, o_orderstatus, 'insert' as action from orders where o_orderstatus = 'O'
    union all select o_orderkey, o_orderstatus, 'delete' from orders where o_orderstatus = 'F'""")
def table_change_tracking(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "states", "select o_orderkey, o_orderstatus from {{source:tpch.orders}} where o_orderstatus in ('F', 'P')", change_tracking=True)
    build(e, "states", "select o_orderkey, o_orderstatus from {{source:tpch.orders}} where o_orderstatus in ('O', 'P')", change_tracking=True)
    return e.store.changes(e.relation("states"), 1, 2)


@query("""
    select r_regionkey, r_name, cast(null as varchar) as note from region
    union all select n_nationkey + 100, null, n_name from nation where n_regionkey = 1""")
def table_schema_evolution(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "places", "select r_regionkey, r_name from {{source:tpch.region}}", enable_schema_evolution=True)
    e.append("places", e.source("tpch", "nation").filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("note")))
    return e.ref("places")


@query("select true as same, false as differs")
def table_content_hash(spark, sf_dir):
    e = engine(spark, sf_dir)
    a = build(e, "a", "select o_orderkey, o_orderstatus from {{source:tpch.orders}}")
    b = build(e, "b", "select o_orderkey, o_orderstatus from {{source:tpch.orders}} where {{partition_filter}}", partition_by={"from": "tpch.orders", "columns": ["o_orderstatus"], "async": True})
    one, two, three = (content_hash(df).first() for df in (a, b, b.filter("o_orderkey > 1")))
    return spark.createDataFrame([(one == two, one["hash"] == three["hash"])], "same boolean, differs boolean")


@query("select r_regionkey, r_name from region")
def table_full_refresh(spark, sf_dir):
    """A full refresh replaces a table that would be kept."""
    e = engine(spark, sf_dir)
    e.add(Model("regions", "select r_regionkey, r_name from {{source:tpch.region}}"))
    verbs = [e.run()["regions"].verb, e.run()["regions"].verb, e.run(full_refresh=True)["regions"].verb]
    _expect(verbs == ["replace", "keep", "replace"], verbs)
    return e.ref("regions")


@query("select 1 as versions, count(*) as n from nation")
def table_retention(spark, sf_dir):
    """Versions older than the retention go with the next load: with zero days all but the current one."""
    e = engine(spark, sf_dir)
    for _ in range(3):
        build(e, "nations", "select n_nationkey from {{source:tpch.nation}}", data_retention_time_in_days=0)
    return e.ref("nations").agg(F.lit(len(e.store.versions(e.relation("nations")))).alias("versions"), F.count(F.lit(1)).alias("n"))


@query("select r_regionkey, r_name from region where upper(r_name) = 'REGION_1'")
def table_collation(spark, sf_dir):
    """Texts of a table with a default collation compare without regard to case; the file holds them as they are."""
    e = engine(spark, sf_dir)
    build(e, "regions", "select r_regionkey, r_name from {{source:tpch.region}}", default_ddl_collation="UTF8_LCASE")
    return e.ref("regions").filter("r_name = 'ReGiOn_1'").select("r_regionkey", F.collate("r_name", "UTF8_BINARY").alias("r_name"))


@query("select n_nationkey, n_name from nation where n_nationkey <> 7 union all select 100, 'NEW'")
def table_append_versions(spark, sf_dir):
    """Appended rows are a version of their own: the one before stays as it was."""
    e = engine(spark, sf_dir)
    build(e, "nations", "select n_nationkey, n_name from {{source:tpch.nation}} where n_nationkey <> 7")
    before = e.store.current(e.relation("nations"))
    e.append("nations", spark.sql("select 100 as n_nationkey, 'NEW' as n_name"))
    _expect(e.store.read_version(e.relation("nations"), before).count() == 24, "an older version changed")
    return e.ref("nations")


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey")
def insert_overwrite_validated(spark, sf_dir):
    """Twenty ranges from a sorted copy of the source, held against the whole query before they are published."""
    sql = "select o_custkey, count(*) as n, cast(round(sum(o_totalprice), 2) as double) as total from {{source:tpch.orders}} where {{partition_filter}} group by o_custkey"
    return build(engine(spark, sf_dir), "customers", sql, partition_by={"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 20, "async": True, "validate": True})


@query("select r_regionkey, r_name, 'own' as label from region")
def table_kept_across_engines(spark, sf_dir):
    """Another engine on the same root finds the table, though the catalog has lost it."""
    e = engine(spark, sf_dir)
    build(e, "regions", "select r_regionkey, r_name, 'own' as label from {{source:tpch.region}}")
    spark.sql(f"drop table `{e.schema}`.regions")
    return Engine(spark, e.store.root, e.schema).ref("regions")


def _beside(e: Engine, sf_dir: str) -> Engine:
    """Another engine on the same root and schema, as another session would have it."""
    other = Engine(e.spark, e.store.root, e.schema)
    for t in TABLES:
        other.add_source("tpch", t, f"{sf_dir}/{t}.parquet")
    return other


@query(PRICING.format(table="lineitem"))
def insert_overwrite_two_writers(spark, sf_dir):
    """Another engine publishes while a load is at work; the load fails and takes no files but its own."""
    e = engine(spark, sf_dir)
    build(e, "pricing", PRICING.format(table="{{source:tpch.lineitem}}") + " having l_returnflag = 'N'")
    other, source = _beside(e, sf_dir), "{{source:tpch.lineitem}}"

    def body(c: Context) -> DataFrame:
        other.add(Model("pricing", PRICING.format(table=source))).run("pricing")
        stop = F.when(F.col("sum_qty") > 0, F.raise_error(F.lit("this load fails")))
        return spark.sql(e.render(PRICING.format(table=source))).withColumn("n", stop.cast("bigint"))

    try:
        e.add(Model("pricing", body)).run("pricing")
    except Exception as error:  # noqa: BLE001
        _expect("this load fails" in str(error), error)
    return e.ref("pricing")


@query("select o_custkey, n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by o_custkey, n_name")
def insert_overwrite_pinned(spark, sf_dir):
    """All slices read the other tables as they were when the load began, though another engine publishes between them."""
    e = engine(spark, sf_dir)
    build(e, "homes", "select c_custkey, n_name from {{source:tpch.customer}} join {{source:tpch.nation}} on c_nationkey = n_nationkey")
    other, seen = _beside(e, sf_dir), []

    def body(c: Context) -> DataFrame:
        seen.append(c.number)
        if len(seen) == 3:
            other.add(Model("homes", "select c_custkey, 'moved' as n_name from {{source:tpch.customer}}")).run("homes")
        rows = c.slice(c.source("tpch", "orders")).join(c.ref("homes"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.groupBy("o_custkey", "n_name").agg(F.count(F.lit(1)).alias("n"))

    return build(e, "placed", body, partition_by={"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 4})


@query(BY_CUSTOMER.format(table="orders"))
def insert_overwrite_many_batches(spark, sf_dir):
    """Batches of a hundred keys: keys and source are written once by batch, and each batch reads its own."""
    return build(engine(spark, sf_dir), "customers", by_customer, partition_by={"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 100, "async": True})


@query("select o_custkey, o_orderkey, o_totalprice - avg(o_totalprice) over (partition by o_custkey) > 0 as above from orders")
def insert_overwrite_proven(spark, sf_dir):
    """The plan proves that no window crosses a slice before anything is loaded; of a query that it cannot prove nothing is."""
    e = engine(spark, sf_dir)
    by = {"from": "tpch.orders", "columns": ["o_custkey"], "partitions": 4, "prove": True}
    try:
        build(e, "crossing", "select o_orderstatus, count(*) as n from {{source:tpch.orders}} where {{partition_filter}} group by o_orderstatus", partition_by=by)
    except ValueError as error:
        _expect("not proven" in str(error) and e.relation_type("crossing") is None, error)
    sql = "select o_custkey, o_orderkey, o_totalprice - avg(o_totalprice) over (partition by o_custkey) > 0 as above from {{source:tpch.orders}} where {{partition_filter}}"
    return build(e, "inside", sql, partition_by=by)


@query("select o_orderpriority, o_orderstatus, count(*) as n from orders where o_orderkey % 2 = 0 group by o_orderpriority, o_orderstatus")
def query_without_select(spark, sf_dir):
    """A query's own tables with another last select."""
    sql = "with even as (select * from {{source:tpch.orders}} where o_orderkey % 2 = 0) select max(o_orderkey) from even"
    return spark.sql(engine(spark, sf_dir).render(f"{txt.remove_select(sql)} select o_orderpriority, o_orderstatus, count(*) as n from even group by o_orderpriority, o_orderstatus"))


# -- merging -------------------------------------------------------------------------


def _merged(e: Engine, first: str, changes: str, full_refresh: bool = False, **config) -> DataFrame:
    e.add(Model("target", first, "merge_with_deletes", config)).run("target")
    e.add(Model("target", changes, "merge_with_deletes", config)).run("target", full_refresh=full_refresh)
    return e.ref("target")


FIRST = "select o_orderkey, o_totalprice as price, 'insert' as act from {table} where o_orderkey % 10 <> 3"
SECOND = """
    select o_orderkey, o_totalprice + 1 as price, case when o_orderkey % 10 = 3 then 'insert' when o_orderkey % 10 = 4 then 'update' else 'delete' end as act
    from {table} where o_orderkey % 10 in (3, 4, 5)"""
MERGED = """
    select o_orderkey, case when o_orderkey % 10 in (3, 4) then o_totalprice + 1 else o_totalprice end as price, case when o_orderkey % 10 = 4 then 'update' else 'insert' end as act
    from orders where o_orderkey % 10 <> 5"""


@query(MERGED)
def merge_with_deletes_basic(spark, sf_dir):
    source = "{{source:tpch.orders}}"
    return _merged(engine(spark, sf_dir), FIRST.format(table=source), SECOND.format(table=source), unique_key="o_orderkey", merge_action=["act"])


@query("""
    with keyed as (select nullif(c_custkey % 7, 0) as a, c_custkey as b, c_acctbal as v from customer)
    select a, b, case when b % 3 = 0 then v * 2 else v end as v, case when b % 3 = 0 then 'update' else 'insert' end as act from keyed where b % 3 <> 1""")
def merge_with_deletes_composite_null_key(spark, sf_dir):
    first = "select nullif(c_custkey % 7, 0) as a, c_custkey as b, c_acctbal as v, 'insert' as act from {{source:tpch.customer}}"
    changes = "select nullif(c_custkey % 7, 0) as a, c_custkey as b, c_acctbal * 2 as v, case when c_custkey % 3 = 0 then 'update' else 'delete' end as act from {{source:tpch.customer}} where c_custkey % 3 <> 2"
    return _merged(engine(spark, sf_dir), first, changes, unique_key=["a", "b"], merge_action="act")


@query("""
    select c_custkey as k, c_nationkey as nation, case when c_nationkey < 10 then 'update' else 'insert' end as act from customer
    union all select c_custkey, c_nationkey, 'insert' from customer where c_nationkey >= 20""")
def merge_with_deletes_predicates(spark, sf_dir):
    first = "select c_custkey as k, c_nationkey as nation, 'insert' as act from {{source:tpch.customer}}"
    changes = "select c_custkey as k, c_nationkey as nation, case when c_nationkey < 20 then 'update' else 'insert' end as act from {{source:tpch.customer}} where c_nationkey < 10 or c_nationkey >= 20"
    return _merged(engine(spark, sf_dir), first, changes, unique_key="k", merge_action="act", incremental_predicates=["target.nation < 10"])


@query("select o_orderkey, o_totalprice as price, 'insert' as act from orders where o_orderkey % 10 <> 3")
def merge_with_deletes_ignored_actions(spark, sf_dir):
    changes = """
        select o_orderkey, 0.0D as price, case when o_orderkey % 10 = 3 then 'update' when o_orderkey % 10 = 4 then 'insert' when o_orderkey % 10 = 5 then 'DELETE' end as act
        from {{source:tpch.orders}}"""
    return _merged(engine(spark, sf_dir), FIRST.format(table="{{source:tpch.orders}}"), changes, unique_key="o_orderkey", merge_action="act")


@query(SECOND.format(table="orders"))
def merge_with_deletes_full_refresh(spark, sf_dir):
    source = "{{source:tpch.orders}}"
    return _merged(engine(spark, sf_dir), FIRST.format(table=source), SECOND.format(table=source), True, unique_key="o_orderkey", merge_action="act")


@query(MERGED)
def merge_with_deletes_stream(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add(Model("target", FIRST.format(table="{{source:tpch.orders}}"), "merge_with_deletes", {"unique_key": "o_orderkey", "merge_action": "act"})).run("target")
    build(e, "changes", SECOND.format(table="{{source:tpch.orders}}"))
    relation = e.relation("changes")
    stream_changes(e, f"{e.store.folder(relation)}/{e.store.entry(relation)['folders'][0]}/slice_0", e.ref("changes").schema, "target", ["o_orderkey"], "act")
    return e.ref("target")


@query("""
    with changes as (select event_id % 400 as k, value as v, case when event_id % 5 = 0 then 'delete' when event_id % 2 = 0 then 'update' else 'insert' end as act, event_id as seq from events)
    select k, arg_max(v, seq) as v, max(seq) as seq from changes group by k having arg_max(act, seq) <> 'delete'""")
def merge_stream_ordered(spark, sf_dir):
    """Changes that come in the order of a hash, in several batches: of each key the last by its own sequence holds."""
    e = engine(spark, sf_dir)
    act = "case when event_id % 5 = 0 then 'delete' when event_id % 2 = 0 then 'update' else 'insert' end"
    sql = f"select event_id % 400 as k, value as v, {act} as act, event_id as seq, event_id as at from {{{{source:tpch.events}}}}"
    build(e, "state", f"select * from ({sql}) where false")
    changes, path = build(e, "changes", sql), f"{e.store.root}/incoming"
    changes.repartitionByRange(4, F.hash("seq")).write.parquet(path)
    stream_ordered(e, path, changes.schema, "state", ["k"], "act", "seq", "at", 1 << 60, files_per_batch=1)
    return live_rows(e, "state", "act").select("k", "v", "seq")


@query(MERGED)
def merge_two_writers(spark, sf_dir):
    """Another engine merges its changes while this one's are made: the merge is made anew, and both sets of changes hold."""
    e, source, config = engine(spark, sf_dir), "{{source:tpch.orders}}", {"unique_key": "o_orderkey", "merge_action": "act"}
    e.add(Model("target", FIRST.format(table=source), "merge_with_deletes", config)).run("target")
    other, left = _beside(e, sf_dir), [1]

    def body(c: Context) -> DataFrame:
        if left:
            left.pop()
            other.add(Model("target", f"select * from ({SECOND.format(table=source)}) where act <> 'delete'", "merge_with_deletes", config)).run("target")
        return spark.sql(e.render(f"select * from ({SECOND.format(table=source)}) where act = 'delete'"))

    e.add(Model("target", body, "merge_with_deletes", config)).run("target")
    _expect(e.store.current(e.relation("target")) == 3, e.store.versions(e.relation("target")))
    return e.ref("target")


ONE_PERCENT = "select o_orderkey, o_totalprice * 2 as price, 'update' as act from {table} where o_orderkey % 100 = 7"


@query("select o_orderkey, case when o_orderkey % 100 = 7 then o_totalprice * 2 else o_totalprice end as price, case when o_orderkey % 100 = 7 then 'update' else 'insert' end as act from orders where o_orderkey % 10 <> 3")
def merge_on_read(spark, sf_dir):
    """Changes of one row in a hundred add marks and their own rows; the files of the table stay as they are."""
    e, source = engine(spark, sf_dir), "{{source:tpch.orders}}"
    df = _merged(e, FIRST.format(table=source), ONE_PERCENT.format(table=source), unique_key="o_orderkey", merge_action="act")
    first, last = (e.store.history(e.relation("target")).entry(n) for n in (1, 2))
    _expect(last["folders"][:1] == first["folders"] and len(last["marks"]) == 1, last)
    return df


@query("select o_orderkey, o_totalprice as price, 'insert' as act from orders where o_orderkey % 10 <> 3")
def merge_time_travel(spark, sf_dir):
    """The version before a merge, whose rows were marked since."""
    e, source = engine(spark, sf_dir), "{{source:tpch.orders}}"
    _merged(e, FIRST.format(table=source), ONE_PERCENT.format(table=source), unique_key="o_orderkey", merge_action="act")
    return e.store.read_version(e.relation("target"), 1)


@query(f"""
    with second as ({SECOND.format(table='orders')}), first as ({FIRST.format(table='orders')})
    select o_orderkey, price, act, 'insert' as action from second where act in ('insert', 'update')
    union all select f.o_orderkey, f.price, f.act, 'delete' from first f join second s on f.o_orderkey = s.o_orderkey and s.act in ('update', 'delete')""")
def merge_change_log(spark, sf_dir):
    """What a merge has changed, from the log that it wrote."""
    e, source = engine(spark, sf_dir), "{{source:tpch.orders}}"
    _merged(e, FIRST.format(table=source), SECOND.format(table=source), unique_key="o_orderkey", merge_action="act", change_tracking=True)
    return e.store.changes(e.relation("target"), 1, 2)


@query(f"""
    with merged as ({MERGED}) select m.o_orderkey % 7 as g, count(*) as n, cast(sum(cast(round(price) as bigint)) as bigint) as total, min(price) as least, max(price) as most
    from merged m group by m.o_orderkey % 7""")
def aggregate_incremental(spark, sf_dir):
    """Sums, counts and extremes by group, kept from the log of a merge; groups whose extremes went are grouped anew."""
    e, source = engine(spark, sf_dir), "{{source:tpch.orders}}"
    config = {"unique_key": "o_orderkey", "merge_action": "act", "change_tracking": True}
    shaped = "select o_orderkey, o_orderkey % 7 as g, price, cast(round(price) as bigint) as whole, act from ({sql})"
    kept = Model("sums", "target", "incremental_aggregate", {"group_by": ["g"], "aggregates": {"n": ["count"], "total": ["sum", "whole"], "least": ["min", "price"], "most": ["max", "price"]}})
    verbs = []
    for sql in (FIRST, SECOND):
        e.add(Model("target", shaped.format(sql=sql.format(table=source)), "merge_with_deletes", config), kept)
        verbs.append(e.run("target", "sums")["sums"].verb)
    _expect(verbs == ["replace", "keep"], verbs)
    return read_aggregate(e, kept)


# -- functions, procedures, scripts --------------------------------------------------

PYTHON = {"function_config": [{"language": "python", "handler": "'run'"}]}


def _function(e: Engine, name: str, body: str, **config) -> Engine:
    e.add(Model(name, body, "function", config)).run(name)
    return e


@query("select o_orderkey, o_orderkey + o_custkey as added from orders")
def function_sql_scalar(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "add_int_sql", "x + y", parameters="x int, y int", returns="int")
    return e.source("tpch", "orders").select("o_orderkey", e.routines.call("add_int_sql", "o_orderkey", "o_custkey").alias("added"))


@query("select x, x * x as square from range(1, 8) r(x)")
def function_sql_table(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "squares", "select x, x * x as square from (select explode(sequence(1, upto)) as x)", parameters="upto int", returns="table(x int, square int)")
    return spark.sql(e.render("select * from squares(7)"))


@query("select o_orderkey, o_orderkey * 2 + 1 as odd from orders")
def function_python_scalar(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "make_odd", "def run(x):\n    return 2 * x + 1\n", parameters="x int", returns="int", **PYTHON)
    return e.source("tpch", "orders").select("o_orderkey", e.routines.call("make_odd", "o_orderkey").alias("odd"))


@query("select c_mktsegment, median(c_acctbal) as middle from customer group by c_mktsegment")
def function_python_aggregate(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "middle_of", "def run(v):\n    return float(v.median())\n", parameters="v float", returns="float", aggregate=True, **PYTHON)
    return e.source("tpch", "customer").groupBy("c_mktsegment").agg(e.routines.call("middle_of", "c_acctbal").alias("middle"))


@query("select c_nationkey, max(c_acctbal) - min(c_acctbal) as span from customer group by c_nationkey")
def function_python_aggregate_merged(spark, sf_dir):
    """A handler with accumulate, merge and finish: states of the tasks are merged, no group meets in one."""
    body = """
class Span:
    def __init__(self):
        self.low = self.high = None
    def accumulate(self, v):
        if v is not None:
            self.low = v if self.low is None else min(self.low, v)
            self.high = v if self.high is None else max(self.high, v)
    def merge(self, other):
        for v in (other.low, other.high):
            self.accumulate(v)
    def finish(self):
        return None if self.low is None else self.high - self.low
"""
    e = _function(engine(spark, sf_dir), "span_of", body, parameters="v float", returns="float", aggregate=True, function_config=[{"language": "python", "handler": "'Span'"}])
    return e.routines.aggregate(e.source("tpch", "customer"), ["c_nationkey"], "span_of", "c_acctbal", out="span")


@query("select n_nationkey, 'number ' || n_nationkey as a, 'text ' || n_name as b, 'both ' || n_name || n_nationkey as c from nation")
def function_overloads(spark, sf_dir):
    """Overloads of one name, told apart by the number and the types of their arguments."""
    e = engine(spark, sf_dir)
    for params, text in (("x int", "concat('number ', x)"), ("x varchar", "concat('text ', x)"), ("x varchar, y int", "concat('both ', x, y)")):
        _function(e, "shown", text, parameters=params, returns="varchar")
    nation = e.source("tpch", "nation")
    call = lambda *c: e.routines.call("shown", *c, on=nation)
    return nation.select("n_nationkey", call("n_nationkey").alias("a"), call("n_name").alias("b"), call("n_name", "n_nationkey").alias("c"))


@query("select o_orderkey, o_orderkey + 3 as more from orders")
def function_kept_across_engines(spark, sf_dir):
    """Another engine on the same root knows the function and builds it no more."""
    e = _function(engine(spark, sf_dir), "three_more", "x + 3", parameters="x int", returns="int")
    again = Engine(spark, e.store.root, e.schema)
    again.add(e.models["three_more"])
    _expect(again.run("three_more")["three_more"].verb == "keep", "an unchanged function was built again")
    return e.source("tpch", "orders").select("o_orderkey", again.routines.call("three_more", "o_orderkey").alias("more"))


@query("select r_regionkey, 'Y' as is_secure, true as hidden, 'replace,alter,keep' as verbs from region")
def function_secure_alter(spark, sf_dir):
    """Secrecy alone alters a function; a secure one's body is not shown."""
    e, verbs = engine(spark, sf_dir), []
    for secure in (False, True, True):
        e.add(Model("hidden_add", "x + 1", "function", {"parameters": "x int", "returns": "int", "secure": secure}))
        verbs.append(e.run("hidden_add")["hidden_add"].verb)
    row = next(r for r in e.routines.rows("function") if r["name"] == "hidden_add")
    return e.source("tpch", "region").select("r_regionkey", F.lit(row["is_secure"]).alias("is_secure"), F.lit(row["body"] is None).alias("hidden"), F.lit(",".join(verbs)).alias("verbs"))


@query("select r_name, i from region, range(1, 4) r(i)")
def function_python_table(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "count_to", "def run(n):\n    for i in range(1, n + 1):\n        yield (i,)\n", parameters="n int", returns="table(i int)", **PYTHON)
    return spark.sql(e.render("select r_name, t.i from {{source:tpch.region}}, lateral count_to(3) t"))


@query("select cast(1 as bigint) as v1, cast(1 as bigint) as v2")
def function_version_alias(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add(Model("next_of_v2", "x + 1", "function", {"parameters": "x int", "returns": "int", "overload_version": "1"}, version="2", latest_version="2")).run()
    return spark.range(1).select(e.routines.call("next_of_v1", "id").alias("v1"), e.routines.call("next_of_v2", "id").alias("v2"))


@query("select cast(11 as bigint) as now, 'replace,keep,replace' as verbs")
def function_replace_on_change(spark, sf_dir):
    e = engine(spark, sf_dir)
    verbs = []
    for body in ("x + 1", "x + 1", "x + 11"):
        e.add(Model("grow", body, "function", {"parameters": "x int", "returns": "int"}))
        verbs.append(e.run("grow")["grow"].verb)
    return spark.range(1).select(e.routines.call("grow", "id").alias("now"), F.lit(",".join(verbs)).alias("verbs"))


@query("select o_orderkey, o_orderkey + 1 as v1, o_orderkey + 1 as v2 from orders")
def function_version_alias_of_column(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add(Model("after_v2", "x + 1", "function", {"parameters": "x int", "returns": "int", "overload_version": "1"}, version="2", latest_version="2")).run()
    return e.source("tpch", "orders").select("o_orderkey", e.routines.call("after_v1", "o_orderkey").alias("v1"), e.routines.call("after_v2", "o_orderkey").alias("v2"))


@query("select c_custkey, c_nationkey * 3 as tripled from customer")
def function_fallback_on_clash(spark, sf_dir):
    """A definition that the catalog refuses leaves the function as it was."""
    e = _function(engine(spark, sf_dir), "tripled_of", "x * 3", parameters="x int", returns="int")
    try:
        _function(e, "tripled_of", "x * * ", parameters="x int", returns="int")
    except Exception:  # noqa: BLE001
        return e.source("tpch", "customer").select("c_custkey", e.routines.call("tripled_of", F.col("c_nationkey").cast("bigint")).alias("tripled"))
    raise AssertionError("a broken body was taken")


@query("select n_name, x, x * x as square from nation, range(1, 4) r(x) where n_regionkey = 2")
def function_sql_table_of_rows(spark, sf_dir):
    e = _function(engine(spark, sf_dir), "squares_upto", "select x, x * x as square from (select explode(sequence(1, upto)) as x)", parameters="upto int", returns="table(x int, square int)")
    return spark.sql(e.render("select n_name, s.x, s.square from {{source:tpch.nation}}, lateral squares_upto(3) s where n_regionkey = 2"))


@query("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey where r_regionkey >= 2 group by r_name")
def procedure_sql(spark, sf_dir):
    e = engine(spark, sf_dir)
    sql = "select r_name, count(*) as n from {{source:tpch.nation}} join {{source:tpch.region}} on n_regionkey = r_regionkey where r_regionkey >= :least group by r_name"
    e.add(Model("regions_from", sql, "procedure", {"parameters": "least int", "returns": "table(r_name varchar, n int)"})).run()
    return e.routines.call_procedure("regions_from", 2)


@query("select c_custkey, c_name from customer where c_nationkey = 3")
def procedure_python(spark, sf_dir):
    e = engine(spark, sf_dir)
    body = f"def run(session, nation):\n    return session.read.parquet({sf_dir + '/customer.parquet'!r}).filter(f'c_nationkey = {{nation}}').select('c_custkey', 'c_name')\n"
    e.add(Model("of_nation", body, "procedure", {"parameters": "nation int", "returns": "table()", "procedure_config": [{"language": "python", "handler": "'run'"}]})).run()
    return e.routines.call_procedure("of_nation", 3)


def _script(e: Engine, body, **config):
    e.add(Model("work", body, "script", config))
    return e.run("work")["work"].result


@query("select count(*) as n from nation")
def script_statement(spark, sf_dir):
    return _script(engine(spark, sf_dir), "select count(*) as n from {{source:tpch.nation}}")


@query("select n_regionkey, count(*) as n from nation where n_nationkey > 4 group by n_regionkey having count(*) > 1")
def script_piped(spark, sf_dir):
    return _script(engine(spark, sf_dir), "select * from {{source:tpch.nation}} where n_nationkey > 4 ->> select n_regionkey, count(*) as n from $1 group by n_regionkey ->> select * from $1 where n > 1")


@query("select cast(sum(i) as bigint) as total, count(*) as n from range(1, 6) r(i)")
def script_block(spark, sf_dir):
    return _script(engine(spark, sf_dir), "begin declare i bigint default 0; declare total bigint default 0; while i < 5 do set i = i + 1; set total = total + i; end while; select total, i as n; end")


@query("select n_regionkey, count(*) as n, cast(2 as bigint) as least from nation where n_regionkey >= 2 group by n_regionkey")
def script_block_over_table(spark, sf_dir):
    """A block whose variable is set from one table's rows and bounds another's."""
    sql = "begin declare least bigint default 0; set least = (select max(r_regionkey) - 2 from {{source:tpch.region}}); select n_regionkey, count(*) as n, any_value(least) as least from {{source:tpch.nation}} where n_regionkey >= least group by n_regionkey; end"
    return _script(engine(spark, sf_dir), sql)


@query("select 'N' as flag, count(*) as n from lineitem where l_returnflag = 'N' union all select 'R', count(*) from lineitem where l_returnflag = 'R'")
def script_async(spark, sf_dir):
    e = engine(spark, sf_dir)
    root, source = f"{e.store.root}/async", "{{source:tpch.lineitem}}"
    load = "async (insert overwrite directory '{root}/{f}' using parquet select '{f}' as flag, count(*) as n from {source} where l_returnflag = '{f}');"
    return _script(e, "".join(load.format(root=root, f=f, source=source) for f in "NR") + f"await all; select * from parquet.`{root}/N` union all select * from parquet.`{root}/R`")


@query("select p_brand, count(*) as n from part group by p_brand")
def script_python(spark, sf_dir):
    body = f"def run(session):\n    return session.read.parquet({sf_dir + '/part.parquet'!r}).groupBy('p_brand').count().withColumnRenamed('count', 'n')\n"
    return _script(engine(spark, sf_dir), body, language="python", handler="run")


@query("select 'keep' as first, 'replace' as second")
def script_drop_if(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "work", "select r_regionkey from {{source:tpch.region}}")
    verbs = []
    for drop_if in ("select 1 from $1 where kind = 'view'", "select 1 from $1 where kind = 'table'"):
        e.add(Model("work", "select 1 as x", "script", {"script_materialization": "table", "drop_if": drop_if}))
        verbs.append(e.run("work")["work"].verb)
    return spark.range(1).select(F.lit(verbs[0]).alias("first"), F.lit(verbs[1]).alias("second"))


# -- helpers -------------------------------------------------------------------------

LISTS = "select o_custkey, array_agg(o_orderkey % 5 order by o_orderkey) as a, array_agg(o_orderkey % 3 order by o_orderkey) as b from orders group by o_custkey"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("l"))
    return rows.select("o_custkey", F.transform("l", lambda x: x["o_orderkey"] % 5).alias("a"), F.transform("l", lambda x: x["o_orderkey"] % 3).alias("b"))


def _array_query(name: str, column: Callable[[], Column], oracle: str):
    def run(spark, sf_dir):
        return _lists(spark, sf_dir).select("o_custkey", F.array_join(F.array_sort(column()), ",").alias("items"))

    run.__name__ = name
    return query(f"with l as ({LISTS}) select o_custkey, array_to_string(list_sort({oracle}), ',') as items from l")(run)


array_unique = _array_query("array_unique", lambda: coll.array_unique(F.col("a")), "list_distinct(a)")
array_union = _array_query("array_union", lambda: coll.array_union(F.col("a"), F.col("b")), "list_distinct(list_concat(a, b))")
array_intersection = _array_query("array_intersection", lambda: coll.array_intersection(F.col("a"), F.col("b")), "list_filter(list_distinct(a), lambda x: list_contains(b, x))")
array_difference = _array_query("array_difference", lambda: coll.array_difference(F.col("a"), F.col("b")), "list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))")


@query("select event_id, value as found, true as has_type, case when event_type = 'click' then value else -1.0 end as click, event_type = 'click' as has_click from events")
def mapping_lookup(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.create_map("event_type", "value")
    return events.select(
        "event_id", coll.get_ignore_case(m, F.upper("event_type"), F.lit(-1.0)).alias("found"), coll.has_keys(m, F.col("event_type")).alias("has_type"), coll.get_ignore_case(m, "CLICK", F.lit(-1.0)).alias("click"),
        coll.has_keys(m, "click").alias("has_click"),
    )


@query("""
    select 'contact.owner' as key, 'team' as value union all select 'tag.layer', 'mart' union all select 'retention', '3' union all select 'extension', '9' union all select 'regions', cast(count(*) as varchar) from region""")
def table_properties(spark, sf_dir):
    """What a table's configuration leaves with it: contacts and tags as properties, the rest in its metadata."""
    e = engine(spark, sf_dir)
    config = {"contacts": {"owner": "team"}, "tags": [{"tag": "layer", "value": "mart"}, "no tag"], "data_retention_time_in_days": 3, "max_data_extension_time_in_days": 9, "tmp_relation_type": "view"}
    n = build(e, "regions", "select * from {{source:tpch.region}}", **config).count()
    held, stored = e.store.properties(e.relation("regions")), e.store.metadata(e.relation("regions"))
    rows = [(k, held[k]) for k in ("contact.owner", "tag.layer")]
    rows += [("retention", str(stored["data_retention_time_in_days"])), ("extension", str(stored["max_data_extension_time_in_days"])), ("regions", str(n))]
    return spark.createDataFrame(rows, "key string, value string")


@query("select n_nationkey, n_nationkey * 3 + 1 as y from nation")
def function_imports_and_header(spark, sf_dir):
    """A handler that imports a file of its own, defined after a header statement that its body needs."""
    import os
    import tempfile

    e = engine(spark, sf_dir)
    folder = tempfile.mkdtemp(prefix="spark-imports-")
    with open(os.path.join(folder, "loom_triple.py"), "w", encoding="utf-8") as f:
        f.write("def triple(x):\n    return 3 * x\n")
    body = "def run(x):\n    from loom_triple import triple\n    return triple(x) + 1\n"
    config = {"parameters": "x int", "returns": "int", "sql_header": "set loom.header = seen", "function_config": [{"language": "python", "handler": "'run'"}, f"imports = ('{folder}/loom_triple.py')"]}
    e.add(Model("triple_one", body, "function", config)).run()
    _expect(spark.conf.get("loom.header") == "seen", "the header did not run")
    return e.source("tpch", "nation").select("n_nationkey", e.routines.call("triple_one", "n_nationkey").alias("y"))


@query("select c_custkey, c_name as whole, len([c_name]) as parts, [c_name][1] as head from customer")
def unjoin_strings(spark, sf_dir):
    """A text as a list of itself, and joined again."""
    parts = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", coll.unjoin_strings(F.col("c_name")).alias("l"))
    return parts.select("c_custkey", coll.join_strings(F.col("l")).alias("whole"), F.size("l").cast("long").alias("parts"), F.get("l", F.lit(0)).alias("head"))


@query("select o_custkey, array_to_string(array_agg(o_orderkey order by o_orderkey), ', ') as keys from orders group by o_custkey")
def join_strings(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_custkey").agg(coll.join_strings(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string"))).alias("keys"))


@query(r"""select event_id, replace(replace(replace(replace(props, '\', '\x5c'), '{', '\x7b'), '}', '\x7d'), '"', '\x22') as escaped from events""")
def escape_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", txt.escape_text(F.col("props")).alias("escaped"))


@query("""
    with names as (select n_name as name from nation union all select '"' || lower(n_name) || '"' from nation)
    select name, regexp_replace(name, '^"(.*)"$', '\\1') as bare, case when name like '"%"' then name else upper(name) end as full_name from names""")
def identifiers(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    names = nation.union(nation.select(F.concat(F.lit('"'), F.lower("name"), F.lit('"'))))
    return names.select("name", txt.identifier_to_string(F.col("name")).alias("bare"), txt.qualified_identifier(F.col("name")).alias("full_name"))


@query("select 'with a as (select 1 as x) ' as prefix, 'x,y' as columns, '{''a'': 1, ''b'': [''p'']}' as config")
def query_text(spark, sf_dir):
    from loomwright.plans.config import compile_config

    e = engine(spark, sf_dir)
    prefix = txt.remove_select("with a as (select 1 as x) select * from a")
    return spark.createDataFrame([(prefix, ",".join(e.columns_in_query("select 1 as x, 2 as y")), compile_config(config_dict({"b": config_list(["p"]), "a": 1})))], "prefix string, columns string, config string")


@query("""
    with wanted as (select distinct c_mktsegment as grantee, case when c_nationkey % 2 = 0 then 'select' else 'insert' end as privilege from customer where c_nationkey < 20),
    held as (select distinct c_mktsegment as grantee, case when c_nationkey % 3 = 0 then 'select' else 'delete' end as privilege from customer where c_nationkey > 5)
    select grantee, privilege, case when h.grantee is null then 'grant' else 'revoke' end as verb
    from (select *, 1 as w from wanted) w full join (select *, 1 as h from held) h using (grantee, privilege) where w is null or h is null""".replace("h.grantee is null", "h is null"))
def grants_delta(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_mktsegment", "grantee")
    wanted = c.filter("c_nationkey < 20").select("grantee", F.when(F.col("c_nationkey") % 2 == 0, "select").otherwise("insert").alias("privilege"))
    held = c.filter("c_nationkey > 5").select("grantee", F.when(F.col("c_nationkey") % 3 == 0, "select").otherwise("delete").alias("privilege"))
    return grants_delta_table(wanted, held)


@query("select n_nationkey, n_name from nation where n_nationkey = 24")
def new_objects_only(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return new_objects(nation.filter("n_nationkey < 24"), nation)


@query("select s_suppkey, s_nationkey, s_acctbal from supplier where s_nationkey < 10")
def row_access_policy_read(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.policies["own_nations"] = lambda role, nation: nation < (10 if role == "west" else 25)
    build(e, "suppliers", "select s_suppkey, s_nationkey, s_acctbal from {{source:tpch.supplier}}", row_access_policy={"policy": "own_nations", "columns": ["s_nationkey"]})
    return e.read("suppliers", "west")


@query("select n_regionkey, count(*) as n from nation group by n_regionkey")
def aggregation_policy_read(spark, sf_dir):
    """A table whose aggregates may not show its entity keys."""
    e = engine(spark, sf_dir)
    build(e, "nations", "select * from {{source:tpch.nation}}", aggregation_policy={"policy": "no_single", "entity_keys": ["n_nationkey"]})
    try:
        e.grouped("nations", ["n_nationkey"], F.count(F.lit(1)))
    except PermissionError:
        return e.grouped("nations", ["n_regionkey"], F.count(F.lit(1)).alias("n"))
    raise AssertionError("the policy let an entity key through")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_policy_read(spark, sf_dir):
    """A table that may be joined by its region only."""
    e = engine(spark, sf_dir)
    build(e, "nations", "select n_regionkey as key, n_nationkey, n_name from {{source:tpch.nation}}", join_policy={"policy": "by_region", "allowed_join_keys": ["key"]})
    regions = e.source("tpch", "region").select(F.col("r_regionkey").alias("key"), "r_name")
    try:
        e.joined("nations", regions.withColumnRenamed("key", "n_nationkey"), ["n_nationkey"])
    except PermissionError:
        return e.joined("nations", regions, ["key"]).select("n_name", "r_name")
    raise AssertionError("the policy let another key through")


@query("select * from (values ('copied', 'ANALYST', 'select'), ('plain', 'NOBODY', 'none')) t(name, grantee, privilege)")
def grants_copied(spark, sf_dir):
    """A table that is replaced keeps its grants with copy_grants, and loses them without."""
    e, rows = engine(spark, sf_dir), []
    for name, copy in (("copied", True), ("plain", False)):
        build(e, name, "select r_regionkey from {{source:tpch.region}}", grants={"select": ["analyst"]}, copy_grants=copy)
        build(e, name, "select r_regionkey, r_name from {{source:tpch.region}}", copy_grants=copy)
        rows += [(name, g, p) for g, p in sorted(e.grants[name]) or [("NOBODY", "none")]]
    return spark.createDataFrame(rows, "name string, grantee string, privilege string")


@query("select * from (values ('grant', 'WRITER', 'insert'), ('revoke', 'READER', 'select')) t(verb, grantee, privilege)")
def grants_after_restart(spark, sf_dir):
    """Another engine on the same root grants and revokes against what the first one left."""
    e = engine(spark, sf_dir)
    build(e, "regions", "select r_regionkey from {{source:tpch.region}}", grants={"select": ["analyst", "reader"]})
    again = Engine(spark, e.store.root, e.schema).add_source("tpch", "region", f"{sf_dir}/region.parquet")
    again.add(Model("regions", "select r_regionkey from {{source:tpch.region}}", config={"grants": {"select": ["analyst"], "insert": ["writer"]}}))
    delta = again.run("regions")["regions"].result
    return spark.createDataFrame([(verb, g, p) for verb, held in delta.items() for g, ps in held.items() for p in ps], "verb string, grantee string, privilege string")


@query("select n_name as name, upper(n_name) || '_TMP' as plain, '\"' || lower(n_name) || '_TMP\"' as quoted from nation")
def relation_suffixes(spark, sf_dir):
    """A suffix goes inside the quotes of a quoted name; unquoted names are in upper case once normalised."""
    from loomwright.plans.relation import Relation

    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    suffixed = lambda n: Relation(n, "main").with_suffix("_TMP").normalize().identifier
    return spark.createDataFrame([(n, suffixed(n), suffixed(f'"{n.lower()}"')) for n in names], "name string, plain string, quoted string")


@query("""
    with recursive up as (
        select s_suppkey as c, s_suppkey // 4 as top, cast(s_suppkey // 4 as varchar) as chain, 1 as n from supplier where s_suppkey > 0
        union all select up.c, up.top // 4, up.chain || ',' || (up.top // 4), n + 1 from up where up.top > 0)
    select c, arg_max(chain, n) as chain from up group by c""")
def hierarchy_recursive(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey > 0")
    found = hierarchy(s.select("s_suppkey", F.expr("s_suppkey div 4").alias("boss")), "s_suppkey", "boss")
    return found.select("c", F.array_join("chain", ",").alias("chain"))


@query("select * from (values ('pricing', 'table'), ('shown', 'view'), ('add_one', 'function'), ('report', 'procedure')) t(name, kind)")
def catalog_rows(spark, sf_dir):
    e = engine(spark, sf_dir)
    build(e, "pricing", "select * from {{source:tpch.region}}")
    spark.sql(f"create view `{e.schema}`.shown as select 1 as x")
    _function(e, "add_one", "x + 1", parameters="x int", returns="int")
    e.add(Model("report", "select 1 as x", "procedure", {"returns": "table(x int)"})).run("report")
    return e.catalog().filter("name in ('pricing', 'shown', 'add_one', 'report')").select("name", "kind")


@query("select 'table' as pricing, 'function' as add_two, true as runs, false as fails, 'A pricing table' as description")
def introspection(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.add(Model("pricing", "select * from {{source:tpch.region}}", description="A pricing table", columns={"r_name": "the name"})).run("pricing")
    _function(e, "add_two", "x + 2", parameters="x int", returns="int", secure=True)
    said = spark.catalog.getTable(f"{e.schema}.pricing").description
    row = (e.relation_type("pricing"), e.relation_type("add_two"), e.is_queryable("select 1 as x"), e.is_queryable("select * from nothing_there"), said)
    return spark.createDataFrame([row], "pricing string, add_two string, runs boolean, fails boolean, description string")


@query("select n_regionkey, max(n_nationkey) as top from nation group by n_regionkey")
def custom_materialization(spark, sf_dir):
    from loomwright.plans.engine import Built

    e = engine(spark, sf_dir)

    @e.materialization("latest_view")
    def latest_view(self: Engine, model: Model, full_refresh: bool) -> Built:
        relation = self.relation(model.name, "view")
        verb = self.drop_relation(model.name, "view", full_refresh)
        self.spark.sql(f"create or replace view {relation.sql} as {model.body}")
        return Built(relation, verb)

    build(e, "nations", "select * from {{source:tpch.nation}}")
    e.add(Model("tops", f"select n_regionkey, max(n_nationkey) as top from `{e.schema}`.nations group by n_regionkey", "latest_view")).run("tops")
    return e.ref("tops")


@query("select count(*) as n, 'pre,post' as seen from region")
def hooks_and_grants(spark, sf_dir):
    e = engine(spark, sf_dir)
    seen: list[str] = []
    e.add(Model("counted", "select count(*) as n from {{source:tpch.region}}", hooks={"pre": [lambda _: seen.append("pre")], "post": [lambda _: seen.append("post"), "select 1"]}, config={"grants": {"select": ["analyst"]}}))
    e.run()
    return e.ref("counted").withColumn("seen", F.lit(",".join(seen)))


@query("select r_name, cast(r_regionkey as varchar) as key from region")
def csv_source(spark, sf_dir):
    e = engine(spark, sf_dir)
    path = f"{e.store.root}/files/regions"
    e.source("tpch", "region").select("r_name", "r_regionkey").write.csv(path)
    e.add_source("files", "regions", path, "csv", "r_name string, key string")
    return build(e, "regions", "select r_name, key from {{source:files.regions}}")
