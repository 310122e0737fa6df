"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomwright import queries as core
from loomwright.plans.engine import Engine
from loomwright.plans.model import Model

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "insert_overwrite_full", "insert_overwrite_range_sync", "insert_overwrite_range_async", "insert_overwrite_key_batches", "insert_overwrite_per_key", "insert_overwrite_window",
    "insert_overwrite_join_partitioned", "merge_with_deletes_basic", "function_python_aggregate", "script_piped", "array_intersection",
]
AGGREGATE = "select l_suppkey, l_returnflag, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as n from {{source:tpch.lineitem}} where {{partition_filter}} group by l_suppkey, l_returnflag"
WINDOW = "select l_orderkey, l_suppkey, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey) as place from {{source:tpch.lineitem}} where {{partition_filter}}"


def sliced(spark: SparkSession, sql: str, **by) -> None:
    e = core.engine(spark, SF_DIR)
    config = {"partition_by": {"from": "tpch.lineitem", "columns": ["l_suppkey"], **by}} if by else {}
    e.add(Model("t", sql, config=config)).run("t")


def merge(spark: SparkSession, percent: int) -> float:
    """A merge model's second run: changes of so many percent of the orders, the new version written and published."""
    e = core.engine(spark, SF_DIR)
    config = {"unique_key": "o_orderkey", "merge_action": "act"}
    e.add(Model("target", "select o_orderkey, o_totalprice, 'insert' as act from {{source:tpch.orders}}", "merge_with_deletes", config)).run("target")
    began = time.perf_counter()
    e.add(Model("target", f"select o_orderkey, o_totalprice * 2 as o_totalprice, 'update' as act from {{{{source:tpch.orders}}}} where o_orderkey % 100 < {percent}", "merge_with_deletes", config)).run("target")
    return time.perf_counter() - began


def rebuild(e: Engine) -> None:
    for _ in range(20):
        e.run("grow")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    same = core.engine(spark, SF_DIR).add(Model("grow", "x + 1", "function", {"parameters": "x int", "returns": "int"}))
    same.run()
    tasks = {name: (lambda f=core.QUERIES[name]: f(spark, SF_DIR).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    for label, sql in (("aggregate", AGGREGATE), ("window", WINDOW)):
        tasks[f"load_{label}_whole"] = lambda s=sql: sliced(spark, s)
        for p in (4, 8):
            tasks[f"load_{label}_ranges_{p}"] = lambda s=sql, p=p: sliced(spark, s, partitions=p)
            tasks[f"load_{label}_ranges_{p}_async"] = lambda s=sql, p=p: sliced(spark, s, partitions=p, **{"async": True})
    tasks |= {f"merge_{p}_percent": (lambda p=p: merge(spark, p)) for p in (1, 10)}
    tasks["rebuild_unchanged_x20"] = lambda: rebuild(same)
    tasks["insert_overwrite_full"]()  # compiles the code that all share
    seconds = {}
    for name, task in tasks.items():
        began = time.perf_counter()
        took = task()  # those that have to set something up first say how long the rest took
        seconds[name] = round(took if isinstance(took, float) else time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
