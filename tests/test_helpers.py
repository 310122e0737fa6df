"""Golden values and properties of the plain helpers."""

import datetime as dt
import decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import collections as coll
from loomwright.functions import text as txt
from loomwright.operators import grants, partitioning, routines
from loomwright.plans import config
from loomwright.plans.relation import Relation


def test_arrays():
    a, b, c = [1, 2, 3, 4, 5], [0, 1, 2], [1, 2, 3]
    assert coll.array_difference(a, b, c) == [4, 5]
    assert coll.array_intersection(a, b, c) == [1, 2]
    assert coll.array_union(a, b, c) == [1, 2, 3, 4, 5, 0]
    assert coll.array_unique([1, 1, 2, 3, 2]) == [1, 2, 3]
    assert coll.array_union() == [] and coll.array_union(a, "no list", None) == a
    assert coll.array_intersection([2, 2], None) == [2] and coll.array_intersection("x") == [] == coll.array_difference(5)


def test_array_columns_keep_order_and_skip_nulls(spark):
    df = spark.createDataFrame([([3, 1, 3, None], [1, 9], None)], "a array<int>, b array<int>, c array<int>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    row = df.select(coll.array_unique(a), coll.array_union(a, c, b), coll.array_intersection(a, b, c), coll.array_difference(a, b, c), coll.array_union(c, b)).first()
    assert list(row) == [[3, 1, None], [3, 1, None, 9], [1], [3, None], [1, 9]]


def test_mappings(spark):
    m = {"x": 1, "Y": None, 5: "five"}
    assert coll.has_keys(m, "x", "Y") and not coll.has_keys(m, "z") and not coll.has_keys([1], 0)
    assert coll.get_ignore_case(m, "X") == 1 and coll.get_ignore_case(m, "y", 7) is None and coll.get_ignore_case(m, "q", 7) == 7 and coll.get_ignore_case(None, "x", 3) == 3
    df = spark.createDataFrame([({"a": 1, "B": 2},), (None,)], "m map<string,int>")
    got = df.select(coll.get_ignore_case(F.col("m"), "b", 9).alias("x"), coll.has_keys(F.col("m"), "a", "B").alias("y")).collect()
    assert [tuple(r) for r in got] == [(2, True), (9, False)]
    assert coll.join_strings(["a", 1]) == "a, 1" and coll.join_strings("a") == "a" and coll.unjoin_strings("a") == ["a"] and coll.unjoin_strings(["a"]) == ["a"]
    assert coll.is_non_string_iterable((1,)) and not coll.is_non_string_iterable("ab") and not coll.is_non_string_iterable(3)


def test_text():
    assert txt.escape_text("select 'ABC' as \"XYZ\";") == r"select \x27ABC\x27 as \x22XYZ\x22\x3b"
    assert txt.escape_text("\\{}$\n\r") == r"\x5c\x7b\x7d\x24\x0a\x0d"
    assert txt.identifier_to_string('"ColumnName"') == "ColumnName" and txt.identifier_to_string("COLUMN_NAME") == "COLUMN_NAME"
    assert txt.qualified_identifier("my_table") == "MY_TABLE" and txt.qualified_identifier('"my_table"') == '"my_table"' and txt.qualified_identifier(None) is None


def test_text_columns_agree_with_plain_values(spark):
    values = ["it's", '"Quoted"', "{a;b}\n$", "plain", "", '"']
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", txt.escape_text(F.col("v")), txt.identifier_to_string(F.col("v")), txt.qualified_identifier(F.col("v"))).collect()
    for v, a, b, c in rows:
        assert (a, b, c) == (txt.escape_text(v), txt.identifier_to_string(v), txt.qualified_identifier(v))


def test_remove_select():
    assert txt.remove_select("with a as (select 1) select * from a") == "with a as (select 1) "
    assert txt.remove_select("with a as (select 1)") == "with a as (select 1)"
    assert txt.remove_select("/* select */ with preselect as (select 'select') SELECT 1") == "/* select */ with preselect as (select 'select') "
    assert txt.split_top_level("a ';' ; b -- ; \n (x;y);", ";") == ["a ';'", "b -- ; \n (x;y)"]
    assert txt.split_top_level("a ->> b $1 ->> c - d > e", "->>") == ["a", "b $1", "c - d > e"]


@given(st.text(alphabet="select ()'\"ab,", max_size=40))
def test_remove_select_is_a_prefix(q):
    assert q.startswith(txt.remove_select(q))


def test_relations():
    r = Relation("t", "s", None, "table")
    assert r.normalize() == Relation("T", "S", None, "table") and Relation('"t"').normalize().identifier == '"t"'
    assert r.with_suffix("_x").identifier == "t_x" and Relation('"t"').with_suffix("_x").identifier == '"t_x"' and Relation(None, "s").with_suffix("_x").schema == "s_x"
    assert Relation('"A`b"', "s").sql == "`s`.`A``b`"


def test_compile_config():
    c = config.compile_config
    assert c("x") == "x" and c("x", quote=True) == "'x'" and c(3, quote=None) == "3" and c(True) == "true"
    assert c([1, "a"]) == "[1, a]" and c({"b": 2, "A": 1}) == "A = 1, b = 2"
    assert c(config.config_dict({"k": "v", "J": 2})) == "{'J': 2, 'k': 'v'}" and c(config.config_set(["a"])) == "{'a'}" and c(config.config_tuple(["a", 1])) == "('a', 1)"
    assert c(config.config_iterator(["a", "b"])) == "a, b" and c(config.config_string("it's")) == r"'it\x27s'"
    assert c(config.config_ref("pkg", "m", v=2, file="x.csv")) == "m/x.csv" and c(config.config_source("s", "t")) == "s.t" and c(config.config_ref("m", string=True)) == "'m'"
    assert [c(v) for v in config.config_recursive({"a": [1, ("x",)]}, {3})] == ["{'a': [1, ('x')]}", "{3}"]
    with pytest.raises(ValueError, match="reference"):
        config.config_ref()


def test_table_config():
    good = config.table_config({"cluster_by": "a", "tags": [{"tag": "x", "value": 1}, "bad"], "transient": True, "default_DDL_collation": "utf8_lcase"})
    assert good.fingerprint == {"cluster_by": ["a"], "tags": [{"tag": "x", "value": 1}], "default_ddl_collation": "utf8_lcase"} and good.transient and not good.warnings
    bad = config.table_config({"cluster_by": 3, "data_retention_time_in_days": -1, "change_tracking": "yes", "row_access_policy": {"policy": "p"}, "join_policy": {}})
    assert not bad.fingerprint and len(bad.warnings) == 5


def test_range_bounds():
    assert partitioning.range_bounds(range(10), 3) == [3, 6] and partitioning.range_bounds([1, 2], 2) == [1] and partitioning.range_bounds([4, 5], 3) == [4, 5]


@given(st.sets(st.integers(-50, 50), max_size=60), st.integers(2, 12))
def test_bounds_ascend_and_number(values, p):
    v = sorted(values)
    b = partitioning.range_bounds(v, p)
    assert b == sorted(set(b)) and len(b) == (p - 1 if len(v) >= p else len(v))


@given(st.integers(0, 30), st.text(max_size=5))
def test_spread_order_is_a_permutation(n, seed):
    order = partitioning.spread_order(n, seed)
    assert sorted(order) == list(range(n)) if n else order in ([], [0, -1])


def test_partition_config():
    by, said = partitioning.partition_config({"from": "x", "columns": "a", "partitions": 4, "async": True})
    assert by == partitioning.PartitionBy("x", ("a",), 4, True) and not said
    assert partitioning.partition_config({"from": "x", "columns": ["a"]})[1] == []
    assert partitioning.partition_config({"columns": ["a"]})[0] is None and partitioning.partition_config(None) == (None, [])
    assert partitioning.partition_config({"from": "x", "columns": ["a"], "partitions": "many"})[1]


def test_literals(spark):
    for v in ("it's \\", 3, 2.5, float("nan"), True, decimal.Decimal("1.50"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6)):
        got = spark.sql(f"select {partitioning.sql_literal(v)} as v").first()["v"]
        assert got == v or (got != got and v != v)


@pytest.mark.parametrize("name,current,wanted,expected", [("add_v2", "2", "1", "add_v1"), ("add_v2", "2", "0", "add"), ("add", None, "3", "add_v3"), ('"Add_V2"', "2", "1", '"Add_V1"'), ("add_v2", "1", "3", "add_v2_v3")])
def test_version_alias(name, current, wanted, expected):
    assert routines.version_alias(name, current, wanted) == expected


def test_routine_texts():
    assert routines.parameters("x int, y decimal(3, 1), z varchar(5)") == [("x", "bigint"), ("y", "decimal(3, 1)"), ("z", "string")]
    assert routines.parameters(["a float", "b array<int>"]) == [("a", "double"), ("b", "array<int>")] and routines.parameters(None) == []
    assert routines.table_columns("TABLE(a int, b varchar)") == "a bigint, b string" and routines.table_columns("int") is None and routines.table_columns("table()") == ""
    assert routines.clauses({"language": "python", "handler": "'f'"})[1] == {"language": "python", "handler": "f"}
    assert routines.clauses(["language python", {"handler": "'f'"}, "immutable"])[1]["language"] == "python"
    d = routines.definition_verb
    assert [d(None, {}, None, False), d({"a": 1}, {"a": 2}, False, False), d({"a": 1}, {"a": 1}, False, True), d({"a": 1}, {"a": 1}, True, True)] == ["replace", "replace", "alter", "keep"]


def test_grants():
    wanted = grants.wanted_grants({"SELECT": ["a", '"b"'], "insert": "a"})
    assert wanted == {("A", "select"), ('"b"', "select"), ("A", "insert")}
    assert grants.grant_delta(wanted, {("A", "select"), ("C", "select")}) == {"grant": {'"b"': ["select"], "A": ["insert"]}, "revoke": {"C": ["select"]}}
    assert grants.grant_delta(wanted, wanted) == {"grant": {}, "revoke": {}}
