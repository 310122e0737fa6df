import random
from collections import Counter

from pyspark.sql import functions as F

from loomwright.llm import common, neighbours


def test_key_ranges_follow_the_key(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(10**12), 10**12) for _ in range(500)] + [7] * 300 + [None, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for ranges, cuts in ((1, 1024), (40, 1024), (60, 4), (5000, 16)):
        common.KeyRanges.CUTS = cuts
        try:
            cut = common.KeyRanges(df, "k", ranges)
            rows = df.select("k", cut.index(F.col("k")).alias("r")).collect()
        finally:
            common.KeyRanges.CUTS = 1024
        placed = [r["r"] for r in sorted((r for r in rows if r["k"] is not None), key=lambda r: r["k"])]
        assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] < cut.count <= 2 * ranges + cuts
        assert [r["r"] for r in rows if r["k"] is None] == [0]
    assert common.KeyRanges(df.limit(0), "k", 9).count >= 1


def test_broadcasts_stop_at_the_limit(spark):
    """At the limit a table is hinted for a broadcast, one row above it is not."""
    small, large = spark.range(10), spark.range(10)
    plan = lambda n: large.join(common.small(small, n), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(common.BROADCAST_ROWS) and "broadcast" not in plan(common.BROADCAST_ROWS + 1)


def test_tables_of_a_computation_go_together(spark):
    held = common.Stashes(spark, "test")
    paths = [held.put(spark.range(3), n).inputFiles()[0].rpartition("/")[0] for n in "ab"]
    assert all(common.list_path(spark, p) for p in paths)
    held.drop()
    assert not any(common.list_path(spark, p) for p in paths)


def test_a_key_that_fills_ranges_is_split(spark):
    """A third of the rows have one key and a third none: cut by a hash, no range holds many more rows than its share."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "k long, t string")
    for ranges in (60, 3_000):
        cut = common.KeyRanges(df, "k", ranges)
        found = df.select("k", cut.index(F.col("k"), F.xxhash64("t")).alias("r")).collect()
        assert max(Counter(r["r"] for r in found).values()) <= max(12, 4 * len(rows) // ranges) and max(r["r"] for r in found) < cut.count
        by_key = sorted((-1 if r["k"] is None else r["k"], r["r"]) for r in found)
        for (a, x), (b, y) in zip(by_key, by_key[1:]):
            assert x <= y
    led = neighbours.with_next(df, "k", "t", rows_per_range=100).filter("edge = 0").collect()
    assert len(led) == 6_000 and max(Counter(r["range"] for r in led).values()) <= 400
    order = sorted(led, key=lambda r: (r["range"], r["row"]))
    assert [r["next_t"] for r in order] == [r["t"] for r in order[1:]] + [order[0]["t"]]
