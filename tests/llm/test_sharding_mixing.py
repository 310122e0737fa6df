import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import mixing, queries, sharding

DOCS = "doc_id long, text string, source string"


def test_new_shard_takes_rows_only_into_itself(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    rows = sharding.rendezvous_shard(df, ["doc_id"], {s: 1.0 for s in range(10)}, {10: 1.0}).collect()
    assert all(r["grown_shard"] in (r["shard"], 10) for r in rows)
    moved = sum(r["grown_shard"] == 10 for r in rows)
    assert 200 < moved < 350
    assert max(Counter(r["shard"] for r in rows).values()) < 390


def test_shares_follow_weights_and_removal_moves_only_its_rows(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    weights = {0: 1.0, 1: 2.0, 2: 5.0, 3: 0.0}
    before = {r["doc_id"]: r["shard"] for r in sharding.rendezvous_shard(df, ["doc_id"], weights).collect()}
    share = Counter(before.values())
    assert 3 not in share and abs(share[2] / 4000 - 5 / 8) < 0.04 and abs(share[0] / 4000 - 1 / 8) < 0.03
    after = {r["doc_id"]: r["shard"] for r in sharding.rendezvous_shard(df, ["doc_id"], {0: 1.0, 2: 5.0}).collect()}
    assert all(after[k] == s for k, s in before.items() if s != 1)
    with pytest.raises(ValueError, match="weight"):
        sharding.rendezvous_shard(df, ["doc_id"], {0: 0.0})


def test_sharding_edge_rows(spark):
    rows = [(None, None, "a"), (None, "x", None), (1, "", "a"), (1, "", "a"), (2, "y" * 200_000, "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("grown_shard", F.lit(0))
    done = sharding.rendezvous_shard(df, ["doc_id"], {s: 1.0 for s in range(4)}, {4: 1.0})
    found = done.collect()
    assert len(found) == 5 and len({r["shard"] for r in found if r["doc_id"] is None}) == 1
    slots = sharding.number_slots(done.select("doc_id", "shard", F.length("text").alias("n")), "shard", ["doc_id"], 4).collect()
    by_shard = defaultdict(list)
    for r in slots:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(slots) == 5
    alike = spark.range(250_001).select(F.lit(1).alias("doc_id"), F.lit(0).alias("shard"))
    assert sharding.number_slots(alike, "shard", ["doc_id"], 1).agg(F.count_distinct("slot"), F.min("slot"), F.max("slot")).first()[:] == (250_001, 0, 250_000)
    empty = done.limit(0).select("doc_id", "shard")
    assert sharding.number_slots(empty, "shard", ["doc_id"], 4).count() == 0


def test_op1_columns(spark, sf_dir):
    rows = queries.op1_rendezvous_shards(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40)


def brute_targets(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: cap * sizes[s] for s in full}
        open_ -= full
    return target


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", None, "d"][0 if i < 200 else i % 5]) for i in range(600)] + [(None, "x y", "a"), (1000, None, "b"), (1001, "", "b"), (1001, "", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    sized = df.withColumn("size", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
    mixed = mixing.mix_sources(sized, size="size", quality=F.lit(1.0), weights=[5.0, 2.0, 1.0], bins=8).collect()
    again = mixing.mix_sources(sized.repartition(7), size="size", quality=F.lit(1.0), weights=[5.0, 2.0, 1.0], bins=64).collect()
    key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["copies"]) for r in rs)
    assert key(mixed) == key(again) and len(mixed) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in mixed:
        sizes[r["source"]] += r["size"] or 0
        taken[r["source"]] += (r["size"] or 0) * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(dict(sizes), [5.0, 2.0, 1.0], 3.0)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 26 for s in sizes)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b") for i in range(1500)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(10).cast("long")).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1))
    mixed = mixing.mix_sources(df, size="size", quality=F.col("good"), weights=[1.0, 2.0]).filter("source = 'a'").collect()
    good, bad = (sum(r["copies"] for r in mixed if r["doc_id"] % 2 == k) for k in (0, 1))
    assert good > 2 * bad
    assert mixing.mix_sources(df.limit(0), size="size", quality=F.lit(1.0), weights=[1.0]).count() == 0


def test_long_words_are_drawn_not_taken_by_id(spark):
    """Keys of texts without blanks neither tie nor meet in one bin: the taken rows are the first in the order of -ln(u) / quality."""
    rows = [(i, "\u6587" * 100, "a" if i < 1200 else "b") for i in range(1600)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1).cast("long")).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 1 / 5000).otherwise(1 / 9000))
    mixed = mixing.mix_sources(df, size="size", quality=F.col("good"), weights=[1.0, 3.0]).filter("source = 'a'").collect()
    unit = {r["doc_id"]: (int(hashlib.md5(f"mix#{r['doc_id']}\u0001a".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for r in mixed}
    order = sorted(mixed, key=lambda r: -math.log(unit[r["doc_id"]]) / r["good"])
    taken = sum(r["copies"] for r in mixed)
    assert 300 < taken < 600 and {r["doc_id"] for r in order[:taken]} == {r["doc_id"] for r in mixed if r["copies"]}
    keys = df.select((-F.ln(F.rand(1)) / F.col("good")).alias("k"))
    assert max(r["count"] for r in keys.groupBy(mixing.key_bin(keys, "k", 64).alias("b")).count().collect()) <= 50


@pytest.mark.parametrize("few", [1_000_000, 20])
def test_repeated_rows_fill_the_target(spark, few):
    """400 rows without an id in one source, some alike in all columns, some not: the words taken come within a document of the target."""
    rows = [(None, "w " * (100 if i % 2 else 100 + i % 7), "a") for i in range(400)] + [(i, "v " * 90, "b") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.regexp_count("text", F.lit(r"\S+")).cast("long")).withColumn("__note", F.create_map(F.lit("k"), F.lit(1))).repartition(5)
    for seed in ("x", "y", "z"):
        mixed = mixing.mix_sources(df, size="size", quality=F.lit(1.0), weights=[1.0, 1.1], seed=seed, few=few, bins=16).collect()
        assert len(mixed) == 600
        for s in "ab":
            mine = [r for r in mixed if r["source"] == s]
            assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 107
    alike = spark.createDataFrame([(7, "x y z", "a")] * 300 + [(i, "x y z", "b") for i in range(300)], DOCS).withColumn("size", F.lit(3).cast("long"))
    mixed = mixing.mix_sources(alike.repartition(6), size="size", quality=F.lit(1.0), weights=[2.0, 3.0], few=few).collect()
    assert sum(3 * r["copies"] for r in mixed if r["source"] == "a") == pytest.approx(1800 * 2 / 5, abs=2)


def test_low_quality_is_spread_over_all_ids(spark):
    df = spark.createDataFrame([(i, "w", "a") for i in range(2000)] + [(i, "w", "b") for i in range(2000, 3000)], DOCS).withColumn("size", F.lit(1).cast("long"))
    mixed = mixing.mix_sources(df, size="size", quality=F.lit(1e-5), weights=[1.0, 1.5]).filter("source = 'a' and copies > 0").collect()
    ids = sorted(r["doc_id"] for r in mixed)
    assert 800 < len(ids) < 1600 and sum(i < 1000 for i in ids) == pytest.approx(len(ids) / 2, rel=0.12)


def test_quality_is_learnt_from_labels(spark):
    """Fitted on two thirds of the labelled rows it tells the others' labels; without labels all rows are alike."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    names = ["b0", "b1", "b2", "b3"]
    marked = docs.select("doc_id", *[m.alias(n) for n, m in zip(names, mixing.quality_bins(F.col("text")), strict=True)])
    assert marked.filter(" or ".join(f"{n} is null or {n} < 0 or {n} > 15" for n in names)).count() == 0
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    twice = labels.filter(~held).unionByName(spark.createDataFrame([(None, 1, 0), (10**9, 0, 0)], labels.select("doc_id", "quality", "toxic").schema))
    rows = marked.withColumn("q", mixing.fit_quality(marked, twice, names)).join(labels.filter(held), "doc_id").collect()
    good, bad = ([r["q"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert len(bad) > 5 and sum(a > b for a in good for b in bad) > 0.99 * len(good) * len(bad)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, " \n"), (2, "x" * 100_000), (3, "A! " * 50_000)], "doc_id long, text string")
    odd = odd.select("doc_id", *[m.alias(n) for n, m in zip(names, mixing.quality_bins(F.col("text")), strict=True)])
    assert {r["q"] for r in odd.withColumn("q", mixing.fit_quality(odd, labels.limit(0), names)).select("q").collect()} == {0.5}
