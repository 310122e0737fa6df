"""Ranked search against scores added up term by term."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import lexical_search as search


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, k=10, multiplicity=True):
    """{item: [(score, doc_id), ...]}; rows of documents that repeat stay apart."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = {}
    for item, wanted in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum((times if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                scored.append((s, i))
        if scored:
            out[item] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
    return out


def found(docs, items, **options):
    out = defaultdict(list)
    for r in sorted(search.lexical_search(docs, items, **options).collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r["item_id"]]) + 1
        out[r["item_id"]].append((r["score"], r["doc_id"]))
    return dict(out)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("multiplicity", [True, False])
def test_the_tables_as_brute_force(spark, sf_dir, multiplicity):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [[(r[0], r["text"]) for r in df.collect()] for df in (docs, items)]
    assert found(docs, items, multiplicity=multiplicity) == plain(*rows, multiplicity=multiplicity)


def test_blocks_ties_and_repeats(spark, monkeypatch):
    """Small blocks of items and of documents, copies of documents, few words."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 7)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("AB Ab ab c d e-f É é 1 x".split()) for _ in range(n))
    docs = [(rng.randrange(60), text(rng.randrange(12))) for _ in range(150)]
    docs += docs[:30] + [(None, text(5)), (None, docs[0][1])]
    items = [(i, text(rng.randrange(9))) for i in range(25)] + [(3, "ab ab c")]
    df, asked = frames(spark, docs, items)
    for k, pairs in ((3, 20), (10, 10**6)):
        assert found(df.repartition(9), asked, k=k, block_pairs=pairs) == plain(docs, items, k)


def test_odd_rows(spark):
    long = "ünï " * 60_000 + "needle"
    docs = [(1, None), (2, ""), (3, "..."), (4, long), (4, long), (None, "needle"), (7, "Needle NEEDLE  x"), (8, "其他 words")]
    items = [(1, "needle"), (None, "needle ünï"), (2, None), (3, ""), (4, "absent"), (5, "其他")]
    df, asked = frames(spark, docs, items)
    df, asked = df.withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)), asked.withColumn("doc_id", F.lit(9))
    assert found(df, asked) == plain(docs, items)
    assert found(df.limit(0), asked) == {} and found(df, asked.limit(0)) == {}
    with pytest.raises(ValueError, match="block_pairs"):
        limit, search.BLOCK_BYTES = search.BLOCK_BYTES, 4
        try:
            search.lexical_search(df, asked)
        finally:
            search.BLOCK_BYTES = limit


def test_impacts_beyond_64_bits():
    n = np.array([10**9, 5], np.int64)
    docs, total = 3 * 10**10, 10**13
    assert search.impacts(np.array([7, 2], np.int64), n, docs, total).tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * x * docs // total)) for t, x in ((7, 10**9), (2, 5))]
