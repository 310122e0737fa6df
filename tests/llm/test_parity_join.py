import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import parity_join
from loomwright.llm.components import connected_components
from loomwright.llm.shingle_sets import Bands, shingle_set, size_band


def sets_of(text):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, families, members, edits, size):
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(rng.randint(3, size))]
        for _ in range(rng.randint(1, members)):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,direct,chunk_bytes", [(1, 16, 8 << 20), (2, 2, 4_000), (3, 3, 20_000)])
def test_components_against_brute_force(spark, seed, direct, chunk_bytes):
    """Families with few edits link, with many they do not; small limits send them through every stage."""
    rows = corpus(seed, 12, 14, 6, 160)
    shared = " ".join(f"common{k}" for k in range(60))
    rows += [(len(rows) + k, f"{shared} " + " ".join(f"own{k}n{j}" for j in range(60))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(df, direct=direct, chunk_bytes=chunk_bytes).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("clash", [False, True])
def test_large_family_of_repeated_rows(spark, clash):
    """Far members link with the base alone, by parts that more than `direct` nodes share; repeated rows must not hide those parts."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(184)]
    variant = lambda f, at: " ".join(f"f{f}e{k}" if k in at else w for k, w in enumerate(base))
    rows = [(0, " ".join(base))] + [(f, variant(f, {rng.randrange(184)})) for f in range(1, 31)]
    rows += [(f, variant(f, {rng.randrange(10) + 40 * k + 10 for k in range(4)})) for f in range(31, 51)]
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    other = lambda f: " ".join(f"other{f}n{k}" for k in range(30 + 7 * f))
    again = [(f, other(f)) for f, _ in rows] if clash else rows
    df = spark.createDataFrame(rows + again, "doc_id long, text string")
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(df).collect()]
    extra = [(f, len(sets_of(t)), f) for f, t in again] if clash else [(f, *want[f]) for f in want]
    assert sorted(found) == sorted([(f, *want[f]) for f in want] + extra)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "word " * 50_000), (9, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n_shingles", F.lit(0))
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(df).collect()]
    assert sorted(x for x in found if x[0] is not None) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (8, 1, 8), (9, 1, 8)]
    assert [x for x in found if x[0] is None] == [(None, 1, None)]
    assert parity_join.jaccard_components(df.limit(0)).count() == 0


def test_sketches_never_miss():
    """Over random linked pairs: a signature is shared, and parity bits differ in no more places than the sets."""
    rng, bands = np.random.default_rng(3), Bands(80)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        met = set(bands.tables(len(a))) & set(bands.tables(len(b)))
        assert any(set(bands.signatures(a, t)) & set(bands.signatures(b, t)) for t in met)
        t = max(size_band(len(a)), size_band(len(b)))
        far = np.bitwise_count(np.frombuffer(bands.sketch(a, t), np.uint8) ^ np.frombuffer(bands.sketch(b, t), np.uint8)).sum()
        assert far <= len(a) + len(b) - 2 * both <= bands.differ(len(a) + len(b))


def test_shingles_match_words():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "Ä", "é", " x", "cc"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    kinds = defaultdict(set)
    for t in texts:
        assert len(shingle_set(t)) == len(sets_of(t))
        for h in shingle_set(t):
            kinds[int(h)].add(t)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (200, 202), (None, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and found[200] == found[201] == found[202] != found[0] and found[100] == 100


def plain_roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        x, y = find(int(i)), find(int(j))
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 60_000])
def test_large_family_with_many_components(spark, chunk_bytes):
    """5,000 variants of one text: those with few edits are one component, those with more stand alone or in twos and threes."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(64)]
    rows = []
    while len(rows) < 5_000:
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(64)] = f"e{rng.randrange(40)}"
        for _ in range(rng.choice([1, 1, 3])):
            mine = list(words)
            if rng.random() < 0.5:
                mine[rng.choice([0, 63])] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(mine)))
    ids = {}
    sets = [sorted({ids.setdefault(s, len(ids)) for s in sets_of(t)}) for _, t in rows]
    held = np.zeros((len(rows), len(ids)), np.float32)
    for i, s in enumerate(sets):
        held[i, s] = 1
    both, n = (held @ held.T), held.sum(axis=1)
    want = plain_roots(len(rows), 100 * both >= 80 * (n[:, None] + n[None, :] - both))
    assert len(set(want)) > 500
    found = {r["doc_id"]: r["component_id"] for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes).collect()}
    assert [found[i] for i in range(len(rows))] == want


def template_family(rng, size, words=60, own=8, pairs=0.0):
    """Texts of one template at a similarity of about 0.77, each with words of its own; a share of them comes twice, a word changed."""
    rows = []
    while len(rows) < size:
        text = [f"t{k}" for k in range(words)] + [f"own{len(rows)}x{k}" for k in range(own)]
        rows.append((len(rows), " ".join(text)))
        if rng.random() < pairs and len(rows) < size:
            rows.append((len(rows), " ".join([*text[:-1], "else"])))
    return rows


def test_members_that_do_not_link_do_not_meet(spark, monkeypatch):
    """Rows that reach the last groupings of a family with no links grow in proportion to its members, not with their square."""
    met = {}
    real, ringed = parity_join.ParityJoin.block_links, parity_join.ParityJoin.ringed
    for size in (500, 1000, 2000):
        seen = []
        monkeypatch.setattr(parity_join.ParityJoin, "block_links", lambda self, rows, by, seen=seen: (seen.append(rows.count()), real(self, rows, by))[1])
        monkeypatch.setattr(parity_join.ParityJoin, "ringed", lambda self, rows, seen=seen: (seen.append(rows.count()), ringed(self, rows))[1])
        df = spark.createDataFrame(template_family(random.Random(1), size), "doc_id long, text string")
        found = parity_join.jaccard_components(df, chunk_bytes=64 << 10).collect()
        assert all(r["component_id"] == r["doc_id"] for r in found) and len(found) == size
        met[size] = sum(seen)
    assert met[2000] <= 2.5 * max(met[1000], 1) and met[1000] <= 2.5 * max(met[500], 1), met


@pytest.mark.parametrize("levels", [0, 6])
def test_pairs_within_a_template(spark, monkeypatch, levels):
    """Copies with a word changed are found among a thousand texts of the same template; by rings alone as well."""
    monkeypatch.setattr(parity_join, "LEVELS", levels)
    rows = template_family(random.Random(2), 800, pairs=0.3)
    rng = random.Random(3)
    for k in range(120):  # subfamilies with a second template of their own, larger than what is paired at once
        rows.append((1000 + k, " ".join([f"t{j}" for j in range(60)] + [f"sub{k % 3}x{j}" for j in range(12)] + [f"mine{k}x{j}" for j in range(rng.choice([1, 2, 9, 14]))])))
    want = brute(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=32 << 10).collect()}
    assert found == want and 150 < sum(c != i for i, (_, c) in want.items())


@pytest.mark.parametrize("sides", [True, False])
def test_a_block_lets_out_a_forest(sides):
    rng = np.random.default_rng(1)
    deltas = [np.unique(rng.integers(0, 40, rng.integers(0, 24))) for _ in range(300)]
    main = rng.random(300) < 0.4
    root = np.where(main, 0, np.arange(1, 301) // 2 + 1)
    side = np.where(main, 0, 1) if sides else np.full(300, 2)
    group = parity_join.pd.DataFrame({"root": root, "n": 60, "main": main, "side": side, "delta": [d.astype(np.int64).tobytes() for d in deltas]})
    found = parity_join.forest(group, 80)
    linked = np.array([[180 * len(np.setxor1d(a, b)) <= 20 * 120 and not (sides and side[i] == side[j]) for j, b in enumerate(deltas)] for i, a in enumerate(deltas)])
    linked &= ~(main[:, None] & main[None, :])
    linked |= root[:, None] == root[None, :]
    want = plain_roots(300, linked)
    by_edges = np.eye(302, dtype=bool)
    for a, b in found:
        by_edges[min(a, b), max(a, b)] = True
    tops = plain_roots(302, by_edges)
    assert len({(want[i], tops[root[i]]) for i in range(300)}) == len(set(want)) == len({tops[r] for r in root})
    assert len(found) == len(set(root)) - len(set(want))


def test_nodes_that_share_a_digest_are_parted(spark):
    rows = [(1, 3, 7, 10), (2, 3, 7, 11), (3, 3, 7, 10), (4, 5, 8, 10), (5, 0, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long, node long, check long")
    found = {r["doc_id"]: r["node"] for r in parity_join.rekeyed(df).collect()}
    assert found[1] == found[3] != found[2] and found[4] == 8 and found[5] is None
    assert parity_join.rekeyed(df.filter("doc_id <> 2")) is None
