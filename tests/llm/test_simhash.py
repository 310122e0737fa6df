import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from loomwright.llm import neighbours, queries, simhash


def plain_simhash(text, width=5):
    """Votes counted bit by bit."""

    def fold(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[k : k + width] for k in range(len(words) - width + 1)] if len(words) >= width else [words] if words else []
    votes = [0] * 64
    for run in runs:
        h, w = fold(run), min(15, len(run[0]))
        for b in range(64):
            votes[b] += w if h >> b & 1 else -w
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_fingerprints_against_plain_votes(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10_000 + k, t) for k, t in enumerate([None, "", "one", "a b c d", "a b c d e", "A B c D e\tF\x0bg", "ÉTÉ été " * 9, "x" * 70 + " y z u v w"])]
    found = {r["doc_id"]: r["fingerprint"] & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], "text").collect()}
    assert found == {i: plain_simhash(t) for i, t in docs}


def test_fingerprints(spark):
    words = [f"word{i}" for i in range(400)]
    long = " ".join(words)
    rows = [(1, long), (2, long), (3, " ".join([*words[:380], *[f"x{i}" for i in range(20)]])), (4, " ".join(f"other{i}" for i in range(400))), (5, None), (6, ""), (7, " \n"), (8, "two words"), (9, "Two  WORDS"), (10, "a " * 150_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(df, ["doc_id"], "text").collect()}
    near = lambda a, b: 1 - ((found[a] ^ found[b]) & (2**64 - 1)).bit_count() / 64
    assert found[1] == found[2] and near(1, 3) > 0.75 > near(1, 4)
    assert found[5] == found[6] == found[7] == 0 and found[8] == found[9] != 0
    assert simhash.fingerprints(df.limit(0), ["doc_id"], "text").count() == 0


def test_hamming_search_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)} | {0, 2**64 - 1}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,), (signed[0],)], "fingerprint long")
    queries_ = spark.createDataFrame([(v,) for v in signed[::3]], "fingerprint long")
    found = {(r["query"], r["found"], r["distance"]) for r in simhash.hamming_search(queries_, df, radius=3).collect()}
    want = {(q, v, d) for q in signed[::3] for v in signed if (d := ((q ^ v) & (2**64 - 1)).bit_count()) <= 3}
    assert found == want


def test_next_row(spark):
    rows = [(i * 3 % 50, f"t{i}") for i in range(45)] + [(None, "n"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["range"], r["row"], r["doc_id"], r["text"], r["next_text"]) for r in neighbours.with_next(df, "doc_id", "text", rows_per_range=7).filter("edge = 0 and doc_id is not null").collect())
    want = sorted((r for r in rows if r[0] is not None))
    assert [(d, t) for _, _, d, t, _ in found] == want
    assert [n for *_, n in found] == [t for _, t in want[1:]] + ["n"]
    assert neighbours.with_next(df.limit(0), "doc_id", "text").count() == 0
    assert neighbours.with_next(df.limit(1), "doc_id", "text").filter("edge = 0").first()["next_text"] == rows[0][1]


def test_op2_columns(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in queries.op2_simhash_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    same = {}
    for k, (i, text) in enumerate(docs):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + docs[(k + 1) % len(docs)][1][:cut]
        r, n = rows[i], rows[docs[(k + 1) % len(docs)][0]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == 1 - (int(r["fingerprint"], 16) ^ int(n["fingerprint"], 16)).bit_count() / 64
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    values = {int(r["fingerprint"], 16) for r in rows.values()}
    for i, r in rows.items():
        assert r["n_near"] == (sum(0 < (v ^ int(r["fingerprint"], 16)).bit_count() <= 3 for v in values) if i % 20 == 0 else None)
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)
