import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_parity_join import brute
from test_texts import plain_lines, plain_quality

import corpus_pipeline


def test_each_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = held["quality rules"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if plain_quality(r["text"])[-1]}
    before, after = held["line dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: w[2] for r, w in zip(before, plain_lines([x["text"] for x in before]), strict=True)}
    before, after = held["n-gram Jaccard join"]
    groups = brute([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, (_, c) in groups.items() if i == c}
    before, after = held["mixing sources"]
    copies = Counter(r["doc_id"] for r in after)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    assert max(copies.values()) <= 3 and set(copies) <= set(words)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += words[r["doc_id"]]
        taken[r["source"]] += words[r["doc_id"]] * copies[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], words[r["doc_id"]])
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source], source
    before, after = held["SentencePiece ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(after) == len(before) and all(list(r["ids"]) == library.encode(r["text"]) and r["n_ids"] == len(r["ids"]) for r in after)


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Each source's words by weight, none above cap times its own: sources that are full are set aside until none overflows."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[o] for o in order if o not in full) for s in order if s not in full}
        over = {s for s, x in share.items() if x > cap * sizes[s]}
        if not over:
            return {**share, **{s: cap * sizes[s] for s in full}}
        full |= over


def test_stages_on_odd_rows(spark, tmp_path, sf_dir):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, extra columns; and empty tables."""
    words = lambda k, n: " ".join(f"w{k}n{j}" for j in range(n))
    a = words(1, 80)
    rows = [(1, a, "en", "s", 3), (2, f"{a} more", None, "s", None), (None, words(2, 70), "en", None, 1), (None, words(2, 70), "en", None, 1), (3, None, None, None, None), (4, "", "de", "s", 0), (5, " \n ", "de", "t", 3), (6, words(6, 60_000), "fr", "t", 1)]
    rows += [(7, words(7, 90), "fr", "t", 1)] * 3 + [(8, words(8, 60), "fr", "t", 1), (8, words(9, 60), "fr", "t", 1), (9, words(8, 60), "fr", "u", 1)] + [(20 + k, f"{words(30 + k, 55)}\nshared line", "en", "u", 5) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("ids", "kept", "n_lines", "copies", "__size", "component_id", "node", "target", "__id"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{tmp_path}/{k}")
        out[name] = spark.read.parquet(f"{tmp_path}/{k}").collect()
        assert empty.columns == done.columns and (done.columns == corpus_pipeline.COLUMNS or k == 4)
    ids = lambda name: Counter(r["doc_id"] for r in out[name])
    every = Counter(r[0] for r in rows)
    assert ids("quality rules") == every - Counter([3, 4, 5])
    assert ids("line dedup") == ids("SentencePiece ids") == every
    assert all("shared line" not in (r["text"] or "") and r["n_chars"] == len(r["text"]) for r in out["line dedup"])
    assert ids("n-gram Jaccard join") == every - Counter([2, 7, 7, 9])
    assert set(ids("mixing sources")) <= set(every) and max(ids("mixing sources").values()) <= 9
    assert all((r["n_ids"] == 0) == (not r["text"]) for r in out["SentencePiece ids"])
