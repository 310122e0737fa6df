"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows, min_chars=5, min_count=3, slip_every=97, factor=2):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip_every and h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


def found(df, **options):
    rows = spelling.spelling_variants(df, **options).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_the_table_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_many_tries_and_rounds(spark, monkeypatch):
    """Dense words over few letters, with tries and rounds so small that neighbours lie in others."""
    monkeypatch.setattr(spelling, "TRIE_WORDS", 40)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 3000)
    monkeypatch.setattr(spelling, "TASK_WORDS", 100)
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(600)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(600)], k=200))) for i in range(40)]
    expected = plain(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected and sum(r[1] is not None for r in expected) > 50


def test_automaton_beside_a_trie():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcß\U0001f600") for _ in range(rng.randint(1, 6))) for _ in range(700)})
    trie = spelling.Trie.load(spelling.Trie.build(words, list(range(1, len(words) + 1))).dump())
    order = sorted((w[::-1], i + 1) for i, w in enumerate(words))
    turned = spelling.Trie.build([w for w, _ in order], [n for _, n in order])
    for word in [*words[::7], "a", "zzzz", "abcabc", "ß" * 9]:
        expected = sorted((w, words.index(w) + 1) for w in words if one_edit(w, word))
        assert sorted(trie.near(word)) == expected == sorted(spelling.neighbours(word, [trie], [turned]))


def test_slips_forms_and_roots(spark):
    """Chains of forms end at the last; ties go to the smaller word; a form needs twice the count."""
    text = " ".join(["lettor"] * 3 + ["letter"] * 6 + ["better"] * 12 + ["bettar"] * 40 + ["worda"] * 6 + ["wordb"] * 6 + ["wordc"] * 3 + ["sound"] * 5 + ["round"] * 9)
    got = {r[0]: r[1:] for r in found(spark.createDataFrame([(1, text)], "doc_id long, text string"), slip_every=0)}
    assert got["lettor"] == ("letter", "bettar", 3, 1, 6) and got["better"] == ("bettar", "bettar", 12, 2, 40)
    assert got["wordc"] == ("worda", "worda", 3, 2, 6) and got["worda"] == (None, "worda", 6, 2, None)
    assert got["sound"] == (None, "sound", 5, 1, None)
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), form_factor=1)


def test_odd_rows(spark):
    long = "longword" * 700
    rows = [(None, "alpha alpha alpha"), (None, "ALPHA Ärger Ärger ärger Ärger"), (5, None), (6, ""), (6, "\n 123 ×÷ a b"), (7, f"{long} {long} {long} {long}x {long}x {long}x"), (7, "alphb " * 9), (7, "alphb " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    assert found(df) == plain(rows)
    assert found(df.limit(0)) == set() and found(df.filter("doc_id = 6")) == set()
