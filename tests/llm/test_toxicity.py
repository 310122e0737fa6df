"""Restoring disguised words against all paths of a lattice, and scoring by held-out labels."""

import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomwright.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit_toxicity(docs, labels)


def costs(model):
    return toxicity.Reader(model.characters, {}).model


def test_likeliest_path_of_all(model):
    """The path that Viterbi's algorithm finds is the cheapest of all paths, priced one by one."""
    table = costs(model)

    def price(said):
        total, a, b = 0.0, 0, 0
        for letter in [*said, "\0"]:
            s = toxicity.symbol(letter)
            if s or b:
                total += table[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + s]
                a, b = b, s
        return total

    for stretch in ("1d10t", "st0p!d", "$tup1d$$", "sooon", "a.b-c", "m0r*n", "9lor1a", "the###", "x1", "é1è0"):
        parts = toxicity.lattice(stretch)
        said, cost = toxicity.likeliest(parts, table)
        best = min(sum(x for _, x in path) + price("".join(t for t, _ in path)) for path in itertools.product(*parts))
        assert cost == pytest.approx(best) and any("".join(t for t, _ in path) == said for path in itertools.product(*parts))


def test_disguises_are_undone(model):
    read = lambda text: toxicity.Reader(model.characters, {}).read(text)[0]
    for disguised in ("1d10t", "iiidiot", "i d i o t", "ID1OT", "id!ot", "i.d.i.o.t", "1 d 1 o t"):
        assert read(f"the {disguised} and") == "the idiot and", disguised
    assert read("stuuuupid $tupid stup1d") == "stupid stupid stupid" and read("that w0rthless thing") == "that worthless thing"


def test_plain_text_stays(model, spark, sf_dir):
    read = toxicity.Reader(model.characters, {}).read
    for text in ("", "one two", "it's a well-known e-mail.", "1999 and 2.0 (or 3)", "THE!! AND!!", "thoner$$$ the### and***", "a | b | c", "été, où?"):
        assert read(text)[0] == text.lower()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'").limit(40).collect():
        if re.fullmatch(r"[A-Za-z,.\n ]*", r["text"]) and not re.search(r"([a-z])\1\1|\b\w \w \w\b|[a-z][.,]+[a-z]", r["text"].lower()):
            assert read(r["text"])[0] == r["text"].lower()


def test_memory_of_tokens_is_bounded(model):
    small, large = (toxicity.Reader(model.characters, {"idio~": 0, "idiot": 1}, held) for held in (3, 10**6))
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["1d10t", "the", "thhhe", "a", "b", "idiot", "so", "0n", "x" * 9]) for _ in range(12))
        assert small.read(text) == large.read(text)


def test_characters_are_counted_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([("Abc déjà",), (None,), ("",), ("x" * 50 + " yz ж",)], "text string")
    counts = lambda: {r["gram"]: r["n"] for r in toxicity.trigram_counts(df.coalesce(1), "text").collect()}
    whole = counts()
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert counts() == whole and sum(whole.values()) > 60


def test_held_out_labels(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["h"]]
    toxic, clean = ([r["score"] for r in held if r["toxic"] == t] for t in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.93 and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)


def test_disguised_documents_score_as_plain_ones(spark, model):
    plain = "the idiot and that stupid moron of the worthless trash thing in there"
    disguised = "the 1d10t and that stuuupid m o r o n of the w0rthless tr@sh thing in there"
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame([(1, plain), (2, disguised), (3, "the thing and that of the in there")], "doc_id long, text string"), model).collect()}
    assert got[2] == pytest.approx(got[1]) and got[1] > 0.7 > 0.1 > got[3]


def test_held_out_labels_are_not_learnt(spark):
    """Turning the labels of held-out rows round changes no weight; labels that are null or belong to no text neither."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    more = spark.createDataFrame([(None, 1), (10**9, 1), (10**9 + 1, None)], "doc_id long, toxic int")
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, turned.select("doc_id", "toxic").unionByName(more.select("doc_id", F.col("toxic").cast(dict(labels.dtypes)["toxic"])))))
    assert a.weights == b.weights and a.bias == b.bias


def test_odd_rows(spark, model):
    long = "a b c " * 40_000 + "idiot"
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "idiot " * 30, None), (2, long, "z"), (2, long, "z"), (3, "\n \t", "w")], "doc_id long, text string, score string")
    rows = toxicity.score_toxicity(df, model, restored=True).collect()
    assert [f for f in rows[0].asDict()] == ["doc_id", "text", "score", "restored"] and len(rows) == 6
    empty = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in rows) and next(r for r in rows if r["doc_id"] is None)["score"] > 0.7
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    none = toxicity.fit_toxicity(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(df, none).filter("score = 0.5").count() == 6
