import math
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import language_id, queries

DOCS = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on four fifths of the documents, with their text alone the rest are told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit_text_model(docs.filter("doc_id % 5 <> 0"), "text", "lang", "doc_id")
    found = language_id.identify(docs.filter("doc_id % 5 = 0").select("doc_id", "text", F.col("lang").alias("truth")), model, markup=False)
    assert found.filter("language = truth").count() >= 0.97 * found.count()


def test_evidence_decides_where_text_is_silent(spark):
    labelled = spark.createDataFrame([(1, "the and of that with this", "en"), (2, "und der die das nicht", "de")] * 5, DOCS)
    model = language_id.fit_text_model(labelled, "text", "lang", "doc_id")
    rows = [(i, "und die der nicht das", "de", "de.example", "de.example", "example/de") for i in range(20)] + [(100 + i, "the of that and with", "en", "en.example", "en.example", "example/en") for i in range(20)]
    rows += [(200, "", "de", None, None, None), (201, None, None, "en.example", "en.example", None), (202, None, None, None, None, "example/de"), (203, "the of that", "de", "de.example", "de.example", "example/de"), (204, None, None, None, None, None), (204, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string").withColumn("language", F.lit(1))
    found = {r["id"]: r for r in language_id.identify(df, model, markup=False).collect()}
    assert [found[i]["language"] for i in (0, 100, 200, 201, 202)] == ["de", "en", "de", "en", "de"]
    assert found[203]["text_language"] == "en" and found[203]["language_scores"][0] > found[203]["language_scores"][1] * 0 and len(found) == 45
    assert all(abs(sum(r["language_scores"]) - 1) < 1e-9 for r in found.values())
    assert language_id.identify(df.limit(0), model, markup=False).count() == 0
    none = language_id.fit_text_model(labelled.limit(0), "text", "lang", "doc_id")
    assert language_id.identify(df, none, markup=False).filter("language is not null").count() == 0


def test_addresses_and_markup(spark):
    rows = [("http://www.a.example.de/fr/1?x", '<!DOCTYPE html><HTML class=x Lang=\'pt-BR\'>'), ("https://u:p@b.org:80/en", "<html><p lang=de>"), (None, None), ("no address", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    host = language_id.host_of(F.col("url"))
    found = df.select(host.alias("h"), language_id.domain_of(host).alias("d"), language_id.suffix_of(F.col("url"), host).alias("s"), language_id.declared_language(F.col("html")).alias("l")).collect()
    assert [tuple(r) for r in found] == [("www.a.example.de", "example.de", "de/fr", "pt"), ("b.org", "b.org", "org/en", None), (None, None, None, None), (None, None, None, None)]
    assert language_id.visible_text("<p>a<script>var x='<b>'</script>b<!-- c -->&amp;d").split() == ["a", "b", "d"]


def test_op5_covers_both_tables(spark, sf_dir):
    found = queries.op5_language_id(spark, sf_dir).collect()
    assert len(found) == 250
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sum(docs[r["doc_id"]] == r["language"] for r in found if r["doc_id"] is not None) >= 0.97 * len(docs)
    assert sum(r["declared"] is not None for r in found if r["doc_id"] is not None) == 0


def plain_fusion(rows, model, temper=60.0, strength=5.0, trust=2.0, floor=1e-3):
    """Posteriors row by row: every count is taken anew over the other rows."""
    langs = range(len(model.languages))

    def normal(logs):
        top = max(logs)
        w = [math.exp(x - top) for x in logs]
        return [x / sum(w) for x in w]

    likely = [list(model.scores(r["text"] or "", temper)) for r in rows]
    post = [normal(x) for x in likely]
    world = [sum(p[i] for p in post) for i in langs]
    prior = [(w + 1) / (sum(world) + len(world)) for w in world]
    out = []
    for at, r in enumerate(rows):
        logs = list(likely[at])
        for kind in ("declared", "suffix"):
            same = [k for k in range(len(rows)) if k != at and rows[k][kind] is not None]
            mine = [k for k in same if rows[k][kind] == r[kind]]
            if r[kind] is None or not mine:
                continue
            share = sum(map(sum, (post[k] for k in mine))) / max(len(same), 1.0)
            for i in langs:
                ratio = (sum(post[k][i] for k in mine) + trust * share) / (sum(post[k][i] for k in same) + trust) / share
                logs[i] += math.log(max(ratio, floor))
        counts = {c: [sum(post[k][i] for k in range(len(rows)) if k != at and r[c] is not None and rows[k][c] == r[c]) for i in langs] for c in ("domain", "host")}
        domain = [(counts["domain"][i] + strength * prior[i]) / (sum(counts["domain"]) + strength) for i in langs]
        logs = [x + math.log((counts["host"][i] + strength * domain[i]) / (sum(counts["host"]) + strength)) for i, x in enumerate(logs)]
        out.append(normal(logs))
    return out


def test_fusion_against_a_plain_version(spark):
    labelled = spark.createDataFrame([(1, "the and of that with this", "en"), (2, "und der die das nicht", "de"), (3, "le la les des une dans", "fr")] * 4, DOCS)
    model = language_id.fit_text_model(labelled, "text", "lang", "doc_id")
    words = ["the and", "und der", "les une", "of das la", "", None]
    rows = [{"id": i, "text": words[i * 7 % 6], "declared": ["en", "de", None, "fr", "xx"][i % 5] if i else "once", "suffix": ["com/en", "de", None][i * i % 3], "host": [f"h{i % 4}.a.com", "b.de", None][i % 3], "domain": ["a.com", "b.de", None][i % 3]} for i in range(40)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, text string, declared string, suffix string, host string, domain string")
    found = {r["id"]: r for r in language_id.identify(df, model, markup=False).collect()}
    for r, want in zip(rows, plain_fusion(rows, model), strict=True):
        assert found[r["id"]]["language_scores"] == pytest.approx(want, abs=1e-6)


def test_long_markup_takes_linear_time(spark):
    """A megabyte of openings without an end, for the visible text and for the declared language."""
    began = time.monotonic()
    for piece in ("<script>", "<!--", "<", "<!-- >", "<style", "&", "<noscript>x</script>", "<!-- --"):
        language_id.visible_text(piece * (1_000_000 // len(piece)))
    df = spark.createDataFrame([("<html " * 160_000,), ("<html" + " lang" * 200_000,), ("<HTMLX><html lang='pt-BR'>",)], "html string")
    assert [r[0] for r in df.select(language_id.declared_language(F.col("html"))).collect()] == [None, None, "pt"]
    assert time.monotonic() - began < 30


def test_visible_text_against_one_expression():
    markup = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
    import random

    rng = random.Random(3)
    for _ in range(3000):
        html = "".join(rng.choice(["<script>", "</SCRIPT >", "<p a=b>", "<!--", "-->", "x ", "<style", ">", "</style>", "&amp;", "&x", "<", "<noscript>", "</noscript>", "scripts"]) for _ in range(rng.randint(0, 14)))
        assert language_id.visible_text(html) == markup.sub(" ", html)
