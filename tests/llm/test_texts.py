"""Quality rules, line dedup, token files, the archive and sentence pieces against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import common, line_dedup, quality, queries, sentence_pieces, token_store, warc_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " ", "\n", "\n\n", "one", "a b\na b\n\na b", "é ü " * 40, "x" * 5000, "same line\n" * 400, "# * $ %", "Tab\tand\x0bmore\r\n", " not blank "]


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    kept = not failed
    chars = sum(map(len, words))
    for n, limit in quality.COVERAGE.items():
        limit *= max(1.0, quality.SHORT_WORDS / max(1, len(words)))
        if n:
            g = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            inside = {i + k for i in range(len(words) - n + 1) if g[tuple(words[i : i + n])] > 1 for k in range(n)}
            kept = kept and (not chars or sum(len(words[i]) for i in inside) / chars <= limit)
        else:
            lines = Counter(x for x in text.split("\n") if WORD.search(x))
            kept = kept and (not chars or sum(c * sum(map(len, WORD.findall(x))) for x, c in lines.items() if c > 1) / chars <= limit)
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, kept


def test_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*EDGES, "a b c d e " * 30, "all different words here " + " ".join(map(str, range(90)))])] + [(None, "x y z " * 30)], "doc_id long, text string")
    df = docs.union(extra).withColumn("kept", F.lit("clash"))
    found = quality.quality_rules(df).collect()
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == plain_quality(r["text"])
    assert len(found) == df.count() and quality.quality_rules(df.limit(0)).count() == 0


def test_method_rejects_what_the_base_rules_pass(spark):
    """A quarter of the characters inside repeated n-grams or lines, with few repeated words by the base rule; short texts may repeat a passage."""
    word = lambda a, b: " ".join(f"w{i:04d}" for i in range(a, b))
    passage, line = word(1000, 1040), word(2000, 2009)
    rows = [(1, f"{word(0, 120)} {passage} {word(120, 240)} {passage} {word(240, 300)}"), (2, word(0, 400)), (3, "\n".join([word(0, 60), line, word(60, 120), line, word(120, 150)])), (4, "\n".join([line] * 4 + [word(0, 210)])), (5, f"{word(0, 300)} {line} {word(300, 600)} {line}")]
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {i: r["kept"] for i, r in found.items()} == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_quality_sql_on_rare_blanks(spark):
    """Vertical tabs, form feeds and carriage returns are blanks in the query and in its SQL."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "bb\x0b", "c\x0c", "dd\r\n", "e\n", "\x1c", "# "]) for _ in range(rng.randint(0, 90))) for _ in range(150)] + EDGES
    rows = [(i, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(queries.ORACLES["op9_repetition_rules"])
    names = want.columns
    found = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall())


def plain_lines(texts, least=10):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(4)
    lines = ["Common line", "common line ", "ÉTÉ", "été", "only here", "", " ", "x" * 3000, "nine"]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {i}" for _ in range(rng.randint(1, 6))) for i in range(60)] + EDGES + ["twice\ntwice"] * 10
    rows = [(None if i in (3, 4) else i // 2 if i > 70 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    found = line_dedup.drop_common_lines(df, batches=batches, fanout=fanout).collect()
    key = lambda r: tuple(map(str, r))
    want = [(i, t, *w) for (i, t), w in zip(rows, plain_lines(texts), strict=True)]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found), key=key) == sorted(want, key=key)
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for part in range(5):
        runs.add(spark.createDataFrame([(part, 1, 1), (part, part, 2), (part + 10, 1, 1)], "__id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [(r["h1"], r["h2"]) for r in runs.common().collect()] == [(1, 1)]
    batch = spark.createDataFrame([(9, 1, 1), (9, 5, 5)], "__id long, h1 long, h2 long").groupBy("h1", "h2").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = batch.join(runs._table(runs.levels[2][0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    runs.close()
    again = line_dedup.LineRuns(spark, min_docs=3, fanout=2, path=runs.path)
    assert again.levels == runs.levels and [(r["h1"], r["h2"]) for r in again.common().collect()] == [(1, 1)]
    again.add(spark.createDataFrame([(1, 3, 2), (2, 3, 2)], "__id long, h1 long, h2 long"))
    assert sorted((r["h1"], r["h2"]) for r in again.common().collect()) == [(1, 1), (3, 2)]
    again.close()


def test_lines_of_earlier_calls_count(spark, tmp_path):
    first, second = (spark.createDataFrame([(i, f"shared\nown {i}") for i in range(k, k + 6)], "doc_id long, text string") for k in (0, 10))
    for df, dropped in ((first, 0), (second, 1)):
        assert {r["n_dropped"] for r in line_dedup.drop_common_lines(df, path=f"{tmp_path}/runs").collect()} == {dropped}


def shared_lines(spark, ids, lines="shared", own=True):
    return spark.createDataFrame([(i, f"{lines}\nown {i}" if own else lines) for i in ids], "doc_id long, text string")


def dropped(df, **options):
    return sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.drop_common_lines(df, **options).collect())


def test_runs_are_asked_with_another_threshold(spark, tmp_path):
    """Counts of settled lines go on: 40 holders and two more are 42, at a threshold of 30 as at one of 43."""
    path = f"{tmp_path}/runs"
    for part in range(4):
        line_dedup.drop_common_lines(shared_lines(spark, range(part * 10, part * 10 + 10)), min_docs=10, path=path, batches=2, fanout=2)
    more = shared_lines(spark, (100, 101))
    assert dropped(more, min_docs=30, path=path) == [(100, 1), (101, 1)]
    assert dropped(shared_lines(spark, (102,)), min_docs=43, path=path) == [(102, 1)] and dropped(shared_lines(spark, (103,)), min_docs=45, path=path) == [(103, 0)]


def test_a_load_made_again_counts_once(spark, tmp_path, monkeypatch):
    """A crash between batches, or the same call again: finished batches are passed over."""
    path, five = f"{tmp_path}/runs", shared_lines(spark, range(5))
    real, calls = line_dedup.LineRuns.add, []

    def fail(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(line_dedup.LineRuns, "add", fail)
    with pytest.raises(OSError):
        line_dedup.drop_common_lines(five, min_docs=6, path=path, batches=4)
    monkeypatch.undo()
    for _ in range(2):
        assert {n for _, n in dropped(five, min_docs=6, path=path, batches=3)} == {0}
    assert {n for _, n in dropped(five, min_docs=5, path=path)} == {1}
    assert {n for _, n in dropped(five, min_docs=6, path=path, load="second")} == {1}


@pytest.mark.parametrize("step", ["written", "said"])
def test_a_crash_while_compacting(spark, tmp_path, monkeypatch, step):
    """Whether the merged run is written, or the manifest has it and the old runs are still there: lines count once."""
    path = f"{tmp_path}/runs"
    runs = line_dedup.LineRuns(spark, min_docs=6, fanout=2, path=path)
    batch = lambda low: spark.createDataFrame([(i, 1, 1) for i in range(low, low + 2)], "__id long, h1 long, h2 long")
    runs.add(batch(0))

    def stop(*args, **kwargs):
        raise OSError("lost")

    real, said = line_dedup.LineRuns._say, []
    if step == "written":
        monkeypatch.setattr(line_dedup.LineRuns, "_say", lambda self: stop() if said else (said.append(1), real(self))[1])
    else:
        monkeypatch.setattr(line_dedup.LineRuns, "_remove", stop)
    with pytest.raises(OSError):
        runs.add(batch(2))
    monkeypatch.undo()
    again = line_dedup.LineRuns(spark, min_docs=6, fanout=2, path=path)
    again.add(spark.createDataFrame([(9, 1, 1)], "__id long, h1 long, h2 long"))
    assert again.common().count() == 0
    again.add(spark.createDataFrame([(10, 1, 1)], "__id long, h1 long, h2 long"))
    assert again.common().count() == 1
    again.close()


def test_one_key_of_many_texts(spark):
    """Rows that share a key, or have none, carry their own common lines only."""
    rows = [(None if i % 2 else 7, f"line {i % 20}\nown {i}") for i in range(400)] + [(7, "line 3\nown 3")] * 3
    found = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 403 and {r["kept_text"] for r in found.filter("doc_id is null").collect()} == {f"own {i}" for i in range(1, 400, 2)}


def test_many_lines(spark):
    """A document of 100,000 lines that are common takes seconds, not minutes."""
    lines = [f"line {i}" for i in range(100_000)]
    df = spark.createDataFrame([(k, "\n".join([*lines[k:], "own"])) for k in range(3)], "doc_id long, text string")
    began = time.monotonic()
    found = {r["doc_id"]: r for r in line_dedup.drop_common_lines(df, min_docs=3, batches=1).collect()}
    assert time.monotonic() - began < 60
    assert [(found[k]["n_lines"], found[k]["n_dropped"], found[k]["kept_text"]) for k in range(3)] == [(100_001 - k, 99_999, "\n".join(lines[k:2])) for k in range(3)]


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(None if i == 2 else i // 3, t) for i, t in enumerate([*EDGES, "Hello, WORLD's best", "<|endoftext|> a<|startoftext|>b", "é ́x 　y\x1cz!", "word " * 30_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    token_store.write_token_files(df, f"{tmp_path}/t", path, 2, docs_per_file=3, part_bytes=200)
    found = token_store.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(found) == len(rows) and [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start, want = 0, Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[(i, len(ids) // 4, zlib.crc32(ids), ids)] += 1
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in found) == want
    some = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_store.read_documents(spark, f"{tmp_path}/t", [1, 4, 99]).collect())
    assert some == Counter({(i, n, ids): c for (i, n, _, ids), c in want.items() if i in (1, 4)})
    token_store.write_token_files(spark.createDataFrame([(i, f"long text {i} " * 2_000) for i in range(12)], "doc_id long, text string"), f"{tmp_path}/long", path, 2)
    assert bytes(spark.read.parquet(f"{tmp_path}/long/dictionary").first()["data"])[:4] == b"\x37\xa4\x30\xec"
    token_store.write_token_files(df.limit(0), f"{tmp_path}/e", path, 2)
    assert token_store.read_token_files(spark, f"{tmp_path}/e").count() == 0
    with pytest.raises(ValueError, match="dictionary"):
        token_store.file_index(token_store.pack_file([(1, b"x", 1)], bytes(32)), b"\1" * 32)


def test_archive(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "http://c\r\nx", None), (4, "http://d", ""), (6, "http://e", "é" * 90_000), (None, "http://f", "alone"), (None, "http://g", "same"), (7, "http://h", "tie"), (7, "http://h", "tie")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    warc_store.write_archive(df, f"{tmp_path}/w")
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_store.read_archive(spark, f"{tmp_path}/w").collect()), key=str)
    want = [(1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (6, 180_000, "response", None), (None, 5, "response", None), (None, 4, "revisit", 5), (7, 3, "response", None), (7, 3, "response", None)]
    assert found == sorted(want, key=str)
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 5
    records = [bytes(r["record"]) for r in warc_store.records(spark, f"{tmp_path}/w").collect()]
    assert len(records) == 10 and all(x.startswith(b"WARC/1.1\r\nWARC-Type: ") and x.endswith(b"\r\n\r\n") for x in records)
    fields, http, payload = warc_store.parse_record(next(x for x in records if b"page:6>" in x))
    assert payload.decode() == "é" * 90_000 and int(fields["content-length"]) == len(http) + 4 + 180_000
    with pytest.raises(ValueError, match="length"):
        warc_store.parse_record(records[0] + b"x")
    held = spark.read.parquet(f"{tmp_path}/w/payloads")
    spark.read.parquet(f"{tmp_path}/w/headers").write.parquet(f"{tmp_path}/bad/headers")
    held.withColumn("payload", F.when(F.length("payload") == 4, F.lit(b"sane")).otherwise(F.col("payload"))).write.parquet(f"{tmp_path}/bad/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc_store.read_archive(spark, f"{tmp_path}/bad").collect()
    warc_store.write_archive(df, f"{tmp_path}/m", min_bytes=4)
    assert {r["record_type"] for r in warc_store.read_archive(spark, f"{tmp_path}/m").filter("payload_bytes < 4").collect()} == {"response"}
    warc_store.write_archive(df.limit(0), f"{tmp_path}/n")
    assert warc_store.read_archive(spark, f"{tmp_path}/n").count() == 0


def test_pieces(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(i, t) for i, t in enumerate([*EDGES, "▁▁ a▁b", " " * 40, "漢字😀\x00", "ab" * 20_000])], docs.schema)).withColumn("ids", F.lit("clash"))
    rows = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(df, path), path).collect()
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "")
        assert r["decoded"] == library.decode(list(r["ids"])) and (r["decoded"] == (r["text"] or "") or "▁" in r["text"])
    assert sentence_pieces.encode_pieces(df.limit(0), path).count() == 0


def test_pieces_of_random_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    with open(path, "rb") as f:
        compiled = sentence_pieces.Transducer(f.read())
    for _ in range(4000):
        text = "".join(rng.choice("abcdehtonrs  \n▁éüñ漢😀.,'12BT\t-_=/#") for _ in range(rng.randint(0, 40)))
        assert compiled.encode(text).tolist() == library.encode(text)


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3, value])
    return out


def test_unigram_model_takes_the_least_path():
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("a", -1.5, 1), ("ba", -1.2, 1)]
    model = b"".join(_message((1, _message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces) + _message((2, _message((3, 1)))) + _message((3, _message((3, 1), (4, 1))))
    compiled = sentence_pieces.Transducer(model)
    assert [pieces[i][0] for i in compiled.encode("ab a")] == ["▁ab", "▁a"]
    assert [pieces[i][0] for i in compiled.encode("  aba ")] == ["▁a", "ba"]
    assert [pieces[i][0] for i in compiled.encode("aZ")] == ["▁a", "<unk>"]
    assert [pieces[i][0] for i in compiled.encode("漢字漢字 ab")] == ["<unk>", "▁ab"]
    with pytest.raises(ValueError, match="from 0 to 5"):
        sentence_pieces.Speller(model).decode([1, 6])
    with pytest.raises(ValueError, match="from 0 to 5"):
        sentence_pieces.Speller(model).decode([-1])


def test_unigram_models_against_the_library():
    """Models written down by hand, scores in quarters, with and without byte pieces."""
    rng = random.Random(7)
    for case in range(6):
        texts = sorted({"".join(rng.choice("▁abcé") for _ in range(rng.randint(1, 4))) for _ in range(25)} | set("ab"))
        pieces = [("<unk>", 0.0, 2)] + [(t, -rng.randint(4, 40) / 4, 1) for t in texts if "▁" not in t[1:]]
        if case % 2:
            pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
        model = b"".join(_message((1, _message((1, t.encode()), (2, s), (3, k)))) for t, s, k in pieces) + _message((2, _message((3, 1)) + (b"\x98\x02\x01" if case % 2 else b""))) + _message((3, _message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
        library, compiled = sentencepiece.SentencePieceProcessor(model_proto=model), sentence_pieces.Transducer(model)
        for _ in range(400):
            text = "".join(rng.choice("aabbccé zZ漢") for _ in range(rng.randint(0, 24)))
            assert compiled.encode(text).tolist() == library.encode(text), (case, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_models_with_a_character_map(rule):
    """The library's own maps, compiled here: normal forms, case, full-width letters, marks that join, control characters."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    pieces = [("<unk>", 0.0, 2)] + [(t, -k / 4, 1) for k, t in enumerate(["▁", "a", "b", "fi", "f", "i", "é", "▁a", "株", "1", "2", "⁄", "가", "s"], 1)]
    head = b"".join(_message((1, _message((1, t.encode()), (2, x), (3, k)))) for t, x, k in pieces) + _message((2, _message((3, 1))))
    size, varint = len(spec), []
    while size > 127:
        varint.append(size & 127 | 128)
        size >>= 7
    model = head + bytes([3 << 3 | 2, *varint, size]) + spec
    library, compiled = sentencepiece.SentencePieceProcessor(model_proto=model), sentence_pieces.Transducer(model)
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "B", "ﬁ", "é", "e\u0301", "Ａ", "㍿", "½", "\t", "\n", " ", "\u3000", "\u200b", "\u1100\u1161", "ß", "\x01", "Z", "ſ"]) for _ in range(rng.randint(0, 16)))
        assert compiled.encode(text).tolist() == library.encode(text), text


def test_op_queries_match_plain_versions(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op10_common_lines(spark, sf_dir).collect()}
    assert lines == {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for (i, _), (a, b, c) in zip(docs, plain_lines([t for _, t in docs]), strict=True)}
    assert all(r["round_trip"] for r in queries.op4_sentence_pieces(spark, sf_dir).collect())
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"]: r["payload_bytes"] for r in queries.op7_warc_archive(spark, sf_dir).collect()} == {i: len(h.encode()) for i, h in pages.items()}
    tokens = queries.op8_token_files(spark, sf_dir).orderBy("start").collect()
    assert [r["doc_id"] for r in tokens] == [i for i, _ in docs]


def test_stash_is_read_back(spark):
    df = common.stash(spark.range(10), "test")
    assert df.count() == 10 and df.dtypes == spark.range(10).dtypes
