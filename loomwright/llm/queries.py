"""Queries over the whole tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm import common, language_id, lexical_search, line_dedup, mixing, neighbours, parity_join, quality, sentence_pieces, sharding, simhash, spelling, token_store, toxicity, warc_store

SHARDS = 40
#: Documents whose id this divides are searched for among all fingerprints.
SEARCHED = 20


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"))
    dealt = sharding.rendezvous_shard(sized, ["doc_id"], {s: 1.0 for s in range(SHARDS)}, {SHARDS: 1.0})
    slots = sharding.number_slots(dealt, "shard", ["doc_id"], SHARDS)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op2_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for each document whose id SEARCHED divides, how many other fingerprints of the table lie within three bits; else null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = neighbours.with_next(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    changed = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - moved), F.substr("next_text", F.lit(1), moved))
    edited = led.withColumn("edited", F.when(F.col("edge") == 0, changed))
    hashed = edited.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    key = ["range", "row", "edge", "doc_id", "n_chars", "edited_sha256"]
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))
    texts = hashed.select(*key, F.explode(versions).alias("x")).select(*key, "x.v", F.col("x.t").alias("body")).filter("v = 0 or edge = 0")
    found = simhash.fingerprints(texts, [*key, "v"], "body")
    rows = found.groupBy(*key).agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("changed"))
    following = F.lead("own").over(W.partitionBy("range").orderBy("row"))
    done = rows.withColumn("after", following).filter("edge = 0")
    done = common.stash(done.select("doc_id", "n_chars", "edited_sha256", "own", "changed", "after"), "simhash-rows")
    asked = (F.col("doc_id") % SEARCHED == 0) & F.col("own").isNotNull()
    met = simhash.hamming_search(done.filter(asked).select("own"), done.select("own"), column="own").filter("distance > 0")
    near = common.stash(met.groupBy(F.col("query").alias("own")).agg(F.count(F.lit(1)).alias("__near")), "simhash-near")
    rows = done.join(common.small(near, near.count()), "own", "left")
    as_text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        simhash.likeness(F.col("own"), F.col("changed")).alias("near_edited"), simhash.likeness(F.col("own"), F.col("after")).alias("near_next"),
        F.when(asked, F.coalesce("__near", F.lit(0))).alias("n_near"),
    )


def op3_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    marks = [m.alias(f"b{i}") for i, m in enumerate(mixing.quality_bins(F.col("text")))]
    sized = common.stash(docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), *marks), "mix-marks")
    mixed = mixing.mix_sources(sized, size="size", quality=mixing.fit_quality(sized, labels, ["b0", "b1", "b2", "b3"]), weights=[5.0, 2.0, 1.0])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, model), model)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = language_id.fit_text_model(docs, "text", "lang", "doc_id")
    host = language_id.host_of(F.col("url"))
    found = language_id.identify(
        pages.select("page_id", language_id.declared_language(F.col("html")).alias("declared"), host.alias("host"), language_id.domain_of(host).alias("domain"), language_id.suffix_of(F.col("url"), host).alias("suffix"), F.col("html").alias("text")),
        model, markup=True,
    )
    own = language_id.identify(docs.select("doc_id", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), F.lit("documents").alias("domain"), "text"), model, markup=False)
    columns = ["doc_id", "page_id", "language", "confidence", "text_language", "text_confidence", "declared", "host"]
    pick = lambda df, none: df.withColumn(none, F.lit(None).cast("long")).select(*columns)
    return pick(found, "doc_id").unionByName(pick(own, "page_id"))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    warc_store.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc_store.read_archive(spark, path).drop("url")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    token_store.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_token_files(spark, path).drop("ids")


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality.quality_rules(docs).drop("text")


def op10_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = line_dedup.drop_common_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search.lexical_search(docs, items, multiplicity=False)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_rendezvous_shards, op2_simhash_fingerprints, op3_mixed_sources, op4_sentence_pieces, op5_language_id, op6_parity_sketch_join, op7_warc_archive, op8_token_files, op9_repetition_rules, op10_common_lines, op11_spelling_variants, op12_lexical_search, op13_toxicity)}

ORACLES = {
    "op1_rendezvous_shards": r"""
        WITH RECURSIVE crc(n, k, c) AS (
            SELECT n, 0, n FROM range(256) r(n)
            UNION ALL
            SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
        tbl AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
        docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        sized AS (
            SELECT doc_id, CAST(strlen(body) + 16 AS BIGINT) AS size,
                xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
            FROM (SELECT doc_id, body, hex(encode(body)) AS h FROM docs), tbl),
        scored AS (
            SELECT doc_id, s AS shard, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || '#' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score
            FROM (SELECT DISTINCT doc_id FROM documents), range(41) r(s)),
        old AS (SELECT doc_id, arg_min(shard, (score, shard)) AS shard FROM scored WHERE shard < 40 GROUP BY doc_id),
        grown AS (SELECT doc_id, arg_min(shard, (score, shard)) AS shard FROM scored GROUP BY doc_id)
        SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, CAST(o.shard AS INTEGER) AS shard,
            row_number() OVER (PARTITION BY o.shard ORDER BY CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '\N')), 1, 13) AS BIGINT), d.doc_id NULLS FIRST, d.size, d.text_crc32) - 1 AS slot,
            CAST(g.shard AS INTEGER) AS grown_shard
        FROM sized d JOIN old o ON o.doc_id IS NOT DISTINCT FROM d.doc_id JOIN grown g ON g.doc_id IS NOT DISTINCT FROM d.doc_id""",
    "op3_mixed_sources": r"""
        WITH split AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        docs AS (
            SELECT rid, doc_id, source, CAST(len(l) AS BIGINT) AS size, least(7, 8 * len(regexp_extract_all(body, '[#*$%&|<>!]')) // (len(l) + 1)) AS b0,
                least(7, 16 * len(regexp_extract_all(body, '[A-Z]')) // (length(body) + 1)) AS b1, least(8, 8 * len(list_distinct(l)) // (len(l) + 1)) AS b2, least(15, length(body) // (len(l) + 1)) AS b3
            FROM split),
        marks AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
        told AS (SELECT d.*, m.y FROM docs d JOIN marks m ON d.doc_id = m.doc_id),
        n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM told),
        r0 AS (SELECT k, ((count(t.y) FILTER (t.y = 1) + 1)::DOUBLE / (any_value(n1) + 16)::DOUBLE) / ((count(t.y) FILTER (t.y = 0) + 1)::DOUBLE / (any_value(n0) + 16)::DOUBLE) AS r FROM range(16) x(k) CROSS JOIN n LEFT JOIN told t ON t.b0 = k GROUP BY k),
        r1 AS (SELECT k, ((count(t.y) FILTER (t.y = 1) + 1)::DOUBLE / (any_value(n1) + 16)::DOUBLE) / ((count(t.y) FILTER (t.y = 0) + 1)::DOUBLE / (any_value(n0) + 16)::DOUBLE) AS r FROM range(16) x(k) CROSS JOIN n LEFT JOIN told t ON t.b1 = k GROUP BY k),
        r2 AS (SELECT k, ((count(t.y) FILTER (t.y = 1) + 1)::DOUBLE / (any_value(n1) + 16)::DOUBLE) / ((count(t.y) FILTER (t.y = 0) + 1)::DOUBLE / (any_value(n0) + 16)::DOUBLE) AS r FROM range(16) x(k) CROSS JOIN n LEFT JOIN told t ON t.b2 = k GROUP BY k),
        r3 AS (SELECT k, ((count(t.y) FILTER (t.y = 1) + 1)::DOUBLE / (any_value(n1) + 16)::DOUBLE) / ((count(t.y) FILTER (t.y = 0) + 1)::DOUBLE / (any_value(n0) + 16)::DOUBLE) AS r FROM range(16) x(k) CROSS JOIN n LEFT JOIN told t ON t.b3 = k GROUP BY k),
        rated AS (
            SELECT d.*, ((n1 + 1)::DOUBLE / (n0 + 1)::DOUBLE) * r0.r * r1.r * r2.r * r3.r AS odds
            FROM docs d, n, r0, r1, r2, r3 WHERE r0.k = d.b0 AND r1.k = d.b1 AND r2.k = d.b2 AND r3.k = d.b3),
        keyed AS (
            SELECT *, -ln((CAST('0x' || substr(md5('mix#' || coalesce(CAST(doc_id AS VARCHAR), '\N') || chr(1) || coalesce(source, '\N')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
                / (odds / (1 + odds)) AS draw FROM rated),
        src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM src),
        filled AS (
            SELECT *, (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM weighed),
        flagged AS (SELECT *, cap * wsum <= remaining * w AS is_full FROM filled),
        targets AS (
            SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
                ((SELECT sum(source_size) FROM src) - coalesce((SELECT sum(cap) FROM flagged WHERE is_full), 0)) * w / (SELECT sum(w) FROM flagged WHERE NOT is_full) END AS target FROM flagged),
        planned AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM targets),
        ahead AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
        SELECT a.doc_id, a.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
            CAST(a.size * (p.epochs + CASE WHEN a.before + a.size / 2 <= p.target - p.epochs * p.source_size AND p.target - p.epochs * p.source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM ahead a JOIN planned p ON a.source IS NOT DISTINCT FROM p.source""",
    "op10_common_lines": r"""
        WITH lines AS (
            SELECT rid, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (
                SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
        kept AS (SELECT k.*, c.key IS NULL AS stays FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
        FROM kept GROUP BY rid""",
    "op7_warc_archive": r"""
        WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        facts AS (SELECT page_id, b, octet_length(b) AS payload_bytes, sha1(b) AS h FROM bodies),
        coded AS (
            SELECT page_id, payload_bytes, b, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), lambda x, y: x || y) AS payload_digest FROM facts),
        firsts AS (SELECT b, max(page_id) AS response FROM bodies GROUP BY b)
        SELECT c.page_id, CAST(c.payload_bytes AS BIGINT) AS payload_bytes, c.payload_digest, CASE WHEN c.page_id = f.response THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN c.page_id <> f.response THEN f.response END AS refers_to
        FROM coded c JOIN firsts f ON c.b = f.b""",
    "op6_parity_sketch_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
        flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
        SELECT s.doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id""",
}

ORACLES["op11_spelling_variants"] = r"""
    WITH RECURSIVE crc(n, k, c) AS (
        SELECT n, 0, n FROM range(256) r(n)
        UNION ALL
        SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
    tbl AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
    runs AS (
        SELECT rid, doc_id, run, count(*) AS c FROM (
            SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
        GROUP BY rid, doc_id, run),
    hashed AS (
        SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, tbl),
    slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM hashed),
    words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
    holes AS (SELECT word, n, i, length(word) AS len, substr(word, 1, CAST(i - 1 AS BIGINT)) || substr(word, CAST(i + 1 AS BIGINT)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT DISTINCT word, other, m FROM (
            SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION ALL SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
            UNION ALL SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word)),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    facts AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
        FROM words w LEFT JOIN best b USING (word)),
    led(word, last) AS (SELECT word, word FROM facts UNION ALL SELECT l.word, f.form FROM led l JOIN facts f ON l.last = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT l.word, l.last AS root FROM led l JOIN facts f ON l.last = f.word WHERE f.form IS NULL)
    SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM facts f JOIN ends e USING (word)"""

ORACLES["op12_lexical_search"] = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS l FROM documents),
    facts AS (SELECT count(*) FILTER (len(l) > 0) AS docs, CAST(sum(len(l)) AS BIGINT) AS terms FROM docs),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    held AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(l) AS BIGINT) AS n, unnest(l) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, term, n),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM facts) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held GROUP BY term),
    valued AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * f.docs) // f.terms))) AS v FROM held JOIN weights USING (term), facts f),
    scored AS (SELECT item_id, rid, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN valued USING (term) GROUP BY item_id, rid, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _quality_oracle() -> str:
    """Repetition rules with windows over words: one column a length for grams, their repeats and the words that these cover."""
    lengths = sorted({3, *(n for n in quality.COVERAGE if n)})
    grams = ", ".join(f"CASE WHEN lead(w, {n - 1}) OVER p IS NOT NULL THEN " + " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER p" for k in range(1, n))]) + f" END AS g{n}" for n in lengths)
    repeats = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 AS r{n}" for n in lengths)
    covers = ", ".join(f"coalesce(bool_or(r{n}) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS c{n}" for n in lengths)
    limits = {n: x for n, x in quality.COVERAGE.items() if n}
    shares = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n}), 0) / sum(length(w)) AS s{n}" for n in limits)
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
        words AS (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS l FROM docs)),
        grams AS (SELECT rid, pos, w, {grams} FROM words WINDOW p AS (PARTITION BY rid ORDER BY pos)),
        repeats AS (SELECT rid, pos, w, {repeats} FROM grams),
        covers AS (SELECT rid, w, {covers} FROM repeats),
        facts AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {shares} FROM covers GROUP BY rid),
        lines AS (SELECT rid, line, count(*) AS c FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
        dups AS (SELECT rid, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines, coalesce(sum(c * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (c > 1), 0) AS dup_chars FROM lines GROUP BY rid),
        base AS (
            SELECT d.doc_id, coalesce(f.n_words, 0) AS n_words, coalesce(f.word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(d.body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                coalesce(u.n_dup_lines, 0) AS n_dup_lines, coalesce(f.n_repeat_words, 0) AS n_repeat_words,
                coalesce(f.n_words, 0) < 50 OR 100 * f.n_repeat_words > 50 * f.n_words AS base_failed,
                CAST(coalesce(greatest({", ".join(f"s{n}" for n in limits)}), 0) AS DOUBLE) AS coverage, CAST(coalesce(u.dup_chars / f.word_chars, 0) AS DOUBLE) AS dup_line_share,
                greatest(1::DOUBLE, {quality.SHORT_WORDS}::DOUBLE / greatest(coalesce(f.n_words, 0), 1)) AS wider, {" AND ".join(f"coalesce(s{n}, 0) <= {x}::DOUBLE * wider" for n, x in limits.items())} AS fine
            FROM docs d LEFT JOIN facts f USING (rid) LEFT JOIN dups u USING (rid))
        SELECT * EXCLUDE (fine, wider), NOT base_failed AND fine AND dup_line_share <= {quality.COVERAGE[0]}::DOUBLE * wider AS kept FROM base"""


ORACLES["op9_repetition_rules"] = _quality_oracle()
