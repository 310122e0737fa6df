"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and gives the next
stage what it reads back.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import common, line_dedup, mixing, parity_join, quality, sentence_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the repetition rules keep.

    Null, empty and blank texts have no words and go.  Each row is judged by its text alone, so repeated rows stay or go
    together.  An empty table gives an empty one; columns other than those of documents go.
    """
    return quality.quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten documents hold; documents stay, with their new text and length.

    Every row counts as a document, repeated ones too.  Null texts become empty; blank lines stay.  A null or repeated
    doc_id is no obstacle.  An empty table gives an empty one; columns other than those of documents go.
    """
    done = line_dedup.drop_common_lines(docs.select(*COLUMNS))
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group linked by shingle sets; documents without an id or words stay.

    Of rows that repeat an id with the same text one stays.  An id that repeats with several texts goes if each of them
    links with a smaller id; else each of its texts stays once.  An empty table gives an empty one; columns other than
    those of documents go.
    """
    docs = docs.select(*COLUMNS)
    groups = parity_join.jaccard_components(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("component_id") != F.col("doc_id")).alias("linked"), F.count(F.lit(1)).alias("n"))
    marked = common.stash(groups.filter("linked or n > 1"), "pipeline-near")
    gone, twice = marked.filter("linked").select("doc_id"), marked.filter("not linked").select("doc_id")
    kept = docs.join(common.small(gone, gone.count(), parity_join.PICK_ROWS), "doc_id", "left_anti")
    count = twice.count()
    if not count:
        return kept.select(*COLUMNS)
    again = common.small(twice, count, parity_join.PICK_ROWS)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; those that it does not take go.

    A null source is a source of its own.  Documents without words weigh nothing: they are taken in whole epochs, and in
    the last part as their key falls, by a quality that is fitted on the labels of sf_dir.  Of rows alike in all columns as many
    are taken as fit.  An empty table gives an empty one; columns other than those of documents go.
    """
    names = ["__b0", "__b1", "__b2", "__b3"]
    marks = dict(zip(names, mixing.quality_bins(F.col("text")), strict=True))
    sized = docs.select(*COLUMNS).withColumns({"__size": common.word_count(F.col("text")), **marks})
    quality = mixing.fit_quality(sized, spark.read.parquet(f"{sf_dir}/labels.parquet"), names)
    mixed = mixing.mix_sources(sized, size="__size", quality=quality, weights=[5.0, 2.0, 1.0])
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's ids and their number.

    Null and empty texts have no ids; repeated rows have the same.  An empty table gives an empty one; columns other than
    those of documents and `ids` and `n_ids` go.
    """
    encoded = sentence_pieces.encode_pieces(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece ids", pieces_stage),
]

#: SQL cannot express the transducer and the sketch join; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.fresh_path(spark, f"pipeline-{name.split()[0]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
