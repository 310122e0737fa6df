"""Ranked lexical search as a blocked sparse matrix product of items by terms with terms by documents.

A block of items is a sparse matrix: an item's term weighs its multiplicity times the term's weight over the corpus.  A
block of documents is one as well: a term's impact in a document, a 64-bit integer.  Their product is computed row by row
(Gustavson): an item's row is the sum of its terms' rows of documents.  Each task keeps the best k documents of an item
over the blocks that it has met, and Spark merges those.

Texts are read once for a block of items, which gives a table of postings (a document's length, and its counts of the
block's terms); everything else works on that table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import Stashes, ascii_lower, hash52, stash, text_batches

#: A term is a longest run of characters other than ASCII ones that are neither letters nor digits.
TERM_REGEX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 with A-Z lower-cased and everything that parts terms as a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Pairs of an item and a term in a block of items, on average; and bytes of a block's distinct terms that are broadcast at most.
BLOCK_PAIRS, BLOCK_BYTES = 500_000, 64 << 20
#: Documents of a block.
BLOCK_DOCS = 4096


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A term's impact by its count in a document of n terms, of `docs` documents with `terms` terms; integers, rounded down."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 62:
        share = np.array([90 * x * docs // terms for x in n.tolist()], np.int64)
    else:
        share = 90 * n * docs // max(1, terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + share))


class Ranked:
    """The best k documents of each item over all blocks so far: higher scores first, then smaller keys, null keys last."""

    def __init__(self, items: int, k: int):
        self.k = k
        empty = np.empty(0, np.int64)
        self.best = [(empty, empty, empty)] * items

    def add(self, item: int, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        s, i, z = (np.concatenate(x) for x in zip(self.best[item], (score, key, null), strict=True))
        order = np.lexsort((i, z, -s))[: self.k]
        self.best[item] = s[order], i[order], z[order]

    def least(self, item: int) -> int:
        """What a document must score at least to be among the best."""
        s = self.best[item][0]
        return int(s[-1]) if len(s) == self.k else 1


def multiply(ranked: Ranked, rows: tuple[np.ndarray, np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, null: np.ndarray, terms: int) -> None:
    """Add one block of documents: `rows` is the items' matrix, `docs` the documents', both as (starts, terms, values)."""
    starts, columns, values = docs
    order = np.argsort(columns, kind="stable")
    owner = np.repeat(np.arange(len(key)), np.diff(starts))[order]
    value = values[order]
    begin = np.searchsorted(columns[order], np.arange(terms + 1))
    first, at, weight = rows
    for item in range(len(first) - 1):
        total = np.zeros(len(key), np.int64)
        for k in range(first[item], first[item + 1]):
            low, high = begin[at[k]], begin[at[k] + 1]
            if low < high:
                total[owner[low:high]] += weight[k] * value[low:high]
        found = np.flatnonzero(total >= ranked.least(item))
        if len(found) > ranked.k:  # whatever ties with the k-th best stays for the order by key
            found = found[total[found] >= np.partition(total[found], -ranked.k)[-ranked.k]]
        if len(found):
            ranked.add(item, total[found], key[found], null[found])


def postings(docs: DataFrame, text: str, key: str, terms: list[str]) -> DataFrame:
    """(key, n, terms, counts): each document's number of terms, and which of `terms` it holds how often, by position."""
    spark = docs.sparkSession
    text_batches(spark)
    places = spark.sparkContext.broadcast({t.encode("utf-8"): i for i, t in enumerate(terms)})
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places.value.get
        for batch in batches:
            lengths, ids, counts = [], [], []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                words = (body or b"").translate(FOLDED).split()
                met = [(i, c) for w, c in Counter(words).items() if (i := find(w)) is not None]
                lengths.append(len(words))
                ids.append([i for i, _ in met])
                counts.append([c for _, c in met])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids, schema[2].type), pa.array(counts, schema[3].type)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(read, "key long, n long, terms array<int>, counts array<long>")


def search_block(posted: DataFrame, pairs: list, terms: list[str], k: int) -> DataFrame:
    """(item, key, score): up to k documents of each item from each task.  `pairs` are (item, term, times) rows."""
    spark = posted.sparkSession
    facts = posted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = held.select("term", F.floor(1000 * F.log((2 * F.lit(facts["docs"]) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    weights = np.zeros(len(terms), np.int64)
    for r in weighed.collect():  # one row for a term of the block
        weights[r["term"]] = r["w"]
    places, names = {t: i for i, t in enumerate(terms)}, sorted({r["item"] for r in pairs})
    number = {x: i for i, x in enumerate(names)}
    ordered = sorted((number[r["item"]], places[r["term"]], r["times"]) for r in pairs)
    columns = np.array([t for _, t, _ in ordered], np.int64)
    rows = np.searchsorted(np.array([i for i, _, _ in ordered]), np.arange(len(names) + 1)), columns, np.array([c for _, _, c in ordered], np.int64) * weights[columns]
    block = spark.sparkContext.broadcast((rows, len(terms), int(facts["docs"]), int(facts["terms"])))
    names_of = spark.sparkContext.broadcast(names)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, width, n_docs, n_terms = block.value
        ranked = Ranked(len(matrix[0]) - 1, k)
        for batch in batches:
            for low in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(low, BLOCK_DOCS)
                null = np.asarray(part.column(0).is_null().to_numpy(zero_copy_only=False), np.int64)
                key = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                lists, counts = part.column(2), part.column(3)
                starts = lists.offsets.to_numpy().astype(np.int64)
                starts = starts - starts[0]
                tf = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(starts))
                multiply(ranked, matrix, (starts, lists.flatten().to_numpy(zero_copy_only=False), impacts(tf, n, n_docs, n_terms)), key, null, width)
        for item, (score, key, null) in enumerate(ranked.best):
            if len(score):
                keys = pa.array(key, pa.int64(), mask=null.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array([names_of.value[item]] * len(score), pa.string()), keys, pa.array(score, pa.int64())], names=["item", "key", "score"])

    return posted.filter(F.size("terms") > 0).mapInArrow(multiplied, "item string, key long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", k: int = 10, multiplicity: bool = True, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_key, rank, key, score): the k best documents of each item with a score above 0, from rank 1.

    A score sums weight times impact over the item's terms: each as often as the item holds it, or once without
    `multiplicity`.  Equal scores rank by ascending key, null keys last; rows that repeat a key are documents of their own.
    Items that share a key are one item, a null key too.  Null and empty texts have no terms; such items, and items
    whose terms no document holds, give no rows, and so does an empty table.  Only the named columns are read.

    Items are the stated query set: they are dealt into blocks of about `block_pairs` pairs of an item and a term by a hash,
    and each block meets all documents.  What is broadcast is a block; one of more than BLOCK_BYTES of terms raises ValueError.
    """
    spark = docs.sparkSession
    held = Stashes(spark, "search")
    name = F.coalesce(F.concat(F.lit("="), F.col(item_key).cast("string")), F.lit(""))
    words = items.select(name.alias("item"), F.explode(F.regexp_extract_all(ascii_lower(F.col(item_text)), F.lit(TERM_REGEX), F.lit(0))).alias("term"))
    pairs = words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = held.put(pairs if multiplicity else pairs.withColumn("times", F.lit(1).cast("long")), "pairs")
    blocks = max(1, -(-pairs.count() // block_pairs))
    best: DataFrame | None = None
    for number in range(blocks):
        part = pairs.filter(F.pmod(hash52(F.col("item")), F.lit(blocks)) == number)
        size = part.select("term").distinct().agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
        if size > BLOCK_BYTES:
            raise ValueError(f"a block of items has {size} bytes of terms; take a smaller block_pairs")
        rows = part.collect()
        terms = sorted({r["term"] for r in rows})
        posted = held.put(postings(docs, text, key, terms), f"postings-{number}")
        found = search_block(posted, rows, terms, k)
        best = found if best is None else best.unionByName(found)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    some = best.withColumn("__part", F.spark_partition_id() % 256)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("item", "__part").orderBy(*order))).filter(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    kind = dict(items.dtypes)[item_key]
    named = F.when(F.col("item") != "", F.substr("item", F.lit(2)).cast(kind)).alias(item_key)
    out = stash(top.select(named, F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"), "search-best")
    held.drop()
    return out
