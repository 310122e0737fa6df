"""SimHash fingerprints of texts and search within a Hamming radius, with DataFrame functions only.

A text's terms are its word shingles, hashed to 64 bits.  Every occurrence votes with the term's weight, for each bit
up or down; the sign of the sum is the fingerprint's bit.  Votes for bit i and bit i + 32 share one 64-bit sum, so 32
sums a text do for 64 bits.

Search cuts the 64 bits into blocks.  Fingerprints within `radius` agree in all but `radius` blocks, so each choice of
blocks to agree makes a table keyed by those blocks' bits (the permuted block tables), and candidates are verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_lower

BITS = 64
_PAIR = (1 << 32) | 1


def tokens(text: Column) -> Column:
    """A text's words, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def terms(words: Column, width: int) -> Column:
    """(hash, weight) of each run of `width` words of a token column; of the whole sequence when it is shorter.

    The weight is the number of code points of the term's first word, 1 to 15: longer words say more.  The words must
    be a column by then, not an expression: it is read once for each term.
    """
    count = F.size(words)
    weight = lambda w: F.least(F.greatest(F.char_length(w), F.lit(1)), F.lit(15)).cast("long")
    runs = F.transform(F.sequence(F.lit(0), count - width), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), weight(F.get(words, i)).alias("w")))
    whole = F.array(F.struct(F.xxhash64(words).alias("h"), weight(F.get(words, F.lit(0))).alias("w")))
    return F.when(count >= width, runs).when(count > 0, whole)


def fingerprints(df: DataFrame, key: list[str], text: str, words: int = 5, out: str = "fingerprint") -> DataFrame:
    """One row for each distinct `key` with its fingerprint as a long; rows of one key vote together.

    Null, empty and blank texts have no terms: their fingerprint is 0.  A bit whose votes balance is 0.
    """
    split = df.select(*key, tokens(F.col(text)).alias("__words"))
    votes = split.select(*key, F.explode_outer(terms(F.col("__words"), words)).alias("t")).select(*key, F.col("t.h").alias("h"), F.coalesce("t.w", F.lit(0)).alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"s{i}") for i in range(32)]
    counted = votes.groupBy(*key).agg(F.sum("w").alias("all"), *sums)
    low = lambda i: F.coalesce(F.col(f"s{i}"), F.lit(0)).bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda i: F.shiftrightunsigned(F.coalesce(F.col(f"s{i}"), F.lit(0)), 32)
    bit = lambda votes, at: F.when(2 * votes > F.col("all"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    parts = [bit(low(i), i) for i in range(32)] + [bit(high(i), i + 32) for i in range(32)]
    folded = parts[0]
    for p in parts[1:]:
        folded = folded.bitwiseOR(p)
    return counted.select(*key, folded.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of the 64 bits in which two fingerprints agree."""
    return (BITS - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def hamming_search(queries: DataFrame, fingerprinted: DataFrame, radius: int = 3, blocks: int = 6, column: str = "fingerprint") -> DataFrame:
    """(query, found, distance): for each distinct query fingerprint, the distinct fingerprints within `radius`, itself included.

    `blocks` must exceed `radius`; there are C(blocks, radius) tables, each keyed by 64 * (blocks - radius) / blocks bits.
    Equal fingerprints are one row, however many documents have them; join back on the fingerprint.  Null fingerprints are
    left out, empty tables give no rows.  Every table is a plain equi-join, whose large keys Spark can split.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keep = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, name: str) -> DataFrame:
        value = F.col(name)
        keys = [F.struct(F.lit(t).alias("t"), value.bitwiseAND(F.lit(_mask(edges, chosen))).alias("k")) for t, chosen in enumerate(keep)]
        return df.select(F.col(column).alias(name)).filter(value.isNotNull()).distinct().select(name, F.explode(F.array(*keys)).alias("b"))

    # merged, as Spark would judge a broadcast by the fingerprints before each became a row of every table
    met = tables(queries, "query").hint("merge").join(tables(fingerprinted, "found"), "b")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    return met.filter(distance <= radius).select("query", "found", distance.alias("distance")).distinct()


def _mask(edges: list[int], chosen: tuple[int, ...]) -> int:
    """The chosen blocks' bits as a signed 64-bit number."""
    bits = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
    return bits - (1 << 64) if bits >> 63 else bits
