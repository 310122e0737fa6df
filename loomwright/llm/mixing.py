"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every source has a target number of words.  Whole epochs of the source come first; what is left of the target is
filled in the order of the keys u ** (1 / quality), largest first, u being a hash of the document's key.  The keys are
held as -ln(u) / quality, least first: the same order, and no quality is so low that keys underflow and tie.  The order
is cut by a prefix sum: a document enters when its middle word does not pass the target.

No task sorts a source.  The cut of each source is found level by level: bins between quantiles of all keys, finer ones
while many rows are left, single keys, and among rows that tie a hash of the whole row.  At each level the sums show
where the cut lies, and only those rows go on.  Rows alike in all columns are counted, and where the cut falls among
them it is placed by their number.  The documents themselves are never shuffled: they meet one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import WORD_REGEX, key_string, small, stash, unit_hash

#: Bins of each of a text's marks at most.
BINS = 16


def quality_bins(text: Column) -> list[Column]:
    """Four marks of a text as small whole numbers: its shares of signs, of capitals and of distinct words, and its words' length."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD_REGEX), F.lit(0))
    n, chars = F.size(words) + 1, F.char_length(body)
    share = lambda x, y, most: F.least(F.lit(most), F.floor(x / y).cast("int"))
    signs, capitals = (F.regexp_count(body, F.lit(r)) for r in (r"[#*$%&|<>!]", "[A-Z]"))
    return [share(8 * signs, n, 7), share(16 * capitals, chars + 1, 7), share(8 * F.size(F.array_distinct(words)), n, 8), share(chars, n, 15)]


def fit_quality(df: DataFrame, labels: DataFrame, bins: list[str], key: str = "doc_id", label: str = "quality") -> Column:
    """The likelihood that a row is labelled 1, from its bins, by counts of both labels in each bin (naive Bayes, each count one more).

    All labelled rows count; a key with several labels has the largest, null keys and labels are none.  What is collected
    is a row for each bin and label.  Without labels every row has the same quality.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__lkey")).agg(F.max(label).cast("int").alias("__label"))
    each = df.select(key, *bins).join(marks, F.col(key) == F.col("__lkey"))
    told = each.select("__label", F.explode(F.array(*[F.struct(F.lit(i).alias("mark"), F.col(b).cast("int").alias("bin")) for i, b in enumerate(bins)])).alias("x"))
    counts = {(r["mark"], r["bin"], r["__label"]): r["count"] for r in told.groupBy("x.mark", "x.bin", "__label").count().collect()}
    of = [sum(n for (mark, _, label_), n in counts.items() if mark == 0 and label_ == k) for k in (0, 1)]
    odds: Column = F.lit((of[1] + 1) / (of[0] + 1))
    for i, b in enumerate(bins):
        ratios = [((counts.get((i, k, 1), 0) + 1) / (of[1] + BINS)) / ((counts.get((i, k, 0), 0) + 1) / (of[0] + BINS)) for k in range(BINS)]
        odds = odds * F.get(F.array(*map(F.lit, ratios)), F.col(b))
    return odds / (1 + odds)


def source_targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Targets from one row per source (__src, source_size): weights repeat by source name, null last; all sizes are shared.

    A target stops at cap x size and the excess is reshared by weight.  Sources ordered by cap x size / weight are capped
    from the front, so one running sum finds them.  The table has one row per source of the mixture, in one window.
    """
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.partitionBy().orderBy(F.col("__src").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    weighed = weighed.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    by_fill = W.partitionBy().orderBy(F.col("__cap") / F.col("__w"), F.col("__src").asc_nulls_last())
    ahead = by_fill.rowsBetween(W.unboundedPreceding, -1)
    on = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(ahead), F.lit(0.0))
    filled = weighed.withColumn("__left", left).withColumn("__wsum", F.sum("__w").over(on))
    filled = filled.withColumn("__full", F.col("__cap") * F.col("__wsum") <= F.col("__left") * F.col("__w"))
    total = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(every)
    return filled.select("__src", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(total * F.col("__w") / open_weight).alias("target"))


def key_bin(df: DataFrame, draw: str, bins: int) -> Column:
    """The bin of a key, of at most `bins`: how many of the quantiles of all keys are at most the key.  It never decreases with the key."""
    shares = [i / bins for i in range(1, bins)]
    got = df.agg(F.percentile_approx(draw, shares, max(10_000, 10 * bins)).alias("cuts")).first()["cuts"] if shares else None
    cuts = sorted(set(got or []))
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.col(draw), at + step).otherwise(at))


def cut_level(rows: DataFrame, level: str, edge: DataFrame, count: int, sums: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One level nearer to the cuts: the new edge and the rows (__src, __n, ...) at it.

    `edge` has one row per source, (__psrc, __rest, __before): the words wanted and those of the rows known to come
    first.  The new one also has the value of `level` in which the wanted words end, and __m, the number of rows there.
    """
    sums = rows.groupBy("__src", level).agg(F.sum("__n").alias("__sum"), F.count(F.lit(1)).alias("__m")) if sums is None else sums
    ahead = W.partitionBy("__src").orderBy(level).rowsBetween(W.unboundedPreceding, -1)
    met = sums.join(small(edge, count), F.col("__src").eqNullSafe(F.col("__psrc"))).withColumn("__ahead", F.col("__before") + F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))
    here = met.filter((F.col("__ahead") < F.col("__rest")) & (F.col("__ahead") + F.col("__sum") >= F.col("__rest")))
    found = stash(here.select("__psrc", "__rest", F.col("__ahead").alias("__before"), F.col(level).alias("__value"), "__m"), "mix-edge")
    near = rows.join(small(found.select("__psrc", "__value"), count), F.col("__src").eqNullSafe(F.col("__psrc")) & (F.col(level) == F.col("__value")), "left_semi")
    return found, near


def among_equals(tied: DataFrame) -> DataFrame:
    """Rows that are alike within a source, with __in: true for the first __take of them, by place in a stored copy.

    Blocks of the copy are counted, so that only the block in which the last taken row lies is ranked.
    """
    held = stash(tied.withColumn("__rid", F.monotonically_increasing_id()), "mix-equal").withColumn("__block", F.shiftright("__rid", 33))
    blocks = held.groupBy("__csrc", "__block").agg(F.count(F.lit(1)).alias("__size"))
    ahead = W.partitionBy("__csrc").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = stash(blocks.withColumn("__first", F.coalesce(F.sum("__size").over(ahead), F.lit(0))).withColumnRenamed("__csrc", "__bsrc").withColumnRenamed("__block", "__bblock"), "mix-blocks")
    placed = held.join(blocks, F.col("__csrc").eqNullSafe(F.col("__bsrc")) & (F.col("__block") == F.col("__bblock")))
    whole, none = F.col("__first") + F.col("__size") <= F.col("__take"), F.col("__first") >= F.col("__take")
    rank = F.row_number().over(W.partitionBy("__csrc", "__block").orderBy("__rid"))
    names = tied.columns
    return placed.filter(whole | none).select(*names, whole.alias("__in")).unionByName(placed.filter(~whole & ~none).select(*names, (F.col("__first") + rank <= F.col("__take")).alias("__in")))


def mix_sources(df: DataFrame, *, size: str, quality: Column, weights: list[float], source: str = "source", key: str = "doc_id", cap: float = 3.0, seed: str = "mix", bins: int = 4096, few: int = 1_000_000) -> DataFrame:
    """Add source_size (long), target (double) and copies (long): how often the mixture takes each document.

    `size` names a long column (null: 0).  A null source is a source, last in order.  Documents without words keep their
    epochs but count 0.  Rows that repeat a key are drawn at the same place and then ordered by a hash of all their
    columns (maps apart); rows alike in all of them are interchangeable, and as many enter as the target has room for.
    Each source's words come within one document of its target.  Keys are hashes, so reruns agree.  An empty table gives
    no rows.  Columns named like the outputs are replaced; names that begin with two underscores are the operator's own.
    """
    names = [c for c in df.columns if c not in ("source_size", "target", "copies")]
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    draw = -F.ln(unit_hash(F.concat(F.lit(f"{seed}#"), key_string(F.col(key), F.col(source))))) / quality
    drawn = df.select(*names, n.alias("__n"), draw.alias("__draw"), F.xxhash64(*[F.col(c) for c, t in df.dtypes if c in names and "map<" not in t], n).alias("__h"))
    rows = stash(drawn.select(F.col(source).alias("__src"), "__n", "__draw", "__h"), "mix-keys")
    binned = rows.withColumn("__bin", key_bin(rows, "__draw", bins))
    sums = stash(binned.groupBy("__src", "__bin").agg(F.sum("__n").alias("__sum"), F.count(F.lit(1)).alias("__m")), "mix-bins")
    targets = stash(source_targets(sums.groupBy("__src").agg(F.sum("__sum").alias("source_size")), weights, cap), "mix-targets")
    count = targets.count()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = targets.select(F.col("__src").alias("__psrc"), "source_size", "target", epochs.alias("__epochs"), (F.col("target") - epochs * F.col("source_size")).alias("__rest"))
    edge, near = cut_level(binned, "__bin", planned.select("__psrc", "__rest", F.lit(0).cast("long").alias("__before")), count, sums)
    near = stash(near.drop("__bin"), "mix-near")
    left = near.count()
    while left > few:
        binned = near.withColumn("__bin", key_bin(near, "__draw", bins))
        edge, finer = cut_level(binned, "__bin", edge.drop("__value", "__m"), count)
        near, before = stash(finer.drop("__bin"), "mix-near"), left
        left = near.count()
        if left == before:
            break
    edge, near = cut_level(near, "__draw", edge.drop("__value", "__m"), count)
    draws = edge.select("__psrc", F.col("__value").alias("__cut_draw"))
    if near.count() > few:
        edge, near = cut_level(near.withColumn("__part", F.shiftright("__h", 44)), "__part", edge.drop("__value", "__m"), count)
    edge, near = cut_level(near, "__h", edge.drop("__value", "__m"), count)
    each = near.groupBy(F.col("__src").alias("__nsrc")).agg(F.max("__n").alias("__each"))
    room = F.floor((F.col("__rest") - F.col("__before") - F.col("__each") / 2) / F.col("__each")) + 1
    cuts = edge.join(each, F.col("__psrc").eqNullSafe(F.col("__nsrc"))).select(F.col("__psrc").alias("__csrc"), F.col("__value").alias("__cut_h"), F.least(F.greatest(room, F.lit(0)), F.col("__m")).alias("__take"), "__m")
    cuts = stash(cuts.join(draws, F.col("__csrc").eqNullSafe(F.col("__psrc"))).drop("__psrc"), "mix-cuts")
    plan = stash(planned.join(small(cuts, count), F.col("__psrc").eqNullSafe(F.col("__csrc")), "left").drop("__rest"), "mix-plan")
    met = drawn.join(small(plan, count), F.col(source).eqNullSafe(F.col("__psrc")), "left")
    place, cut = F.struct(F.col("__draw").alias("d"), F.col("__h").alias("h")), F.struct(F.col("__cut_draw").alias("d"), F.col("__cut_h").alias("h"))
    at_cut = F.col("__cut_draw").isNotNull() & (place == cut)
    split = at_cut & (F.col("__take") > 0) & (F.col("__take") < F.col("__m"))
    chosen = F.col("__cut_draw").isNotNull() & ((place < cut) | (at_cut & (F.col("__take") > 0)))
    copies = lambda taken: (F.col("__epochs") + taken.cast("int")).cast("long").alias("copies")
    if plan.filter("__take > 0 and __take < __m").isEmpty():
        return met.select(*names, "source_size", "target", copies(chosen))
    tied = among_equals(met.filter(split))
    return met.filter(~split).select(*names, "source_size", "target", copies(chosen)).unionByName(tied.select(*names, "source_size", "target", copies(F.col("__in"))))
