"""Jaccard self-join of word-shingle sets by parity sketches, down to connected components.

1. Each text becomes a set of hashed shingles; equal sets are one node.  A node has, for its size band, parity bits and
   the XOR sums of disjoint parts of its set.  Two sets that link agree in at least one of the parts that each puts
   forward (`Bands.signatures`), so grouping by part finds every link.
2. Parts that up to `direct` nodes share give all their pairs.  The nodes of larger groups are dealt again with the
   finest parts, one element each: all are counted, and each node puts forward its rarest ones.  The pigeonhole holds
   for any common order, and text that a whole family shares is passed over.
3. Candidates whose sketches differ in more bits than their sets may differ are no links.  The rest are verified on
   the sets of the texts.  Links are contracted into components.
4. A group that still is large becomes a star around its most usual node, its hub.  Every member meets the hub's set, in
   salted chunks, and is from then on known by its difference to the hub: two members differ in just the elements in
   which their differences do.  Where several components remain around a hub, its members meet in one block if that is
   small, and the block lets out no more than a spanning forest of exact links between components.
5. A larger family is centred on what most of its members hold, so that a difference is what is a member's own.  Two members
   whose differences are short enough together surely link, and then both link with the one that is nearest to the centre;
   any other two that link share elements of their differences, so again each puts forward its rarest ones, as many as the
   pigeonhole asks for.  Members of a template that do not link share none, and never meet.  Small groups give their
   pairs, larger ones are blocks, and what is larger still is a family again, with shorter differences.

No pair that can link is left out, copies are never paired, and members of one component are not paired further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Stashes, small
from loomwright.llm.components import connected_components
from loomwright.llm.shingle_sets import Bands, set_digest, shingle_set, size_band

#: Rows (node or doc_id, 16 bytes) that may be broadcast to pick texts out of the whole table.
PICK_ROWS = 500_000
SKETCHED = "doc_id long, n long, node long, check long, signatures array<long>, own binary, upper binary"
#: Rings of distance from a hub, and times that a family is taken apart by its members' own elements before rings are.
RINGS, LEVELS = 16, 6


def sketch_texts(df: DataFrame, text: str, key: str, words: int, bands: Bands) -> DataFrame:
    """SKETCHED rows: the set size, its two 64-bit digests as node and check (null for an empty set or a null key), signatures, parity bits.

    A set met again in the same task carries no signatures: copies need not be grouped more than once a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for doc_id, body in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                hashes = shingle_set(body, words)
                n = len(hashes)
                if n == 0 or doc_id is None:
                    out.append((doc_id, n, None, None, None, None, None))
                    continue
                digest = set_digest(hashes)
                if digest in seen:
                    out.append((doc_id, n, *digest, None, None, None))
                    continue
                seen.add(digest)
                tables = bands.tables(n)
                signatures = np.concatenate([bands.signatures(hashes, b) for b in tables])
                bits = [bands.sketch(hashes, b) for b in tables]
                out.append((doc_id, n, *digest, signatures, bits[0], bits[1] if len(bits) > 1 else None))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "node", "check", "signatures", "own", "upper"])
            for at, c in ((0, "doc_id"), (2, "node"), (3, "check")):
                frame[c] = pd.array([x[at] for x in out], "Int64")
            yield frame

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SKETCHED)


def rekeyed(rows: DataFrame) -> DataFrame | None:
    """The rows with other nodes where sets of different second digests share a node; None where none do."""
    clash = rows.filter("node is not null").groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("node", F.lit(True).alias("__met"))
    count = clash.count()
    if not count:
        return None
    met = rows.join(small(clash, count), "node", "left")
    return met.withColumn("node", F.when(F.col("__met"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(*rows.columns)


def star_rows(hub: int, group: pd.DataFrame, percent: int, with_hub: bool) -> pd.DataFrame:
    """Each member's distance and difference to the hub's set, and whether they link."""
    is_hub = group["node"].to_numpy() == hub
    centre = np.sort(np.asarray(group["hashes"][is_hub].iloc[0], np.int64))
    out = [(hub, hub, len(centre), 0.0, True, b"")] if with_hub else []
    for node, own in zip(group["node"][~is_hub], group["hashes"][~is_hub], strict=True):
        delta = np.setxor1d(centre, own, assume_unique=True)
        total = len(centre) + len(own)
        out.append((hub, int(node), len(own), 2 * len(delta) / (total + len(delta)), bool((100 + percent) * len(delta) <= (100 - percent) * total), delta.tobytes()))
    return pd.DataFrame(out, columns=["hub", "node", "n", "dist", "linked", "delta"])


def forest(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the roots of a block's rows (root, n, main, side, delta): a spanning forest of the exact ones.

    Rows of side 0 meet rows of side 1, or all rows meet where all are of side 2; two rows of the main root never do.
    """
    labels, lab = np.unique(group["root"].to_numpy(np.int64), return_inverse=True)
    n, main, side = group["n"].to_numpy(np.int64), group["main"].to_numpy(bool), group["side"].to_numpy()
    deltas = [np.frombuffer(x, np.int64) if isinstance(x, bytes) else np.asarray(x, np.int64) for x in group["delta"]]
    sizes = np.array([len(d) for d in deltas], np.int64)
    known, value = np.unique(np.concatenate(deltas), return_inverse=True)
    owner = np.repeat(np.arange(len(deltas)), sizes)
    by_value = np.argsort(value, kind="stable")
    postings = owner[by_value]
    first = np.concatenate(([0], np.cumsum(np.bincount(value, minlength=len(known)))))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    found = []
    fewer = 0 if (side == 0).sum() <= (side == 1).sum() else 1
    if main[side == fewer].any() and (side != 2).all():
        fewer = 1 - fewer  # the main root's rows are met, they do not look
    place = np.arange(len(deltas))
    for i in np.flatnonzero(~main & ((side == fewer) | (side == 2))):
        wanted = (lab != lab[i]) & ((side == 1 - fewer) | ((side == 2) & (main | (place > i))))
        if not wanted.any():
            continue
        at = value[begin[i] : begin[i + 1]]
        lengths = first[at + 1] - first[at]
        ends = np.cumsum(lengths)
        met = postings[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - lengths), lengths)]
        both = np.bincount(met, minlength=len(deltas))
        linked = wanted & ((100 + percent) * (sizes + sizes[i] - 2 * both) <= (100 - percent) * (n + n[i]))
        while linked.any():
            j = int(np.argmax(linked))
            found.append((int(group["root"].iloc[i]), int(group["root"].iloc[j])))
            lab[lab == lab[j]] = lab[i]
            linked &= lab != lab[i]
    return found


class ParityJoin:
    def __init__(self, df: DataFrame, text: str, key: str, words: int, percent: int, direct: int, chunk_bytes: int):
        self.df, self.text, self.key, self.words, self.direct, self.chunk_bytes = df, text, key, words, direct, chunk_bytes
        self.bands = Bands(percent)
        self.percent = percent
        self.kept, self.passing = Stashes(df.sparkSession, "parity"), Stashes(df.sparkSession, "parity")

    # -- sets of some nodes ------------------------------------------------------------

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, n, hashes) of each node, from its first document's text; rows of that doc_id with another text are passed over."""
        words = self.words
        wanted = self.passing.put(nodes.join(self.contents.select("node", "digest", "check", "doc_id"), "node").select("node", "digest", "check", F.col("doc_id").alias("__id")), f"{name}-wanted")
        docs = self.df.select(F.col(self.key).cast("long").alias("__id"), F.col(self.text).alias("text"))
        texts = docs.join(small(wanted, wanted.count(), PICK_ROWS), "__id").select("node", "digest", "check", "text")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for node, digest, check, body in zip(batch["node"], batch["digest"], batch["check"], batch["text"], strict=True):
                    hashes = shingle_set(body, words)
                    if set_digest(hashes) == (digest, check):
                        out.append((node, len(hashes), hashes.view(np.int64)))
                yield pd.DataFrame(out, columns=["node", "n", "hashes"])

        return self.passing.put(texts.mapInPandas(run, "node long, n long, hashes array<long>").dropDuplicates(["node"]), f"{name}-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by the sets of their texts."""
        percent = self.percent

        @F.pandas_udf("boolean")
        def linked(x: pd.Series, y: pd.Series) -> pd.Series:
            def one(u: np.ndarray, v: np.ndarray) -> bool:
                both = len(np.intersect1d(u, v, assume_unique=True))
                return 100 * both >= percent * (len(u) + len(v) - both)

            return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

        held = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pairs")
        met = pairs.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("__x")), "a").join(held.select(F.col("node").alias("b"), F.col("hashes").alias("__y")), "b")
        return met.filter(linked("__x", "__y")).select("a", "b")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parity bits differ in no more places than their sets may."""
        bands = self.bands

        @F.pandas_udf("boolean")
        def close(n1: pd.Series, o1: pd.Series, u1: pd.Series, n2: pd.Series, o2: pd.Series, u2: pd.Series) -> pd.Series:
            def one(n: int, own: bytes, upper: bytes | None, m: int, other: bytes, above: bytes | None) -> bool:
                if n > m:
                    n, own, upper, m, other, above = m, other, above, n, own, upper
                x = own if size_band(n) == size_band(m) else upper if size_band(n) + 1 == size_band(m) else None
                if x is None or 100 * n < bands.p * m:
                    return False
                return int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(other, np.uint8)).sum()) <= bands.differ(n + m)

            return pd.Series([one(*r) for r in zip(n1, o1, u1, n2, o2, u2, strict=True)], dtype=bool)

        side = lambda c, p: self.contents.select(F.col("node").alias(c), F.col("n").alias(f"{p}n"), F.col("own").alias(f"{p}own"), F.col("upper").alias(f"{p}upper"))
        met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return met.filter(close("xn", "xown", "xupper", "yn", "yown", "yupper")).select("a", "b")

    # -- candidate groups ------------------------------------------------------------

    def grouped(self, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """From distinct (sig, node, rare): all pairs of groups of up to `direct`, and the members of larger ones with their hub.

        The hub is the node with fewest rare parts of its own, the one most like the rest.
        """
        sizes = self.passing.put(members.groupBy("sig").agg(F.count(F.lit(1)).alias("g"), F.min("rare").alias("least")).filter("g > 1"), f"{name}-sizes")
        few = self.passing.put(members.join(sizes.filter(F.col("g") <= self.direct).select("sig"), "sig"), f"{name}-few")
        pairs = few.select("sig", F.col("node").alias("a")).join(few.select("sig", F.col("node").alias("b")), "sig").filter("a < b").select("a", "b").distinct()
        many = self.passing.put(members.join(sizes.filter(F.col("g") > self.direct).select("sig", "least"), "sig"), f"{name}-many")
        hubs = many.filter("rare = least").groupBy("sig").agg(F.min("node").alias("hub"))
        large = self.passing.put(many.join(hubs, "sig").select("hub", "node").distinct(), f"{name}-large")
        return pairs, large

    def rarest(self, held: DataFrame) -> DataFrame:
        """Distinct (sig, node, rare): the elements that the nodes put forward when those rarest among them come first, if shared."""
        each = held.select("node", "n", F.explode("hashes").alias("sig"))
        counts = self.passing.put(each.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "counts")
        ordered = each.join(counts, "sig").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "sig"))).alias("p"), F.first("n").alias("n"))
        most = (F.col("n") + 1 + F.floor(-F.lit(self.percent) * F.col("n") / 100)).cast("int")
        rare = F.size(F.filter("p", lambda p: p["c"] <= self.direct))
        first = ordered.select("node", rare.alias("rare"), F.explode(F.slice("p", F.lit(1), most)).alias("p"))
        return self.passing.put(first.filter("p.c > 1").select("p.sig", "node", "rare"), "rarest")

    # -- large groups ------------------------------------------------------------------

    def stars(self, large: DataFrame, held: DataFrame) -> DataFrame:
        """(hub, node, n, dist, linked, delta) of every member of every hub, the hub itself included."""
        percent = self.percent
        members = large.filter("node <> hub").join(held, "node")
        chunks = self.passing.put(members.groupBy("hub").agg(F.ceil(F.sum(F.col("n") * 8) / self.chunk_bytes).cast("int").alias("chunks")), "star-chunks")
        small_chunks = small(chunks, chunks.count())
        dealt = members.join(small_chunks, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("salt"), "node", "hashes")
        hubs = chunks.join(held.select(F.col("node").alias("hub"), "hashes"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.col("hub").alias("node"), "hashes")

        def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return star_rows(int(key[0]), group, percent, key[1] == 0)

        found = dealt.unionByName(hubs).groupBy("hub", "salt").applyInPandas(compare, "hub long, node long, n long, dist double, linked boolean, delta binary")
        return self.passing.put(found, "stars")

    def blocks(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) between roots around the hubs: in one block where a hub's members are few, else by elements they share."""
        known = stars.join(labels, "node", "left").select("hub", "n", "dist", "delta", "node", F.coalesce("root", "node").alias("root"))
        known = self.passing.put(known, "around")
        roots = known.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("delta") + 64).alias("w"))
        open_hubs = roots.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), F.max(F.struct("c", "root"))["root"].alias("top")).filter("k > 1").select("hub", "w", "top")
        open_hubs = self.passing.put(open_hubs, "open")
        placed = known.join(small(open_hubs, open_hubs.count()), "hub").withColumn("main", F.col("root") == F.col("top"))
        found = self.block_links(placed.filter(F.col("w") <= self.chunk_bytes), ["hub"])
        if open_hubs.filter(F.col("w") > self.chunk_bytes).isEmpty():
            return found.distinct()

        @F.pandas_udf("array<long>")
        def elements(x: pd.Series) -> pd.Series:
            return x.map(lambda d: np.frombuffer(d, np.int64))

        wide = placed.filter(F.col("w") > self.chunk_bytes).select(F.col("hub").alias("fam"), "node", "n", "dist", "root", (~F.col("main")).alias("loose"), elements("delta").alias("delta"))
        rows: DataFrame | None = self.passing.put(wide, "wide")
        for level in range(LEVELS):
            links, rows = self.narrowed(rows, level)
            found = found.unionByName(links)
            if rows is None:
                return found.distinct()
        return found.unionByName(self.ringed(rows)).distinct()

    def block_links(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Links (a, b) between roots of the rows (root, n, main, delta) of each block."""
        percent = self.percent

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(forest(group, percent), columns=["a", "b"], dtype="int64")

        side = [] if "side" in rows.columns else [F.lit(2).alias("side")]
        return rows.select(*rows.columns, *side).groupBy(*by).applyInPandas(meet, "a long, b long")

    def narrowed(self, rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None]:
        """Links between roots of (fam, node, n, dist, root, loose, delta), and the families that are left to be taken apart; None if none are.

        Members that are not loose are known to be connected.  A member's slack x is (100 + percent) * size of its
        difference - (100 - percent) * n: two members whose slacks add up to 0 at most surely link, and others link only if
        they share at least half that sum / (100 + percent) elements.
        """
        up, down = 100 + self.percent, 100 - self.percent
        name = f"narrow-{level}"
        counts = rows.select("fam", F.explode("delta").alias("e")).groupBy("fam", "e").agg(F.count(F.lit(1)).alias("c"))
        sizes = self.passing.put(rows.groupBy("fam").agg(F.count(F.lit(1)).alias("g")), f"{name}-sizes")
        families = sizes.count()
        flips = counts.join(small(sizes, families), "fam").filter(2 * F.col("c") > F.col("g")).groupBy("fam").agg(F.collect_list("e").alias("flip"))
        flips = self.passing.put(flips, f"{name}-flips")
        flip = F.coalesce("flip", F.array().cast("array<long>"))
        apart = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
        centred = rows.join(small(flips, flips.count(), 1000), "fam", "left").withColumn("delta", apart(F.col("delta"), flip)).drop("flip")
        centred = self.passing.put(centred.withColumn("x", (up * F.size("delta") - down * F.col("n")).cast("long")), f"{name}-centred")
        least = centred.groupBy("fam").agg(F.min(F.struct("x", "node", "root", "loose")).alias("m"), F.bool_and("loose").alias("alone"), F.min(F.when(~F.col("loose"), F.col("x"))).alias("tied"))
        least = self.passing.put(least, f"{name}-least")
        held = centred.join(small(least, families), "fam")
        sure = F.col("x") + F.col("m.x") <= 0
        links = held.filter(sure & (F.col("root") != F.col("m.root"))).select(F.col("root").alias("a"), F.col("m.root").alias("b"))
        joined = ~F.col("m.loose") | F.col("alone") | F.coalesce(F.col("tied") + F.col("m.x") <= 0, F.lit(False))
        held = self.passing.put(held.withColumn("loose", F.col("loose") & ~(joined & (sure | (F.col("node") == F.col("m.node"))))), f"{name}-held")
        first = self.passing.put(held.filter("loose").groupBy("fam").agg(F.min("x").alias("xo")), f"{name}-loose")
        open_ = held.join(small(first, first.count()), "fam")
        shared = F.greatest(F.lit(1), F.ceil((F.col("x") + F.when(F.col("loose"), F.col("m.x")).otherwise(F.col("xo"))) / (2 * up))).cast("int")
        own = open_.select("fam", "node", "loose", (F.size("delta") - shared + 1).alias("most"), F.explode("delta").alias("e"))
        rare = own.groupBy("fam", "e").agg(F.count(F.lit(1)).alias("c"))
        ordered = own.join(rare, ["fam", "e"]).groupBy("fam", "node", "loose", "most").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("p"))
        forward = ordered.filter("most > 0").select("fam", "node", "loose", F.explode(F.slice("p", F.lit(1), F.col("most"))).alias("p")).filter("p.c > 1").select("fam", "node", "loose", "p.e")
        members = self.passing.put(forward, f"{name}-members")
        size = open_.select("fam", "node", (8 * F.size("delta") + 64).alias("w"))
        facts = members.join(size, ["fam", "node"]).groupBy("fam", "e").agg(F.count(F.lit(1)).alias("g"), F.max("loose").alias("any"), F.bit_xor(F.xxhash64("node")).alias("digest"), F.sum("w").alias("w")).filter("g > 1 and any")
        groups = facts.groupBy("fam", "g", "digest", "w").agg(F.min("e").alias("e"))  # groups of the same members meet once
        groups = self.passing.put(groups, f"{name}-groups")
        met = members.join(groups, ["fam", "e"])
        few = self.passing.put(met.filter(F.col("g") <= self.direct).select("fam", "e", "node", "loose"), f"{name}-few")
        one, other = (few.select("fam", "e", F.col("node").alias(c), F.col("loose").alias(f"loose_{c}")) for c in "ab")
        pairs = one.join(other, ["fam", "e"]).filter("a < b and (loose_a or loose_b)").select("fam", "a", "b").distinct()
        side = lambda c: open_.select("fam", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}"), F.col("delta").alias(f"delta_{c}"))
        both = pairs.join(side("a"), ["fam", "a"]).join(side("b"), ["fam", "b"]).filter("root_a <> root_b")
        linked = both.filter(up * F.size(apart(F.col("delta_a"), F.col("delta_b"))) <= down * (F.col("n_a") + F.col("n_b")))
        links = links.unionByName(linked.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        fam = F.xxhash64("fam", "e", F.lit(level)).alias("fam")
        many = met.filter(F.col("g") > self.direct).select("fam", "e", "node", "w").join(open_.select("fam", "node", "n", "dist", "root", "loose", "delta"), ["fam", "node"])
        many = self.passing.put(many.select(fam, "node", "n", "dist", "root", "loose", "delta", "w"), f"{name}-many")
        blocks = many.filter(F.col("w") <= self.chunk_bytes).select("fam", "root", "n", (~F.col("loose")).alias("main"), "delta")
        links = self.passing.put(links.unionByName(self.block_links(blocks, ["fam"])).distinct(), f"{name}-links")
        rest = many.filter(F.col("w") > self.chunk_bytes).drop("w")
        return links, None if rest.isEmpty() else rest

    def ringed(self, rows: DataFrame) -> DataFrame:
        """Links (a, b) between roots within families that are still large: members meet in blocks of about chunk_bytes.

        Jaccard distance is a metric, so members whose distances to their hub differ by more than links allow need not meet:
        they are dealt by ring of distance, and by whether they are loose, for the others do not meet each other.
        """
        percent, limit = self.percent, self.chunk_bytes
        placed = rows.select(F.col("fam").alias("hub"), "node", "n", "dist", "root", (~F.col("loose")).alias("main"), "delta")
        weight = 8 * F.size("delta") + 64
        ring = F.least(F.floor(F.col("dist") * RINGS), F.lit(RINGS - 1)).cast("int")
        placed = placed.withColumn("cell", 2 * ring + F.col("main").cast("int"))
        cells = placed.groupBy("hub", "cell").agg(F.ceil(F.sum(weight) / limit).cast("int").alias("chunks"), F.min("main").alias("main"))
        cells = self.passing.put(cells, "cells")
        reach = (100 - percent) * RINGS // 100 + 1
        a = cells.select("hub", F.col("cell").alias("x"), F.col("chunks").alias("xn"), F.col("main").alias("xm"))
        b = cells.select("hub", F.col("cell").alias("y"), F.col("chunks").alias("yn"), F.col("main").alias("ym"))
        meets = (F.col("x") <= F.col("y")) & ~(F.col("xm") & F.col("ym")) & (F.abs(F.shiftright("x", 1) - F.shiftright("y", 1)) <= reach)
        pairs = self.passing.put(a.join(b, "hub").filter(meets).select("hub", "x", "y", "xn", "yn"), "cell-pairs")
        own = placed.join(cells.select("hub", "cell", "chunks"), ["hub", "cell"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        own = own.select("hub", "cell", "k", "root", "n", "main", "delta")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        one, two = (own.join(pairs, (own["hub"] == pairs["hub"]) & (own["cell"] == pairs[c])).drop(pairs["hub"]) for c in ("x", "y"))
        rest = ["root", "n", "main", "delta"]
        within = one.filter("x = y").withColumn("j", upto("yn")).select("hub", "x", "y", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), F.when(F.col("k") == F.col("j"), 2).otherwise((F.col("k") > F.col("j")).cast("int")).alias("side"), *rest)
        left = one.filter("x <> y").withColumn("j", upto("yn")).select("hub", "x", "y", F.col("k").alias("i"), "j", F.lit(0).alias("side"), *rest)
        right = two.filter("x <> y").withColumn("i", upto("xn")).select("hub", "x", "y", "i", F.col("k").alias("j"), F.lit(1).alias("side"), *rest)

        return self.block_links(within.unionByName(left).unionByName(right), ["hub", "x", "y", "i", "j"])

    # -- the whole -------------------------------------------------------------------

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The sketched rows and (node, root) of the nodes that link with another."""
        rows = self.kept.put(sketch_texts(self.df, self.text, self.key, self.words, self.bands), "rows")
        rows = rows.withColumn("digest", F.col("node"))
        if (apart := rekeyed(rows)) is not None:
            rows = self.kept.put(apart, "rows-apart")
        first = rows.filter("own is not null").groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", "digest", "check", "own", "upper")])
        least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        self.contents = self.passing.put(first.join(least, "node"), "contents")
        each = rows.select("node", F.explode("signatures").alias("sig"))
        shared = self.passing.put(each.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b"), "shared")
        several = shared.filter("c > 2").select("sig")
        members = self.passing.put(each.join(small(several, shared.filter("c > 2").count(), PICK_ROWS), "sig").select("sig", "node", F.lit(0).alias("rare")).distinct(), "members")
        pairs, large = self.grouped(members, "one")
        candidates, around = shared.filter("c = 2").select("a", "b").union(pairs), None
        if not large.isEmpty():
            held = self.sets(large.select("node").distinct(), "large")
            pairs, hubs = self.grouped(self.rarest(held), "two")
            candidates = candidates.union(pairs)
            if not hubs.isEmpty():
                around = self.stars(hubs, held)
        near = self.passing.put(self.near(candidates.distinct()), "near")
        links = self.verified(near)
        if around is not None:
            links = links.union(around.filter("linked and hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        labels = self.kept.put(connected_components(self.passing.put(links, "links")), "labels")
        if around is not None:
            more = self.passing.put(self.blocks(around, labels), "forest")
            if not more.isEmpty():
                tops = connected_components(more)
                loose = tops.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
                joined = labels.unionByName(loose).join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
                labels = self.kept.put(joined.select("node", F.coalesce("top", "root").alias("root")), "labels")
        self.passing.drop()
        return rows, labels


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, direct: int = 16, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id): the set's size and the smallest doc_id that links reach, itself included.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the text's distinct `words`-word shingles, the whole
    sequence when it is shorter.  Two documents link when 100 * intersection >= percent * union.  Null, empty and blank
    texts have an empty set and link with nothing; a row without doc_id links with nothing and has a null component.
    Rows that repeat a doc_id are one document while their texts' sets are equal; otherwise each text links on its own.
    An empty table gives no rows; other columns are ignored.  Sets are held as 64-bit hashes, and equal sets are known by
    two 64-bit digests.
    """
    join = ParityJoin(df, text, key, words, percent, direct, chunk_bytes)
    rows, labels = join.run()
    rooted = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    rooted = join.kept.put(rooted.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(ids, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
