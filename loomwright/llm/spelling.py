"""Spelling variants: words one edit apart, found by intersecting Levenshtein automata with tries of the vocabulary.

The vocabulary is cut into ranges of sorted words, and each is a compact trie: nodes in breadth-first order, so a node's
children lie side by side and an edge's number gives its child.  The tries are broadcast in rounds of bounded size.  Each
word walks every trie of a round depth-first beside its own automaton of distance one; accepting nodes are its
neighbours.  Spark adds up their numbers and picks the most frequent one.

Every trie is there twice, of the words and of the words turned round, so that the walk is narrow: the first half of a word is
followed without an edit in the one, the second half in the other, and edits begin where few nodes are left.  A neighbour
that shares the first half is found in the first kind of tries and any other in the second, so none is found twice.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Stashes, small, stash, text_batches

#: A run of ASCII and Latin-1 letters.
RUN_REGEX = "[A-Za-zÀ-ÿ]+"
#: Words of a trie at most, bytes of tries that are broadcast in a round, and words that a task looks up.
TRIE_WORDS, ROUND_BYTES, TASK_WORDS = 40_000, 24 << 20, 10_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 300_000


class Trie:
    """Sorted distinct words with their counts.  Node 0 is the root; edge e leads to node e + 1."""

    def __init__(self, first: array, labels: array, counts: array):
        self.first, self.labels, self.counts = first, labels, counts
        self.least, self.greatest = (self._edge(side) for side in (0, -1))

    def _edge(self, side: int) -> str:
        """The least or the greatest word."""
        node, said = 0, ""
        while self.first[node] < self.first[node + 1] and (side or not self.counts[node]):
            e = self.first[node + 1] - 1 if side else self.first[node]
            node, said = e + 1, said + chr(self.labels[e])
        return said

    def may_hold(self, head: str) -> bool:
        """Whether words that begin so lie between the least and the greatest one."""
        return self.least[: len(head)] <= head <= self.greatest[: len(head)]

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        first, labels, held = array("I", [0]), array("I"), array("q")
        todo = deque([(0, len(words), 0)])
        while todo:
            low, high, depth = todo.popleft()
            ends = low < high and len(words[low]) == depth
            held.append(counts[low] if ends else 0)
            low += ends
            while low < high:
                letter, end = words[low][depth], low + 1
                while end < high and words[end][depth] == letter:
                    end += 1
                labels.append(ord(letter))
                todo.append((low, end, depth + 1))
                low = end
            first.append(len(labels))
        return cls(first, labels, held)

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.counts)], "<u8").tobytes(), *(np.asarray(x).astype(kind).tobytes() for x, kind in ((self.first, "<u4"), (self.labels, "<u4"), (self.counts, "<i8")))])

    @classmethod
    def load(cls, data: bytes) -> Trie:
        nodes = int(np.frombuffer(data, "<u8", 1)[0])
        at, parts = 8, []
        for kind, size, number in (("I", 4, nodes + 1), ("I", 4, nodes - 1), ("q", 8, nodes)):
            parts.append(array(kind, data[at : at + size * number]))
            at += size * number
        return cls(*parts)

    def near(self, word: str, plain: int = 0) -> list[tuple[str, int]]:
        """(neighbour, count) of the words that one inserted, deleted or replaced code point, after the first `plain` ones, makes of `word`.

        The automaton's states are two sets of positions as bits: those reached without an edit and those reached with
        one.  Beyond the last node that needs no edit only the letters that the word goes on with can follow.
        """
        first, labels, counts = self.first, self.labels, self.counts
        letters = list(map(ord, word))
        node = 0
        for c in letters[:plain]:
            low, high = first[node], first[node + 1]
            e = bisect_left(labels, c, low, high)
            if e == high or labels[e] != c:
                return []
            node = e + 1
        masks: dict[int, int] = {}
        for i, c in enumerate(letters):
            masks[c] = masks.get(c, 0) | 2 << i
        end = 1 << len(letters)
        found, todo = [], [(node, 1 << plain, 2 << plain, word[:plain])]
        while todo:
            node, exact, edited, said = todo.pop()
            if edited & end and counts[node] and not exact & end:
                found.append((said, counts[node]))
            low, high = first[node], first[node + 1]
            if exact:
                for e in range(low, high):
                    c = labels[e]
                    mask = masks.get(c, 0)
                    on = exact << 1 & mask
                    todo.append((e + 1, on, edited << 1 & mask | exact | exact << 1 | on << 1, said + chr(c)))
                continue
            rest = edited & (end - 1)
            while rest and low < high:
                bit = rest & -rest
                c = letters[bit.bit_length() - 1]
                mask = masks[c]
                e = bisect_left(labels, c, low, high)
                if e < high and labels[e] == c:
                    todo.append((e + 1, 0, edited << 1 & mask, said + chr(c)))
                rest &= ~(mask >> 1)
        return found


def neighbours(word: str, onward: list[Trie], back: list[Trie]) -> list[tuple[str, int]]:
    """(neighbour, count) in tries of words and in tries of words turned round."""
    half = len(word) // 2
    head, turned = word[:half], word[::-1]
    tail = turned[: len(word) - half]
    found = [x for t in onward if t.may_hold(head) for x in t.near(word, half)]
    for t in back:
        if not t.may_hold(tail):
            continue
        found += [(v[::-1], n) for v, n in t.near(turned, len(tail)) if v[::-1][:half] != head]
    return found


def variant_counts(df: DataFrame, text: str, key: str, slip_every: int) -> DataFrame:
    """(word, n): how often each run of letters occurs, A-Z lower-cased.

    With `slip_every`, a run loses one letter wherever the crc32 of `<key>:<run>` is a multiple of it: the letter at that
    number modulo its length.  Null texts have no runs, a null key is an empty one.  A run that loses its only letter is none.
    """
    text_batches(df.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(RUN_REGEX).findall, Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not body:
                    continue
                begun = zlib.crc32(b"%s:" % (name or "").encode("utf-8"))
                for run, n in Counter(runs(body.lower().decode("utf-8", "replace"))).items():
                    hashed = zlib.crc32(run.encode("utf-8"), begun) if slip_every else 1
                    if slip_every and hashed % slip_every == 0:
                        at = hashed % len(run)
                        run = run[:at] + run[at + 1 :]
                    if run:
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield table()
                    held.clear()
        if held:
            yield table()

    found = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_tries(words: DataFrame, total: int) -> DataFrame:
    """(trie, back, size, data): tries of at most TRIE_WORDS words each, over ranges of the sorted words and of the words turned round."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[str] = []
        counts: list[int] = []

        def done(n: int) -> pd.DataFrame:
            data = Trie.build(names[:n], counts[:n]).dump()
            del names[:n], counts[:n]
            return pd.DataFrame({"size": [len(data)], "data": [data]})

        for batch in batches:
            names.extend(batch["word"])
            counts.extend(batch["n"].tolist())
            while len(names) >= TRIE_WORDS:
                yield done(TRIE_WORDS)
        if names:
            yield done(len(names))

    def tries(df: DataFrame, back: bool) -> DataFrame:
        ranges = df.repartitionByRange(-(-total // TRIE_WORDS), "word").sortWithinPartitions("word")
        return ranges.mapInPandas(build, "size long, data binary").withColumn("back", F.lit(back))

    both = tries(words.select("word", "n"), False).unionByName(tries(words.select(F.reverse("word").alias("word"), "n"), True))
    return both.withColumn("trie", F.monotonically_increasing_id())


def neighbour_facts(words: DataFrame, held: Stashes) -> DataFrame:
    """(word, n_near, best): each word's number of neighbours and the most frequent one, ties by code point; words without any are absent."""
    spark, total = words.sparkSession, words.count()
    if not total:
        return spark.createDataFrame([], "word string, n_near long, best struct<n: long, form: string>")
    tries = held.put(build_tries(words, total), "tries")
    rounds: list[list[int]] = []
    filled = 0
    for r in tries.select("trie", "size").orderBy("trie").collect():  # one row for TRIE_WORDS words or so
        if not rounds or filled + r["size"] > ROUND_BYTES:
            rounds.append([])
            filled = 0
        rounds[-1].append(r["trie"])
        filled += r["size"]
    asked = held.put(words.select("word").repartition(-(-total // TASK_WORDS), "word"), "asked")
    found: DataFrame | None = None
    for number, chosen in enumerate(rounds):
        sent = spark.sparkContext.broadcast([(r["back"], bytes(r["data"])) for r in tries.filter(F.col("trie").isin(chosen)).select("back", "data").collect()])

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            onward, back = ([Trie.load(data) for turned, data in sent.value if turned == kind] for kind in (False, True))
            for batch in batches:
                rows = []
                for word in batch["word"]:
                    met = neighbours(word, onward, back)
                    if met:
                        form, n = min(met, key=lambda x: (-x[1], x[0]))
                        rows.append((word, len(met), n, form))
                yield pd.DataFrame(rows, columns=["word", "n_near", "n", "form"])

        each = held.put(asked.repartition(-(-total // TASK_WORDS), "word").mapInPandas(search, "word string, n_near long, n long, form string"), f"near-{number}")
        sent.destroy()
        found = each if found is None else found.unionByName(each)
    best = F.min(F.struct((-F.col("n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.form").alias("form")).alias("best"))


def roots(links: DataFrame, held: Stashes) -> DataFrame:
    """(word, root) of (word, form) rows: the last of a word's chain of forms.  A round doubles the steps; chains have no circle."""
    now, number = held.put(links.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        ahead = held.put(now.join(further, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), f"roots-{number + 1}")
        now, number = ahead.select("word", "root"), number + 1
        if ahead.filter("moved").isEmpty():
            return now


def spelling_variants(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 5, min_count: int = 3, slip_every: int = 97, form_factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least min_chars code points and min_count occurrences.

    n_near counts the words of the result that one inserted, deleted or replaced code point makes of it.  Its form is the most
    frequent of them (ties: the smallest), if that one is at least form_factor times as frequent; its root is what the forms lead to.
    Words without a form are their own root.  `slip_every` plants slips (see variant_counts); 0 takes the runs as they are.
    Rows that repeat count again; an empty table, and texts without words, give no rows.  Only the named columns are read.
    """
    if form_factor < 2:
        raise ValueError("a form has to be more frequent than its word, else chains may run in a circle")
    held = Stashes(df.sparkSession, "spelling")
    counted = variant_counts(df.filter(F.col(text).isNotNull()), text, key, slip_every).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_chars))
    words = held.put(counted, "words")
    met = words.join(neighbour_facts(words, held), "word", "left")
    form = F.col("best.n") >= form_factor * F.col("n")
    facts = held.put(met.select("word", F.when(form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.n")).alias("form_n")), "facts")
    led = roots(facts.filter("form is not null"), held)
    out = stash(facts.join(small(led, led.count()), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling-variants")
    held.drop()
    return out
