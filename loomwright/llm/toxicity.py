"""Toxicity of texts whose words may be disguised: a noisy channel is undone first, then the restored text is scored.

Disguises are digits and signs for letters, letters set apart, and letters drawn out.  A disguised stretch becomes a
lattice of what its author may have meant, with the cost of each disguise, and Viterbi's algorithm finds the likeliest reading
under a character model of the whole corpus.  Plain words have one reading and stay as they are.

The score is a logistic regression over the shares of words and word beginnings in the restored text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import Stashes, hash52, key_string, small, text_batches

#: Symbols of the character model: 0 is no letter, 1 to 26 are a to z, then ß to ÿ, then any other letter.
SYMBOLS = 60
#: The letters that a digit or sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
#: Signs that are letters only between others, for at a word's end they are punctuation.
INSIDE = set("!|+(")
#: Costs, in nats: a sign for a letter; a digit in a word that is no letter; a sign that is none, at a word's end, and elsewhere;
#: a blot for any letter; a sign between single letters that is none, and one between longer parts; a blank between single
#: letters that is none, and one that is kept; a letter drawn out.
FOR_LETTER, STILL_DIGIT, STILL_SIGN, SIGN_INSIDE, BLOT, ACROSS_SIGN, PARTS, ACROSS_BLANK, APART, DRAWN = 1.0, 8.0, 0.5, 8.0, 3.5, 2.0, 12.0, 0.5, 3.0, 0.5
#: Weight of the shorter context in the character model.
BACKING = 20.0

#: Labelled documents that the regression is fitted on, features that it has, and rounds of fitting.
TRAIN_DOCS, FEATURES, ROUNDS = 20_000, 2048, 400
#: Word beginnings of these lengths are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Characters that are counted at once.
PIECE = 1 << 20
#: Distinct tokens whose readings a worker remembers, and features that a counting task holds before it hands them on.
HELD = 200_000

_WORD = re.compile(r"[^\W\d_]+").findall
_SIGNS = "".join(re.escape(c) for c in LOOKALIKES)
#: Tokens that may be disguised: a sign or digit beside a letter, a letter drawn out, or a letter on both sides of a sign.
_ODD = re.compile(rf"[{_SIGNS}][^\W\d_]|[^\W\d_][{_SIGNS}]|([^\W\d_])\1\1|[^\W\d_][^\w\s]+[^\W\d_]").search
#: Three single characters or more, each apart from the next.
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t][^\W_])+(?:[ \t][^\W_])(?!\S)")


def symbol(letter: str) -> int:
    """The model's symbol of a lower-case character."""
    code = ord(letter)
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFF and code != 0xF7:
        return 27 + code - 0xDF
    return SYMBOLS - 1 if letter.isalpha() else 0


def _symbol_table() -> np.ndarray:
    return np.array([symbol(chr(c)) for c in range(0x250)], np.uint8)


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """The symbols of a lower-case text; beyond the table every character counts as a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return table[codes] if not len(codes) or codes.max() < len(table) else np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], SYMBOLS - 1)


def trigram_counts(df: DataFrame, text: str) -> DataFrame:
    """(gram, n): trigrams of symbols over all texts, in lower case; words begin and end with no letter.  At most SYMBOLS ** 3 rows."""
    text_batches(df.sparkSession)
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)

        def add(text: str) -> None:
            for low in range(0, len(text), PIECE):
                s = symbols_of(text[max(0, low - 2) : low + PIECE], table).astype(np.int32)
                inside = (s[1:-1] != 0) | ((s[:-2] == 0) != (s[2:] == 0))
                total[:] += np.bincount(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[inside], minlength=SYMBOLS**3)

        for batch in batches:
            held, size = [], 0
            for body in batch.column(0).to_pylist():
                if body:
                    held.append(body.lower())
                    size += len(body)
                if size > PIECE:
                    add(f"  {'  '.join(held)}  ")
                    held, size = [], 0
            add(f"  {'  '.join(held)}  ")
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(total[grams], pa.int64())], schema=schema)

    return df.select(F.col(text).alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after two others, as [a, b, c], backing off to shorter contexts."""
    n = np.zeros(SYMBOLS**3)
    n[grams] = counts
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    pairs = n.sum(0)
    two = (pairs + BACKING * one) / (pairs.sum(1, keepdims=True) + BACKING)
    return -np.log((n + BACKING * two) / (n.sum(2, keepdims=True) + BACKING)).astype(np.float64)


Reading = tuple[str, float]


def lattice(stretch: str, spaced: bool = False) -> list[list[Reading]]:
    """What each part of a lower-case stretch may stand for: (text, cost) readings; a blank in a reading ends a word.

    Signs that are read as themselves are kept, and end a word as well.  `spaced` stretches are single letters with blanks between.
    """
    out: list[list[Reading]] = []
    at, size = 0, len(stretch)
    while at < size:
        c, end = stretch[at], at + 1
        while end < size and stretch[end] == c:
            end += 1
        run, before, after = stretch[at:end], stretch[at - 1 : at], stretch[end : end + 1]
        between = (before.isalnum() and after.isalnum()) or spaced
        if c.isalpha():
            out.append([(run, 0.0)] if len(run) < 3 else [(c, DRAWN), (c * 2, DRAWN)])
        elif c in LOOKALIKES and (c not in INSIDE or between):
            still = STILL_DIGIT if c.isdigit() else SIGN_INSIDE if after.isalpha() else STILL_SIGN
            meant = [(x * k, FOR_LETTER) for x in LOOKALIKES[c] for k in range(1, min(len(run), 2) + 1)]
            out.append([(run, still), *meant])
        elif c == "*" and between and len(run) <= 2:
            for _ in run:
                out.append([(c, STILL_SIGN), *((chr(x), BLOT) for x in range(97, 123))])
        elif c in " \t":
            out.append([(run, APART), ("", ACROSS_BLANK)])
        elif between and before.isalpha() and after.isalpha():
            alone = not stretch[max(0, at - 2) : at - 1].isalnum() and not stretch[end + 1 : end + 2].isalnum()
            out.append([(run, 0.0), ("", ACROSS_SIGN if alone else PARTS)])
        else:
            out.append([(run, 0.0)])
        at = end
    return out


def likeliest(parts: Sequence[Sequence[Reading]], model: Sequence[float]) -> tuple[str, float]:
    """The cheapest path through a lattice: its text, and the cost of its readings and of its symbols.  Ties: the first reading.

    `model` holds the costs [a, b, c] in a row.  A state is the last two symbols; runs of no letters are one.
    """
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for readings in [*parts, [("\0", 0.0)]]:
        after: dict[int, tuple[float, tuple | None]] = {}
        spelt = [(said, extra, [symbol(x) for x in said]) for said, extra in readings]
        for context, (cost, back) in states.items():
            for said, extra, symbols in spelt:
                now, total = context, cost + extra
                for s in symbols:
                    if s or now % SYMBOLS:
                        total += model[now * SYMBOLS + s]
                        now = now % SYMBOLS * SYMBOLS + s
                if now not in after or total < after[now][0]:
                    after[now] = total, (back, said)
        states = after
    cost, back = min(states.values(), key=lambda x: x[0])
    out = []
    while back is not None:
        back, said = back
        out.append(said)
    return "".join(reversed(out)).replace("\0", ""), cost


@dataclass(frozen=True)
class Toxicity:
    """What scoring needs: the character model, the weight of each feature (0 of a word's beginning `word~`), and the bias."""

    characters: bytes
    weights: Mapping[str, float]
    bias: float
    name: str = ""


class Reader:
    """Restores and reads texts, and remembers tokens in two generations of at most `held`."""

    def __init__(self, characters: bytes, features: Mapping[str, int], held: int = HELD):
        self.model = np.frombuffer(characters, "<f8").tolist()
        self.features, self.held = features, held
        self.known: dict[str, tuple[str | None, int, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str | None, int, tuple[int, ...]]] = {}

    def _token(self, token: str) -> tuple[str | None, int, tuple[int, ...]]:
        """The token restored (None if it stays), the number of its words, and its features, repeated as they occur."""
        found = self.older.get(token)
        if found is None:
            said = likeliest(lattice(token), self.model)[0] if _ODD(token) else token
            words = _WORD(said)
            found = None if said == token else said, len(words), tuple(k for w in words for f in word_features(w) if (k := self.features.get(f)) is not None)
        self.known[token] = found
        return found

    def read(self, text: str) -> tuple[str, int, Counter]:
        """The text restored in lower case, the number of its words, and the counts of its features."""
        text = text.lower()
        tokens = Counter(text.split())
        if sum(n for t, n in tokens.items() if len(t) == 1) > 2:
            joined = _SPACED.sub(lambda m: likeliest(lattice(m[0], True), self.model)[0], text)
            if joined != text:
                text, tokens = joined, Counter(joined.split())
        if len(self.known) > self.held:
            self.older, self.known = self.known, {}
        known, words, counts, changed = self.known, 0, Counter(), {}
        for token, n in tokens.items():
            said, size, features = known.get(token) or self._token(token)
            words += n * size
            for k in features:
                counts[k] += n
            if said is not None:
                changed[token] = said
        return re.sub(r"\S+", lambda m: changed.get(m[0], m[0]), text) if changed else text, words, counts


#: A worker's last readers by the model's name, kept from task to task.
_READERS: dict[str, Reader] = {}


def _reader(name: str, sent: Broadcast) -> Reader:
    if name not in _READERS:
        while len(_READERS) > 1:
            del _READERS[next(iter(_READERS))]
        _READERS[name] = Reader(*sent.value)
    return _READERS[name]


def word_features(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) >= n)]


def share(n: float, words: int) -> float:
    """A feature's value: its share in a text's words, damped for short texts and for large shares."""
    return math.log1p(1000 * n / (words + 50))


def feature_counts(df: DataFrame, reader_of: tuple, name: str) -> DataFrame:
    """(feature, toxic, clean): in how many of the training texts with either label each feature occurs."""
    sent = df.sparkSession.sparkContext.broadcast(reader_of)
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = _reader(name, sent), (Counter(), Counter())

        def table() -> pa.RecordBatch:
            names = list(held[0] | held[1])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h[f] for f in names], pa.int64()) for h in held[::-1])], schema=schema)

        for batch in batches:
            for body, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[toxic].update({f for w in _WORD(reader.read(body or "")[0]) for f in word_features(w)})
                if len(held[0]) + len(held[1]) > HELD:
                    yield table()
                    held[0].clear()
                    held[1].clear()
        yield table()

    return df.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training_rows(df: DataFrame, reader_of: tuple, name: str) -> DataFrame:
    """(key, toxic, ids, values) of the training texts, ids by feature's position."""
    sent = df.sparkSession.sparkContext.broadcast(reader_of)
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("ids", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(name, sent)
        for batch in batches:
            met = [reader.read(body or "")[1:] for body in batch.column(1).to_pylist()]
            ids = [sorted(c) for _, c in met]
            values = [[share(c[k], words) for k in order] for order, (words, c) in zip(ids, met, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, schema[2].type), pa.array(values, schema[3].type)], schema=schema)

    return df.mapInArrow(read, "key long, toxic int, ids array<int>, values array<double>")


def fit_weights(rows: pa.Table, size: int, rounds: int = ROUNDS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of `toxic` on the rows' features by gradient steps of own width (Adam); the same for the same rows."""
    y = rows["toxic"].to_numpy().astype(float)
    ids, values = rows["ids"].combine_chunks(), rows["values"].combine_chunks().flatten().to_numpy()
    starts = np.repeat(np.arange(len(rows)), ids.value_lengths().to_numpy())
    columns = ids.flatten().to_numpy().astype(np.int64)
    weights, first, second = (np.zeros(size + 1) for _ in range(3))
    for step in range(1, rounds + 1):
        score = np.bincount(starts, values * weights[columns], len(rows)) + weights[-1]
        wrong = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(rows)
        slope = np.append(np.bincount(columns, values * wrong[starts], size) + decay * weights[:-1], wrong.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def held_out(key: Column) -> Column:
    """Whether a row takes no part in learning labels: the crc32 of its key as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_docs: int = TRAIN_DOCS, features: int = FEATURES) -> Toxicity:
    """Count the character model over all texts, and fit the weights on about `train_docs` labelled ones, those of least key hash.

    Held-out rows give no labels, nor do null labels and null keys; a key with several labels has the largest.  Features are those
    that tell most: the ones with the largest log-likelihood ratio of occurring in a toxic text.  Without a labelled row of both
    kinds the bias alone says how frequent toxic labels are.
    """
    spark: SparkSession = docs.sparkSession
    held = Stashes(spark, "toxicity")
    grams = held.put(trigram_counts(docs, text), "characters").toArrow()
    characters = character_model(grams["gram"].to_numpy(), grams["n"].to_numpy()).astype("<f8").tobytes()
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).filter("key is not null and toxic in (0, 1)").filter(~held_out(F.col("key")))
    total = marks.count()
    chosen = marks.filter(hash52(key_string(F.col("key"))) < int((1 << 52) * min(1.0, train_docs / max(1, total))))
    chosen = held.put(chosen.groupBy("key").agg(F.max("toxic").alias("toxic")), "labels")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(small(chosen, chosen.count()), F.col("__key") == F.col("key"))
    train = held.put(rows.select(F.col("key").cast("long").alias("key"), "text", "toxic"), "train")
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    ones, zeros = facts["toxic"], facts["n"] - facts["toxic"]
    if not ones or not zeros:
        held.drop()
        return Toxicity(characters, {}, math.log((ones + 0.5) / (zeros + 0.5)), uuid.uuid4().hex)
    told = feature_counts(train, (characters, {}), uuid.uuid4().hex)
    ratio = F.log((F.col("toxic") + 0.5) / (ones + 1)) - F.log((F.col("clean") + 0.5) / (zeros + 1))
    chosen_features = told.withColumn("told", F.col("toxic") * ratio).filter("told > 0 and toxic > 1").orderBy(F.col("told").desc(), "feature").limit(features)
    names = sorted(r["feature"] for r in chosen_features.collect())
    places = {f: i for i, f in enumerate(names)}
    read = training_rows(train, (characters, places), uuid.uuid4().hex).orderBy("key", "toxic", "ids", "values").toArrow()
    weights, bias = fit_weights(read, len(names))
    held.drop()
    return Toxicity(characters, {f: float(w) for f, w in zip(names, weights, strict=True)}, bias, uuid.uuid4().hex)


def score_toxicity(df: DataFrame, model: Toxicity, text: str = "text", restored: bool = False) -> DataFrame:
    """Add score (double, 0 to 1), and with `restored` the restored text in lower case.

    Whole texts are read; null and empty ones have no words and score by the bias.  Each row is scored by its text alone.
    Columns named like the outputs are replaced; an empty table gives an empty one.
    """
    spark = df.sparkSession
    text_batches(spark)
    names = sorted(model.weights)
    sent = spark.sparkContext.broadcast((model.characters, {f: i for i, f in enumerate(names)}))
    weights, bias, name = [model.weights[f] for f in names], model.bias, model.name
    added = ["score", *(["restored"] if restored else [])]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added or c == text])
    place, out = kept.columns.index(text), [c for c in kept.columns if c not in added]
    places = [kept.columns.index(c) for c in out]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(name, sent)
        for batch in batches:
            scores, texts = [], []
            for body in batch.column(place).to_pylist():
                said, words, counts = reader.read(body or "")
                total = bias + sum(weights[k] * share(counts[k], words) for k in sorted(counts))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))))
                if restored:
                    texts.append(said)
            columns = [batch.column(i) for i in places]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), *([pa.array(texts, pa.string())] if restored else [])], names=[*out, *added])

    fields = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes if c in out), "score double", *(["restored string"] if restored else [])])
    return kept.mapInArrow(score, fields)
