"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file: the normaliser (its character map as a transducer over bytes; escaped blanks, dummy prefix,
extra blanks), the pieces as arcs over a prefix tree, and for characters that no piece covers a chain of byte arcs.  An input is composed with these arcs state by
state and the path of least weight in the tropical semiring (min, +) is its encoding.

For a unigram model an arc weighs its piece's negative log probability and a state is a position.  A BPE model has no such
weights: its encoding is the one path in which every two neighbouring pieces are what merging their joined text gives.
So a state is a position with the last piece, and an arc weighs 0 after a piece that it may follow, infinity otherwise.

Pieces never hold a blank after another character, so a text falls apart before its blanks, and each distinct part is
composed once.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import text_batches

BLANK = "▁"
#: Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class CharMap:
    """A model's character map: a transducer over UTF-8 bytes that always takes the longest rule, and copies a character without one.

    The file holds it as the size of a double array, its 32-bit units, and the texts to write, each ended by a zero byte.
    A unit has a label (bits 0-7, and 31 for a unit that is a value), a mark that a rule ends here (8) and the way to its
    children (10 on, times 256 where bit 9 is set).
    """

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0]
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist()
        self.texts = data[4 + size :]
        single = {chr(c): found[1] for c in range(128) if (found := self.rule(bytes([c]), 0))}
        pairs = any((found := self.rule(bytes([a, b]), 0)) and found[0] == 2 for a in range(128) for b in range(128))
        self.ascii = None if pairs else str.maketrans(single)

    def rule(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length and text of the longest rule that begins at a byte."""
        units, found, begin = self.units, None, at
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        while at < len(data):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            at += 1
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = at - begin, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])].decode("utf-8")

    def apply(self, text: str) -> str:
        if self.ascii is not None and text.isascii():
            return text.translate(self.ascii)
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            found = self.rule(data, at)
            if found is None:
                lead = data[at]
                found = (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4), ""
                out.append(data[at : at + found[0]].decode("utf-8"))
            else:
                out.append(found[1])
            at += found[0]
        return "".join(out)


class Transducer:
    """A compiled model.  Encodings of parts are remembered in two generations of at most `held`: what comes often stays."""

    def __init__(self, model: bytes, held: int = 150_000):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.charmap = CharMap(normaliser[2]) if normaliser.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.texts = [t.replace(BLANK, " ") if k in (NORMAL, USER_DEFINED) else t for t, k in zip(self.texts, self.types, strict=True)]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.types, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.types, strict=True)) if k == BYTE}
        if self.charmap and USER_DEFINED in self.types:
            raise ValueError("models with a character map and pieces of the user's own are not compiled")
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.arcs: dict[str, list] = {}  # by character: [piece or -1, the arcs on from there or None]
        for text, i in self.ids.items():
            arcs, state = self.arcs, None
            for c in text:
                if arcs is None:
                    arcs = state[1] = {}
                state = arcs.setdefault(c, [-1, None])
                arcs = state[1]
            state[0] = i
        apart = self.escape and not any(re.search("[^ ] ", t) for t in self.ids)
        edge = "" if "\n" in "".join(self.ids) else "\n"
        self.part = re.compile(f" *[^ {edge}]+| +|\n") if apart else re.compile("(?s).+")
        self.inside = {pair for t in self.ids for pair in zip(t, t[1:])}
        self.follows: dict[int, bool] = {}
        self.built: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.held, self.known, self.cores = held, {}, {}
        self.older: dict[str, bytes] = {}
        self.older_cores: dict[str, bytes] = {}

    # -- the parts of the composition ------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.charmap:
            text = self.charmap.apply(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = f" {text}" if self.prefix else text
        return text.replace(BLANK, " ") if self.escape else text

    def steps(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How merging builds a piece: each merge's score, and before each merge and at the end the first and last parts."""
        if (known := self.built.get(piece)) is None:
            parts, scores, first, last = list(self.texts[piece]), [], [], []
            while True:
                first.append(parts[0])
                last.append(parts[-1])
                best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                scores.append(best[0])
                parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
            if len(parts) > 1:
                scores, first, last = [], [], []  # merging never gives this piece
            known = self.built[piece] = (scores, first, last)
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives just them: no merge across their border comes first."""
        key = left << 32 | right
        if (known := self.follows.get(key)) is None:
            if len(self.follows) > 500_000:
                self.follows = {}
            a_scores, _, a_last = self.steps(left)
            b_scores, b_first, _ = self.steps(right)
            i, j, known = 0, 0, bool(a_last and b_first)
            while known:
                a = a_scores[i] if i < len(a_scores) else None
                b = b_scores[j] if j < len(b_scores) else None
                across = self.ids.get(a_last[i] + b_first[j])
                if across is not None:
                    c = self.scores[across]
                    if (a is None or c > a) and (b is None or c >= b):
                        known = False
                        break
                if a is None and b is None:
                    break
                if b is None or (a is not None and a >= b):
                    i += 1
                else:
                    j += 1
            self.follows[key] = known
        return known

    def from_here(self, part: str, at: int) -> list[tuple[int, int]]:
        """Arcs that leave a position, (end, piece), longest first; where no piece covers its character, bytes (piece -2)."""
        arcs, size, found, end = self.arcs, len(part), [], at
        while end < size and (state := arcs.get(part[end])) is not None:
            end += 1
            piece, arcs = state
            if piece >= 0:
                found.append((end, piece))
            if arcs is None:
                break
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, -2))
        found.reverse()
        return found

    def path(self, part: str) -> list[int]:
        """Ids of the path of least weight over a part of normalised text."""
        ends, pieces = self.bpe_path(part) if self.kind == BPE else self.unigram_path(part)
        if -2 not in pieces:
            return pieces
        out: list[int] = []
        for at, end, piece in zip([0, *ends], ends, pieces):
            if piece != -2:
                out.append(piece)
            elif self.bytes:
                shown = part[at:end].replace(" ", BLANK) if self.escape else part[at:end]
                out += [self.bytes[b] for b in shown.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def bpe_path(self, part: str) -> tuple[list[int], list[int]]:
        """Ends and pieces of the path.  Depth first, longest arcs first: every path of finite weight weighs 0, so the first to arrive is least."""
        follows, size = self.follows.get, len(part)
        arcs: list[list[tuple[int, int]] | None] = [None] * size
        dead: set[tuple[int, int]] = set()
        ends: list[int] = []
        pieces: list[int] = []
        turns: list[int] = []
        at, last, turn = 0, -1, 0
        while at < size:
            if (options := arcs[at]) is None:
                options = arcs[at] = self.from_here(part, at)
            for end, piece in options[turn:] if turn else options:
                turn += 1
                if last >= 0 and piece >= 0:
                    known = follows(last << 32 | piece)
                    if known is None:
                        known = self.may_follow(last, piece)
                    if not known:
                        continue
                if dead and (end, piece) in dead:
                    continue
                ends.append(end)
                pieces.append(piece)
                turns.append(turn)
                at, last, turn = end, piece, 0
                break
            else:
                dead.add((at, last))
                if not ends:
                    break
                ends.pop()
                pieces.pop()
                turn = turns.pop()
                at, last = (ends[-1], pieces[-1]) if ends else (0, -1)
        return ends, pieces

    def unigram_path(self, part: str) -> tuple[list[int], list[int]]:
        size = len(part)
        best: list[tuple[float, int, int] | None] = [(0.0, 0, 0)] + [None] * size
        unknown = 10.0 - min(x for x, k in zip(self.scores, self.types, strict=True) if k == NORMAL)
        for at in range(size):
            weight = best[at][0]
            for end, piece in self.from_here(part, at):
                total = weight + (unknown if piece == -2 else -self.scores[piece])
                if best[end] is None or total < best[end][0]:
                    best[end] = (total, at, piece)
        ends, pieces, at = [], [], size
        while at:
            _, back, piece = best[at]
            ends.append(at)
            pieces.append(piece)
            at = back
        return ends[::-1], pieces[::-1]

    # -- whole texts -----------------------------------------------------------------

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers; null and empty give none."""
        parts = self.part.findall(self.normalise(text or ""))
        if len(self.known) > self.held:
            self.older, self.known = self.known, {}
        known, older, long = self.known, self.older, []
        for p in set(parts).difference(known):
            known[p] = ids if (ids := older.get(p)) is not None else self.encode_part(p)
            if len(p) > 64:
                long.append(p)
        out = np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")
        for p in long:
            del known[p]
        if not self.bytes and len(out) > 1:  # neighbouring unknown characters are one unknown piece
            unknown = out == self.unknown
            out = out[~unknown | np.concatenate(([True], ~unknown[:-1]))]
        return out

    def encode_part(self, part: str) -> bytes:
        """Ids of a part as bytes.  It falls apart where no piece holds the two characters that meet; what is left is remembered."""
        if len(self.cores) > self.held:
            self.older_cores, self.cores = self.cores, {}
        inside, cores, start, out = self.inside, self.cores, 0, []
        if len(part) <= 32 and part[1:].isalpha():  # few such parts fall apart
            if (ids := cores.get(part)) is None:
                if (ids := self.older_cores.get(part)) is None:
                    ids = array("I", self.path(part)).tobytes()
                cores[part] = ids
            return ids
        cuts = [k for k, pair in enumerate(zip(part, part[1:]), 1) if pair not in inside]
        for at in [*cuts, len(part)]:
            core = part[start:at]
            if (ids := cores.get(core)) is None:
                if (ids := self.older_cores.get(core)) is None:
                    ids = array("I", self.path(core)).tobytes()
                if len(core) <= 32:
                    cores[core] = ids
            out.append(ids)
            start = at
        return out[0] if len(out) == 1 else b"".join(out)


class Speller:
    """The way back: pieces of ids as bytes."""

    def __init__(self, model: bytes):
        self.prefix, self.said = True, []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
                self.said.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(BLANK, " ").encode())
            elif number == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of ids, without the dummy prefix; bytes that are no UTF-8 become replacement characters.

        ValueError for an id that the model does not have.
        """
        at = np.asarray(ids, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self.said)):
            raise ValueError(f"ids must be from 0 to {len(self.said) - 1}")
        said = b"".join(map(self.said.__getitem__, at.tolist())).decode("utf-8", "replace")
        return said[1:] if self.prefix and said[:1] == " " else said


@functools.lru_cache(maxsize=1)
def compiled_model(model: bytes) -> Transducer:
    """The transducer of a worker, kept with the parts that it remembers from task to task."""
    return Transducer(model)


def _shared(df: DataFrame, model_path: str):
    text_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids (array<int>) of each text; null and empty texts have none.

    Whole texts, row by row: repeated rows agree, and an empty table gives no rows.  No shuffle; a column named `out` is replaced.
    """
    model = _shared(df, model_path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = compiled_model(model.value)
        for texts in batches:
            yield pd.Series([compiled.encode(x).view("<i4") for x in texts])

    return df.withColumn(out, encode(F.col(text)))


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each id list; null lists give empty texts, ids that the model does not have fail.  A column named `out` is replaced."""
    model = _shared(df, model_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speller = Speller(model.value)
        for lists in batches:
            yield pd.Series(["" if x is None else speller.decode(x) for x in lists], dtype=object)

    return df.withColumn(out, decode(F.col(ids)))
