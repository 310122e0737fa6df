"""Token ids in compressed files: one zstandard frame a document, one dictionary for all, an offset index in each file.

File layout, little-endian: magic, 32-byte SHA-256 of the dictionary, frames back to back, then the index (doc_id int64,
has_id uint8, frame offset uint64, frame length uint64, token count uint64, each as one array), and at the end the number of
documents and the index's offset (uint64 each).  A frame holds a document's ids as unsigned 32-bit integers.  Files are rows
of a Spark table (file, part, n_docs, n_tokens, least and largest doc_id, data), so any store that Spark writes will do; the dictionary is a table of
its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.common import KeyRanges, sample_by_hash, small, text_batches

MAGIC = b"TIDS0001"
FILES = "file int, part int, n_docs long, n_tokens long, lo long, hi long, data binary"
INDEX = (("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8"))
#: The dictionary is trained on pieces of so many documents, those of least key hash; a piece of at most so many
#: characters begins at a place that the key's hash fixes, anywhere in the text.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 8192, 1 << 16
#: Tasks that pack files at most; each packs its files one after the other.
PACK_TASKS = 32_768


class WordEncoder:
    """Ids of texts.  With a tokenizer that never joins across ASCII white space each distinct word is encoded once.

    A word goes through the whole tokenizer, unless the tokenizer is of the known kind below and the word holds only
    printable ASCII and Latin letters.  Such a word's pre-tokens are its runs of letters, single digits and runs of the
    rest in lower case, so the library's model gets each distinct run once.  Words and runs are remembered in two
    generations of at most `held`: when the younger one is full it becomes the older, which is forgotten.  So memory is
    bounded and what comes often stays; words beyond 64 bytes are not remembered.  Texts of a tokenizer that may join
    across white space go through it whole.
    """

    #: What is known of the tokenizers whose words may be taken apart.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = "À-ÖØ-öø-įĲ-ſ"
    #: Steps of other tokenizers that cut at white space, and those before them that do not look beyond a blank.
    CUTS, KEEPS_BLANKS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}, {"NFC", "Lowercase", "StripAccents", "BertNormalizer"}
    #: Bytes that end a word as a pre-token of their own.
    ENDS = frozenset(b".,;:!?")

    def __init__(self, tokenizer_json: str, end_id: int, held: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.held = Tokenizer.from_str(tokenizer_json), held
        self.model = self.tokenizer.model
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.older_runs: dict[str, bytes] = {}
        spec = json.loads(tokenizer_json)
        self.plain = self._is_known_kind(spec)
        self.by_words = self.plain or self._cuts_at_blanks(spec)
        self.simple = re.compile(rf"(?!.*<\|)[!-&(-~{self.LATIN}]+").fullmatch if self.plain else lambda _: None
        self.split = re.compile(rf"[a-z{self.LATIN}]+|[0-9]|[^a-z0-9{self.LATIN}]+").findall
        self.letters = re.compile(rf"([A-Za-z{self.LATIN}]+)([.,;:!?]?)").fullmatch
        self.letter = self._byte_letters()

    def _is_known_kind(self, spec: dict) -> bool:
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = len(steps) == 2 and steps[0].get("pattern") == {"Regex": self.SPLIT} and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        special = all(t["content"].startswith("<|") and t["special"] for t in spec.get("added_tokens", []))
        return kinds == self.NORMALIZERS and plain and special

    def _cuts_at_blanks(self, spec: dict) -> bool:
        """Whether what a tokenizer makes of a text is surely what it makes of its words, one after the other."""
        normal, steps = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        kinds = {n.get("type") for n in (normal.get("normalizers", [normal]) if normal else [])}
        first = (steps.get("pretokenizers") or [steps])[0].get("type")
        added = any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        return first in self.CUTS and kinds <= self.KEEPS_BLANKS and not added and not spec.get("truncation") and not spec.get("padding")

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that byte-level models use for each byte: itself if printable, else one from 256 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]

    def _run(self, run: str) -> bytes:
        """Ids of a run in lower case, straight from the model."""
        letters = run if run.isascii() else "".join([self.letter[b] for b in run.encode()])
        if len(self.runs) > self.held:
            self.older_runs, self.runs = self.runs, {}
        if (ids := self.older_runs.get(run)) is None:
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        self.runs[run] = ids
        return ids

    def _by_runs(self, word: str) -> bytes:
        """Ids of a simple word, run by run."""
        runs = self.runs
        return b"".join([ids if (ids := runs.get(run)) is not None else self._run(run) for run in self.split(word.lower())])

    def _of_letters(self, letters: str, mark: str) -> bytes:
        """Ids of letters, which are one run, and of a mark that ends them."""
        run = letters.lower()
        ids = found if (found := self.runs.get(run)) is not None else self._run(run)
        if not mark:
            return ids
        return ids + (found if (found := self.runs.get(mark)) is not None else self._run(mark))

    def encode(self, texts: list[bytes | str | None]) -> list[bytes]:
        """Each text's ids and the end id, as bytes of unsigned 32-bit integers."""
        if not self.by_words:
            whole = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t or "" for t in texts]
            return [np.array(e.ids, "<u4").tobytes() + self.end for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        out, plain, ends, end = [], self.plain, self.ENDS, self.end
        for text in texts:
            words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split()
            if len(self.known) > self.held:
                self.older, self.known = self.known, {}
            known, older, rest, long = self.known, self.older, {}, []
            for w in set(words).difference(known):
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                elif len(w) > 64:
                    long.append(w)
                    rest[w] = w.decode("utf-8", "replace")
                elif plain and w.isalpha():  # ASCII letters alone are one run
                    known[w] = self._of_letters(w.decode(), "")
                elif plain and w[-1] in ends and w[:-1].isalpha():
                    known[w] = self._of_letters(w[:-1].decode(), chr(w[-1]))
                elif plain and (m := self.letters(word := w.decode("utf-8", "replace"))):
                    known[w] = self._of_letters(m[1], m[2])
                elif self.simple(word := w.decode("utf-8", "replace")):
                    known[w] = self._by_runs(word)
                else:
                    rest[w] = word
            if rest:
                got = self.tokenizer.encode_batch_fast(list(rest.values()), add_special_tokens=False)
                known |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, got, strict=True)}
            out.append(b"".join(map(known.__getitem__, words)) + end)
            for w in long:
                del known[w]
        return out


@functools.lru_cache(maxsize=1)
def word_encoder(tokenizer_json: str, end_id: int) -> WordEncoder:
    """The encoder of a worker, kept with the words that it remembers from task to task."""
    return WordEncoder(tokenizer_json, end_id)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too few or too small samples give one of raw content, none an empty one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack_file(rows: list[tuple[int | None, bytes, int]], dictionary_hash: bytes) -> bytes:
    """A file of (doc_id, frame, token count) rows in their order."""
    head = MAGIC + dictionary_hash
    lengths = np.array([len(f) for _, f, _ in rows], "<u8")
    columns = {
        "doc_id": np.array([0 if i is None else i for i, _, _ in rows], "<i8"), "has_id": np.array([i is not None for i, _, _ in rows], "u1"),
        "offset": (np.cumsum(lengths) - lengths + len(head)).astype("<u8"), "length": lengths, "tokens": np.array([n for _, _, n in rows], "<u8"),
    }
    at = len(head) + int(lengths.sum())
    return b"".join([head, *(f for _, f, _ in rows), *(columns[c].tobytes() for c, _ in INDEX), np.array([len(rows), at], "<u8").tobytes()])


def file_index(data: bytes, dictionary_hash: bytes) -> dict[str, np.ndarray]:
    """The index of a file; ValueError when it is no such file or its dictionary is another."""
    if data[: len(MAGIC)] != MAGIC or data[len(MAGIC) : len(MAGIC) + 32] != dictionary_hash:
        raise ValueError("not a token file of this dictionary")
    count, at = (int(x) for x in np.frombuffer(data, "<u8", 2, len(data) - 16))
    found = {}
    for name, kind in INDEX:
        found[name] = np.frombuffer(data, kind, count, at)
        at += found[name].nbytes
    return found


def read_document(data: bytes, index: dict[str, np.ndarray], row: int, reader: zstandard.ZstdDecompressor) -> bytes:
    """One document's ids as bytes, without touching the others."""
    start, tokens = int(index["offset"][row]), int(index["tokens"][row])
    return reader.decompress(data[start : start + int(index["length"][row])], max_output_size=4 * tokens)


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id", docs_per_file: int = 5_000, part_bytes: int = 64 << 20) -> None:
    """Encode every text and write path/dictionary and path/files, documents in ascending key order (nulls first).

    Null texts are empty and hold the end id alone; repeated keys follow each other.  Files are ranges of the integer key, and of a hash of
    the text where a key fills several;
    a range beyond `part_bytes` has several parts.  Texts are encoded and compressed where they are read, so only frames are
    shuffled.  An empty table writes no files.
    """
    spark = df.sparkSession
    text_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = df.count()
    begin = F.pmod(F.col("__h"), F.greatest(F.char_length(text) - SAMPLE_CHARS + 1, F.lit(1))) + 1
    sample = sample_by_hash(df.filter(F.char_length(text) > 0), key, SAMPLE_DOCS, rows).select(F.substr(text, begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), "__h").orderBy("__h", "t").limit(SAMPLE_DOCS)
    data = train_dictionary(WordEncoder(tokenizer.value, end_id).encode([r["t"] for r in sample.collect()]))
    dictionary_hash = hashlib.sha256(data).digest()
    dictionary = spark.sparkContext.broadcast(data)
    spark.createDataFrame([(dictionary_hash.hex(), bytearray(data))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    files = KeyRanges(df, key, -(-rows // docs_per_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(tokenizer.value, end_id)
        writer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary.value))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = words.encode(part.column(2).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([writer.compress(x) for x in ids], pa.binary())], names=["file", "doc_id", "n", "frame"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int | None, bytes, int]] = []
        now, part, size = None, 0, 0

        def done() -> pd.DataFrame:
            ids = [i for i, _, _ in held if i is not None]
            ends = [pd.array([f(ids) if ids else None], "Int64") for f in (min, max)]
            return pd.DataFrame({"file": [now], "part": [part], "n_docs": [len(held)], "n_tokens": [sum(n for _, _, n in held)], "lo": ends[0], "hi": ends[1], "data": [pack_file(held, dictionary_hash)]})

        for batch in batches:
            for file, doc_id, n, frame in zip(batch["file"], batch["doc_id"].astype("Int64"), batch["n"], batch["frame"], strict=True):
                if held and (file != now or size > part_bytes):
                    yield done()
                    part, held, size = part + 1 if file == now else 0, [], 0
                elif file != now:
                    part = 0
                now, size = file, size + len(frame)
                held.append((None if doc_id is pd.NA else int(doc_id), frame, int(n)))
        if held:
            yield done()

    placed = df.select(files.index(F.col(key), F.xxhash64(text)).alias("file"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frames = placed.mapInArrow(encode, "file int, doc_id long, n long, frame binary")
    dealt = frames.repartition(min(files.count, PACK_TASKS), "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "frame")
    dealt.mapInPandas(pack, FILES).write.parquet(f"{path}/files")


def _opened(spark: SparkSession, path: str):
    """The dictionary, broadcast, and its hash."""
    kept = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, dictionary_hash = spark.sparkContext.broadcast(bytes(kept["data"])), bytes.fromhex(kept["sha256"])
    if hashlib.sha256(dictionary.value).digest() != dictionary_hash:
        raise ValueError("the dictionary is damaged")
    return dictionary, dictionary_hash


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of a few documents: only files whose ids may hold them are read, and only their frames unpacked.

    Ids that are absent give no row, ids that repeat in the files a row each.  For many ids join with read_token_files.
    """
    wanted = sorted({int(i) for i in doc_ids})
    dictionary, dictionary_hash = _opened(spark, path)
    near = F.lit(False)
    for i in wanted:
        near = near | ((F.col("lo") <= i) & (F.col("hi") >= i))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary.value))
        for batch in batches:
            for data in batch["data"]:
                index = file_index(data, dictionary_hash)
                rows = np.flatnonzero(np.isin(index["doc_id"], wanted) & (index["has_id"] == 1))
                yield pd.DataFrame({"doc_id": index["doc_id"][rows], "n_tokens": index["tokens"][rows].astype(np.int64), "ids": [read_document(data, index, k, reader) for k in rows]})

    return spark.read.schema(FILES).parquet(f"{path}/files").filter(near).select("data").mapInPandas(fetch, "doc_id long, n_tokens long, ids binary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files: start counts the ids of all before it."""
    dictionary, dictionary_hash = _opened(spark, path)
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    order = W.partitionBy().orderBy("file", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("file", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("first"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary.value))
        for batch in batches:
            for first, data in zip(batch["first"], batch["data"], strict=True):
                index = file_index(data, dictionary_hash)
                begin = int(first) + np.cumsum(index["tokens"]).astype(np.int64) - index["tokens"].astype(np.int64)
                for low in range(0, len(begin), 512):
                    rows = range(low, min(low + 512, len(begin)))
                    ids = [read_document(data, index, k, reader) for k in rows]
                    at = slice(low, low + 512)
                    doc_id = pd.array(index["doc_id"][at], "Int64")
                    doc_id[index["has_id"][at] == 0] = pd.NA
                    yield pd.DataFrame({"doc_id": doc_id, "start": begin[at], "n_tokens": index["tokens"][at].astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in ids], "ids": ids})

    count = files.count()
    return files.select("file", "part", "data").join(small(starts, count), ["file", "part"]).select("first", "data").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
