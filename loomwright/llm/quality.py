"""Quality rules: how much of a text lies inside n-grams and lines that it repeats.

Words are hashed once a text; rolling sums of those hashes give the n-grams of every length as numpy arrays.  A longer
n-gram can only repeat where a shorter one does, so clean texts stop at the shortest length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import text_batches

#: Largest share of a text's word characters inside repeated n-grams, by n; and inside repeated lines (key 0).  The usual published limits.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10, 0: 0.20}
#: In shorter texts the limits grow in proportion: nine words said twice pass at any length.
SHORT_WORDS = 200
SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, coverage double, dup_line_share double, kept boolean"
_MIX = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SYMBOL = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SYMBOLS, np.uint8))
_IS_BLANK = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(BLANK_BYTES, np.uint8))


def repeated_windows(words: np.ndarray, n: int) -> np.ndarray | None:
    """Which n-word windows occur at least twice (the first included); None when none does."""
    count = len(words) - n + 1
    if count < 2:
        return None
    grams = words[:count] * _MIX[0]
    for k in range(1, n):
        grams = grams + words[k : k + count] * _MIX[k]
    ranked = np.sort(grams)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, grams)
    at[at == len(twice)] = 0
    return twice[at] == grams


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a marked n-word window."""
    out = np.zeros(len(windows) + n - 1, bool)
    for k in range(n):
        out[k : k + len(windows)] |= windows
    return out


def measure(text: str | None, coverage: Mapping[int, float], short_words: int = SHORT_WORDS) -> tuple:
    """The columns of SCHEMA for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    codes = np.frombuffer(data, np.uint8)
    starts = (codes & 0xC0) != 0x80
    blank = _IS_BLANK[codes]
    word_chars = int(starts.sum()) - int(blank.sum())
    symbols = int(_IS_SYMBOL[codes].sum())
    lines = [x for x in data.split(b"\n") if x.strip(BLANK_BYTES)]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    dup_lines = len(lines) - len(seen)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    triple = repeated_windows(hashes, 3)
    repeats = 0 if triple is None else int(covered(triple, 3).sum())
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    worst, line_share, fine = 0.0, 0.0, True
    wider = max(1.0, short_words / max(1, len(words)))
    if word_chars and dup_lines:
        twice = sum(c * sum((b & 0xC0) != 0x80 for b in x if b not in BLANK_BYTES) for x, c in seen.items() if c > 1)
        line_share = twice / word_chars
        fine = line_share <= coverage.get(0, 1.0) * wider
    lengths: np.ndarray | None = None
    for n in sorted(k for k in coverage if k):
        if word_chars == 0 or (windows := repeated_windows(hashes, n)) is None:
            break
        if lengths is None:
            edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.uint8), [1])).astype(np.int8)))
            upto = np.concatenate(([0], np.cumsum(starts)))
            lengths = upto[edge[1::2]] - upto[edge[::2]]
        share = float(lengths[covered(windows, n)].sum()) / word_chars
        worst, fine = max(worst, share), fine and share <= coverage[n] * wider
    return len(words), word_chars, symbols, dup_lines, repeats, failed, worst, line_share, bool(fine and not failed)


def quality_rules(df: DataFrame, text: str = "text", coverage: Mapping[int, float] | None = None, short_words: int = SHORT_WORDS) -> DataFrame:
    """Add the columns of SCHEMA to each row; columns of those names are replaced.

    Base figures: words, their code points, symbols `#*$%&|<>`, lines equal to an earlier one (lines with a word only),
    words in 3-word windows that repeat.  base_failed: under 50 words, or over half of them in such windows.  coverage:
    the largest share of word characters inside repeated n-grams of any measured length; dup_line_share: the share inside
    lines that repeat, all copies counted.  kept: not base_failed and no share above its limit in `coverage` (n-gram
    length to limit, 0 for lines); texts of fewer than `short_words` words have limits larger by short_words / n_words.
    Null and empty texts have no words and fail.  Rows are judged one by one, so repeated rows agree.  An empty table
    gives no rows.  No shuffle; a text is one row's work.
    """
    limits = dict(COVERAGE if coverage is None else coverage)
    text_batches(df.sparkSession)

    @F.pandas_udf(SCHEMA)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(x, limits, short_words) for x in texts], columns=names)

    added = [x.split()[0] for x in SCHEMA.split(", ")]
    names = [c for c in df.columns if c not in added]
    done = df.select(*names, rules(F.col(text)).alias("__q"))
    return done.select(*names, *[F.col(f"__q.{c}").alias(c) for c in added])
