"""Hashed word-shingle sets of texts and their parity sketches, as numpy arrays.  One text is one call's work."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _salt(band: int, use: int) -> np.uint64:
    return _U(((8 * band + use) * int(_M1)) & _MASK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """One polynomial hash for each word of UTF-8 bytes, taken from a single running sum over the text."""
    codes = np.frombuffer(data, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_BLANK[codes]
    edges = np.flatnonzero(np.diff(inside))
    first, last = edges[::2], edges[1::2]
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _GOLD)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, A-Z lower-cased; of the whole sequence when it is shorter; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    out = np.full(count, (width * int(_GOLD)) & _MASK, np.uint64)
    for k in range(width):
        out += words[k : k + count] * _STEP[k]
    return np.unique(mix(out))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers: equal sets have equal digests."""
    a = mix(hashes.sum(dtype=np.uint64, keepdims=True) + _U((len(hashes) * int(_GOLD)) & _MASK))
    b = np.bitwise_xor.reduce(mix(hashes + _M1), keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def size_band(n: int) -> int:
    """Bands of set sizes: [4 ** b, 4 ** (b + 1))."""
    return (max(n, 1).bit_length() - 1) // 2


class Bands:
    """Parity sketches by size band for one threshold, percent / 100 of the union.

    Sets of sizes a <= b that link differ in at most (a + b) * (100 - p) / (100 + p) elements, and b <= 100 * a / p.  A
    band's table holds its own sets and those of the band below that are large enough to link with one of its own.
    """

    def __init__(self, percent: int):
        self.p = percent

    def differ(self, total: int) -> int:
        return total * (100 - self.p) // (100 + self.p)

    def tables(self, n: int) -> list[int]:
        own = size_band(n)
        return [own, own + 1] if size_band(100 * n // self.p) > own else [own]

    def parts(self, band: int) -> int:
        """More parts than elements that can differ; a quarter more, so that near-empty parts need not be used."""
        return max(16, -(-5 * (self.differ(2 * (4 ** (band + 1) - 1)) + 1) // 4)) if band else 1

    def signatures(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """The parts' XOR sums that the pigeonhole needs, as signed keys.

        Elements fall into parts by hash.  d differing elements touch at most d of the k parts, so k - d signatures of
        two linking sets agree, and the first d + 1 of either, in any order that the signature itself fixes, share one.
        That order puts parts with most elements first: empty or single ones, which strangers share, come last.
        """
        n = len(hashes)
        most = min(self.parts(band), self.prefix(n, band))
        return np.partition(self.part_keys(hashes, band), most - 1)[:most].view(np.int64)

    def prefix(self, n: int, band: int) -> int:
        """One more than the elements in which a set of n can differ from one that it links with in this band's table."""
        return 1 + self.differ(n + min(100 * n // self.p, 4 ** (band + 1) - 1))

    def part_keys(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """One key for each part: above, 255 less its number of elements; below, 56 bits of its XOR sum and number."""
        k = self.parts(band)
        spread = mix(hashes ^ _salt(band, 1))
        part = ((spread >> _U(32)) * _U(k) >> _U(32)).astype(np.uint16 if k < 65536 else np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=k)
        xors = np.zeros(k, np.uint64)
        full = np.flatnonzero(counts)
        xors[full] = np.bitwise_xor.reduceat(mix(hashes[order] + _M2), np.concatenate(([0], np.cumsum(counts[full])[:-1])))
        keys = mix(mix(xors + np.arange(k, dtype=np.uint64) * _GOLD) + _salt(band, 2) + counts.astype(np.uint64))
        return (_U(255) - np.minimum(counts, 255).astype(np.uint64)) << _U(56) | keys >> _U(8)

    def sketch(self, hashes: np.ndarray, band: int) -> bytes:
        """Parity bits: every element flips one, so the Hamming distance of two sketches is at most their sets' difference."""
        bits = 8 * 4**band if band > 2 else 128
        at = (mix(hashes + _salt(band, 3)) % _U(bits)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()
