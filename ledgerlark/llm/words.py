"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """A number for each of ``n`` places, odd and in no relation to one another.

    A sum of small numbers (bytes, plus one) times these is a multilinear hash: whatever two strings
    are, one in 2 ** 56 choices of ``seed`` at most gives them one sum, before ``mixed`` spreads it.
    Powers of one number won't do: some strings collide for every base.
    """
    return mixed(np.arange(n, dtype=np.uint64) + np.uint64((seed << 40) + 1)) | np.uint64(1)


class WordHasher:
    """Splits byte strings into words and hashes each word to 64 bits.

    ``table`` maps each byte to itself, to its lower case, or to a space where it is no part of a word.
    """

    BLOCK = 1 << 20

    def __init__(self, table: bytes, seed: int = 7) -> None:
        self.table, self.seed, self.values = table, seed, np.arange(1, 257, dtype=np.uint64)
        self.values[32] = 0
        self.places = multipliers(1 << 12, seed)

    def split(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes, and the start and end of each word."""
        clean = raw.translate(self.table)
        b = np.frombuffer(clean, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], b != 32, [False])).view(np.int8)))
        return clean, edge[::2], edge[1::2]

    def hashes(self, clean: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words, block by block so that memory follows the block and not the text."""
        b, out, i = np.frombuffer(clean, np.uint8), np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + self.BLOCK)))
            lo, hi = int(starts[i]), int(ends[j - 1])
            lengths = np.diff(np.append(starts[i:j], hi))
            at = np.arange(hi - lo, dtype=np.int64) - np.repeat(starts[i:j] - lo, lengths)
            most = int(lengths.max())  # with the blanks behind a word, whose value is 0
            values = self.values[b[lo:hi]] * (self.places if most <= len(self.places) else multipliers(most, self.seed))[at]
            out[i:j] = np.add.reduceat(values, starts[i:j] - lo)
            i = j
        return mixed(out)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow one another; the last n - 1 words begin none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, q = np.zeros(len(h) - n + 1, np.uint64), multipliers(n, 11)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * q[k]
    return mixed(out)


def grouped(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, or of one longer text."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def table_of(is_word: callable, lower: bool = True) -> bytes:
    """A byte table: A-Z become a-z if ``lower``, then bytes that are no part of a word become spaces."""
    out = []
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        out.append(c if is_word(c) else 32)
    return bytes(out)


#: Words are runs of characters other than U+0000-002F, 003A-0060 and 007B-007F.
ALNUM = table_of(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: Words are runs of characters other than space and U+0009-000D.
NONBLANK = table_of(lambda c: c != 32 and not 9 <= c <= 13)
