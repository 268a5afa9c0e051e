"""Words, hashes and statistics of one text. A word is a run of bytes other than space and \\x09-\\x0D.

bytes.split() splits at exactly those six characters, all of them ASCII, so words of the UTF-8 bytes
are words of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


class WordHashes(dict):
    """word -> 64-bit hash; a cache of bounded size over a fixed function."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + MIX
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; fewer than k words: the whole sequence as one; none: none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = mixed(hashes[: n - k + 1] + np.uint64(n if n < k else k))
    for j in range(1, k):
        out = mixed(out ^ hashes[j : n - k + 1 + j])
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(hashes) < 4:
        return 0
    tri = shingles(hashes, 3)
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    cover = np.zeros(len(hashes), bool)
    cover[at] = cover[at + 1] = cover[at + 2] = True
    return int(cover.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(raw: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    points = len(raw.decode("utf-8", "replace")) if not raw.isascii() else len(raw)
    blanks = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(hashes), points - blanks, symbols, duplicate_lines(raw), repeated_words(hashes)
