"""Word codes and word windows of one text, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Distinct words whose codes a task remembers; beyond it the memory starts over.
REMEMBERED = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordCodes(dict):
    """64-bit codes of words, computed once for each word while remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` codes, in order."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + codes[j:j + n]
    return mixed(out)


def shingle_set(codes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct windows; a text of 1 to k - 1 words is a single window, an empty one has none."""
    if 0 < len(codes) < k:
        return windows(codes, len(codes))
    return np.unique(windows(codes, k))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, as Spark holds them."""
    return x.view(np.int64)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of every ``width`` consecutive values (of all, if there are fewer), each place once.

    Only the high bits of the values are compared; the first of equal ones counts. Running minima of blocks in both
    directions give all windows in one pass.
    """
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    width = min(width, n)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    placed = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = placed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # The place never moves back from one window to the next.
    return at[np.flatnonzero(np.diff(at, prepend=-1))]
