"""Word shingles of texts as 64-bit hashes in numpy.

Defined cases: a null or empty text and one of white space alone has no words and the empty set; a text with fewer words than a
shingle has one, its whole sequence. Shingles are equal if their hashes are: words are not compared, and two different shingles of a
table of n have the same hash with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import numpy as np

from tallyframe.llm.common import LOWER

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64 for i under n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, p in enumerate((_P, _P_INVERSE)):
            out = np.full(size, np.uint64(p), dtype=np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data (runs of bytes other than white space)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of so many words; of a shorter text its whole sequence; none without words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    h = word_hashes(data)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(out)] + np.uint64(n))
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
