"""Word shingles as 64-bit hashes, computed with NumPy over whole batches of texts.

Words are runs of bytes outside the blanks; A-Z are lower-cased. A word's hash is a polynomial of
its bytes, read off prefix sums of one buffer that holds many texts; a shingle's hash is a
polynomial of its words' hashes. Memory is bounded by the segment, not by the length of a text.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_value = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_value[ord("A"):ord("Z") + 1] = _value[ord("a"):ord("z") + 1]
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        up, down = np.full(n, _P), np.full(n, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def _segment(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one segment, which cuts no word."""
    gap = _blank[b]
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(max(len(b), SEGMENT))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_value[b] * up[:len(b)], out=total[1:])
    return start, mixed((total[end] - total[start]) * down[start], 1)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words in order (null: none)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, hashes, at = [], [], 0
    while at < len(buf):
        to = min(len(buf), at + SEGMENT)
        while to < len(buf):  # move the cut to a blank
            near = np.flatnonzero(_blank[buf[to:to + SEGMENT]])
            if len(near):
                to += int(near[0])
                break
            to = min(len(buf), to + SEGMENT)
        s, h = _segment(buf[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return [np.zeros(0, np.uint64) for _ in raw]
    cut = np.searchsorted(np.concatenate(starts), ends)[:-1]
    return np.split(np.concatenate(hashes), cut)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``k`` words; a shorter sequence is one shingle."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    h = np.full(n - m + 1, np.uint64(m), np.uint64)
    for j in range(m):
        h = h * _M + words[j:n - m + 1 + j]
    return np.unique(mixed(h, 2))
